"""Several values packed in one field: one row per value, split by the dialect of least description length.

A dialect says which classes of delimiters divide, and whether and how quotes
enclose. Every distinct field text is parsed under all dialects that its
characters allow; parses that agree are one. The code length of a parse is

* for each value either the name of a known one, log2(T / n) bits for a value that
  n texts may hold among the column's T places, with its n-th part of spelling it
  out once, or a new value spelled out (``NEW_BITS``). Spelling takes
  ``CHAR_BITS``, about the entropy of prose and identifiers, per character and for
  the value's end; a delimiter that the dialect leaves in a value costs what such
  characters cost in this column;
* for each quote that the dialect leaves as text what these cost in this column, every
  time anew, as quoting belongs to the writing of a field and not to its values;
* the dialect: for each delimiter class that the text holds, and for its quotes,
  whether they divide (enclose) or are text.

Both kinds of cost of delimiters are learned per column, as minus log2 of how
often they are text, in ``ROUNDS`` rounds that choose the cheapest parses and
count anew. So in a column ``Smith, John; Doe, Jane`` whose pairs recur the comma
comes out as text, in one of lists with commas it divides.

The n are counted over all parses of all distinct texts, once per text
(map-side aggregated, by value hash). What is inside quotes or brackets is never
divided; one pair of brackets around the whole field only marks the list.

Scale: texts are made distinct map-side and parsed once, into a table in the
shared folder. Values, sums of parses and decided texts each take a narrow
shuffle; only the rounds' counts, one per column and class, reach the driver. A
text that fills a third of all rows is one row up to the last join, whose row
side adaptive execution may split. A text with d classes of delimiters has up
to 2^d parses, all of which are weighed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from thicket.session import stored

CHAR_BITS, NEW_BITS = 2, 2
#: Rounds in which the bits of dialects are learned.
ROUNDS = 3
#: Texts in which each class is taken to divide, and to be text, before any is seen.
PRIOR = {"div": 2.0, "text": 1.0}
#: Characters without a delimiter or quote as text that a column is taken to have beside its own.
PRIOR_CHARS = 1_000
#: Classes of delimiters; characters of one class are the same delimiter.
DELIMITERS = {
    ",": "comma", ";": "semicolon", "|": "pipe", "\n": "line", "\r": "line", "\t": "tab", " ": "blank", " ": "blank",
    "　": "blank", "，": "wide comma", "；": "wide semicolon", "、": "enumeration comma", "｜": "wide pipe",
}
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉"}
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’"}
_CLOSERS = {c: o for o, c in BRACKETS.items()}
#: What a dialect decides on: each class of delimiters, and quotes.
CLASSES = [*dict.fromkeys(DELIMITERS.values()), "quote"]
_BIT = {c: 1 << i for i, c in enumerate(CLASSES)}
_QUOTE = _BIT["quote"]
_DELIMITER_BIT = {x: _BIT[c] for x, c in DELIMITERS.items()}


def _any_of(*chars: str) -> re.Pattern:
    return re.compile("[" + re.escape("".join(chars)) + "]")


#: The characters that a scan stops at, by whether blanks divide.
_SPECIAL = {blanks: _any_of(*(x for x, c in DELIMITERS.items() if blanks or c != "blank"), *BRACKETS, *_CLOSERS, *QUOTES) for blanks in (True, False)}
_ANY_QUOTE = _any_of(*QUOTES)
#: Ways to write a quote inside quotes.
DOUBLED, BACKSLASH, UNQUOTED = "doubled", "backslash", "unquoted"


def _closing(text: str, at: int, mode: str) -> int:
    """Where the quote opened at ``at`` closes; -1 if it doesn't."""
    q = QUOTES[text[at]]
    i = text.find(q, at + 1)
    while i >= 0:
        if mode == BACKSLASH:
            n = i - 1
            while text[n] == "\\":
                n -= 1
            if (i - n) % 2:
                return i
            i = text.find(q, i + 1)
        elif text[i + 1 : i + 2] == q and q == text[at]:
            i = text.find(q, i + 2)
        else:
            return i
    return -1


def scan(text: str, mode: str, blanks_divide: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]], int]:
    """Top-level (position, bit of the delimiter class), spans in brackets, spans in quotes, and the number of quotes without a partner.

    Brackets and quotes without a partner are text, as are apostrophes within a word.
    """
    plain: set[int] = set()
    while True:
        found, brackets, quotes, loose, stack, pos = [], [], [], 0, [], 0
        for m in _SPECIAL[blanks_divide].finditer(text):
            at = m.start()
            if at < pos:  # inside quotes
                continue
            ch = text[at]
            if ch in _DELIMITER_BIT:
                if not stack:
                    found.append((at, _DELIMITER_BIT[ch]))
            elif ch in QUOTES:
                inside = ch == "'" and at and text[at - 1].isalnum()
                end = -1 if mode == UNQUOTED or inside else _closing(text, at, mode)
                if end < 0:
                    loose += not stack
                else:
                    if not stack:
                        quotes.append((at, end))
                    pos = end + 1
            elif ch in BRACKETS:
                if at not in plain:
                    stack.append(at)
            elif stack and BRACKETS[text[stack[-1]]] == ch:
                start = stack.pop()
                if not stack:
                    brackets.append((start, at))
        if not stack:
            return found, brackets, quotes, loose
        plain.add(stack[0])


def _unquote(item: str, mode: str) -> str:
    if mode == UNQUOTED or len(item) < 2 or _closing(item, 0, mode) != len(item) - 1:
        return item
    q, inner = QUOTES[item[0]], item[1:-1]
    return inner.replace("\\" + q, q) if mode == BACKSLASH else inner.replace(q + q, q) if q == item[0] else inner


class _Scanned:
    """A field under one way of quoting, ready to be divided."""

    def __init__(self, body: str, mode: str, blanks_divide: bool):
        found, brackets, quotes, loose = scan(body, mode, blanks_divide)
        if len(brackets) == 1 and brackets[0] == (0, len(body) - 1):
            body = body[1:-1]
            found, brackets, quotes, loose = scan(body, mode, blanks_divide)
        self.part, self.mode, self.quotes, self.loose, self.found = body, mode, quotes, loose, found
        self.classes = list(dict.fromkeys(c for _, c in found))
        self.all = sum(self.classes)
        self.bare = body == body.strip()

    def divide(self, chosen: int) -> tuple[list[str], list[int], int, int, int]:
        """Values, how many delimiters each holds as text, the quotes left as text, and the classes that divide and that are text as bits."""
        part, quotes, loose, found = self.part, self.quotes, self.loose, self.found
        if not quotes and chosen == self.all:  # nothing is left as text
            items, a = [], 0
            for p, _ in found:
                if item := part[a:p].strip():
                    items.append(item)
                a = p + 1
            if item := part[a:].strip():
                items.append(item)
            items = self._unquoted(items)
            text = _QUOTE if loose else 0
            return items, [0] * len(items), loose, chosen & ~text, text
        if not quotes and not chosen and self.bare:  # everything is
            items = self._unquoted([part])
            return items, [len(found)] * len(items), loose, 0, self.all | _QUOTE if loose else self.all
        cuts = [p for p, c in found if c & chosen]
        items, free, at, near, a, div, text = [], [], 0, 0, 0, chosen, 0
        n_found, n_quotes = len(found), len(quotes)
        for b in (*cuts, len(part)):
            item, n = part[a:b].strip(), 0
            if item:
                start = part.index(item[0], a)
                end = start + len(item)
                while at < n_found and found[at][0] < end:
                    p, c = found[at]
                    if p >= start and not c & chosen:
                        text |= c
                        n += 1
                    at += 1
                while near < n_quotes and quotes[near][1] < end:  # quotes are to enclose a value
                    if quotes[near] == (start, end - 1):
                        div |= _QUOTE
                    else:
                        loose += 2
                    near += 1
            a = b + 1
            if item and item[0] in QUOTES:
                item = _unquote(item, self.mode)
            if item:
                items.append(item)
                free.append(n)
        if loose:
            text |= _QUOTE
        return items, free, loose, div & ~text, text

    def _unquoted(self, items: list[str]) -> list[str]:
        if self.mode == UNQUOTED or not any(x[0] in QUOTES for x in items):
            return items
        return [x for x in (_unquote(x, self.mode) if x[0] in QUOTES else x for x in items) if x]


#: Classes in a text up to which its parses are kept at once; beyond, they are made a second time.
_AT_ONCE = 5


def parses(text: str, blanks_divide: bool) -> Iterator[tuple[int, int, list[str], list[int], int, int, int, int]]:
    """Distinct parses of a field.

    (how many classes are text, bits of the escape, values, delimiters left in each, quotes left, dividing classes, classes left as text, number of parses).

    The first leaves the fewest classes as text. Blank texts have one parse without values.
    """
    if not (body := text.strip()):
        yield 0, 0, [], [], 0, 0, 0, 1
        return
    if not _SPECIAL[True].search(body):
        yield 0, 0, [body], [0], 0, 0, 0, 1
        return
    modes = [DOUBLED] + [BACKSLASH] * ("\\" in body) + [UNQUOTED] * bool(_ANY_QUOTE.search(body))
    best: dict[object, tuple] = {}
    for n_mode, mode in enumerate(modes):
        s = _Scanned(body, mode, blanks_divide)
        many = len(s.classes) > _AT_ONCE
        sets = [0]
        for c in s.classes:
            sets += [x | c for x in sets]
        for bits, chosen in enumerate(sets):
            items, free, loose, div, left = s.divide(chosen)
            cost = (left.bit_count(), div.bit_count(), n_mode, bits)
            key = hashlib.md5("\0".join(items).encode("utf-8", "surrogatepass")).digest() if many else tuple(items)
            if key not in best or cost < best[key][0]:
                best[key] = (cost, s, chosen, None if many else (items, free, loose, div, left))
    for cost, s, chosen, made in sorted(best.values(), key=lambda x: x[0]):
        items, free, loose, div, left = made or s.divide(chosen)
        yield cost[0], 2 * (s.mode == BACKSLASH), items, free, loose, div, left, len(best)


_PARSED = "field int, k1 long, k2 int, parse int, n_parses int, div int, text int, bits int, loose int, items array<string>, free array<int>, fresh array<string>"
#: Characters of values after which a batch is sent.
_BATCH_CHARS = 4_000_000


def _parser(blanks: Sequence[bool]):
    kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 7]
    names = [x.split()[0] for x in _PARSED.split(", ")]

    def lists(ends: list[int], values: list, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, all_items, all_free, all_fresh, chars = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            cols = [*zip(*rows)] or [()] * (len(kinds) + 2)
            made = [pa.array(c, k) for c, k in zip(cols, kinds)]
            made += [lists(cols[-2], all_items, pa.string()), lists(cols[-2], all_free, pa.int32()), lists(cols[-1], all_fresh, pa.string())]
            for x in (rows, all_items, all_free, all_fresh):
                x.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for field, k1, k2, text in zip(*(cols[c] for c in ("field", "k1", "k2", "text"))):
                seen: dict[str, None] = {}
                for i, (_, bits, items, free, loose, div, left, n) in enumerate(parses(text, blanks[field])):
                    if items or n > 1:
                        all_items += items
                        all_free += free
                        all_fresh += [x for x in dict.fromkeys(items) if x not in seen] if seen else dict.fromkeys(items)
                        if i + 1 < n:
                            seen |= dict.fromkeys(items)
                        rows.append((field, k1, k2, i, n, div, left, bits, loose, len(all_items), len(all_fresh)))
                        chars += len(text) + 50
                        if chars > _BATCH_CHARS:
                            yield flush()
                            chars = 0
        yield flush()

    return run


def split_packed(fields: Sequence[tuple[DataFrame, str, str, str, bool]]) -> DataFrame:
    """Rows (table_name, column_name, row_id, pos, item) of packed fields.

    ``fields`` lists (table, its name, id column, column, whether blanks divide).
    ``pos`` counts the non-empty values of a field from 1. Null and blank fields
    and empty lists give no row; unbalanced quotes and brackets are text; rows
    with equal or null ids are each split; other columns may have any name.
    Runs a few actions: the parses, the weights of those that are not alone and the
    decided texts are written to the shared folder.
    """
    frames = []
    for i, (df, _, row_id, column, _) in enumerate(fields):
        c = F.col(f"`{column}`")
        frames.append(
            df.where(c.isNotNull() & (F.trim(c) != "")).select(
                F.lit(i).alias("field"), F.col(f"`{row_id}`").cast("long").alias("row_id"), F.xxhash64(F.lit(i), c).alias("k1"), F.hash(c).alias("k2"), c.alias("text")
            )
        )
    rows = reduce(DataFrame.unionByName, frames)
    keys = F.xxhash64("field", "text").alias("k1"), F.hash("text").alias("k2")
    texts = rows.select("field", "text").distinct().select("field", *keys, "text")
    parsed = stored(texts.mapInArrow(_parser([f[4] for f in fields]), _PARSED))
    chosen = cheapest(parsed, len(fields))
    alone = parsed.where("n_parses = 1").select("k1", "k2", "items")
    won = parsed.where("n_parses > 1").join(chosen, ["k1", "k2", "parse"], "left_semi").select("k1", "k2", "items")
    decided = stored(alone.unionByName(won))
    names = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for _, t, _, c, _ in fields])
    return (
        rows.drop("text")
        .join(decided, ["k1", "k2"])
        .select(F.element_at(names, F.col("field") + 1).alias("n"), "row_id", F.posexplode("items").alias("i", "item"))
        .select(F.col("n.t").alias("table_name"), F.col("n.c").alias("column_name"), "row_id", (F.col("i") + 1).alias("pos"), "item")
    )


def _value(field: Column, item: Column) -> Column:
    return F.xxhash64(field, item)


def _per_field(values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("field") + 1)


def weights(parsed: DataFrame, places: dict[int, int], n_fields: int) -> DataFrame:
    """(k1, k2, field, parses: array of parse, div, text, bits, free, loose) of the texts that allow several parses.

    The bits leave out the dialect, the ``free`` delimiters, those that are text, each counted by the share of a spelling that it takes, and the ``loose`` quotes.
    """
    each = parsed.select("field", F.explode("fresh").alias("item"))
    counts = each.groupBy("field", _value(F.col("field"), F.col("item")).alias("v")).agg(F.count(F.lit(1)).alias("n")).drop("field")
    own = ["k1", "k2", "field", "parse", "div", "text", "bits", "loose"]
    several = parsed.where("n_parses > 1").select(*own, F.explode_outer(F.arrays_zip("items", "free")).alias("x"))
    spelled = F.lit(CHAR_BITS) * (F.length("x.items") + F.lit(1) - F.col("x.free"))
    several = several.select(*own, spelled.alias("spelled"), F.col("x.free").alias("free"), _value(F.col("field"), F.col("x.items")).alias("v"))
    whole = _per_field([log2(max(2, places.get(i, 0))) for i in range(n_fields)])
    named, new = F.greatest(whole - F.log2("n"), F.lit(0.0)) + F.col("spelled") / F.col("n"), F.lit(NEW_BITS) + F.col("spelled")
    known = (F.col("n") > 1) & (named <= new)
    return (
        several.join(counts, "v", "left")
        .repartition("k1", "k2", "field")  # one shuffle for both groupings
        .groupBy(*own)
        .agg(F.coalesce(F.sum(F.when(known, named).otherwise(new)), F.lit(0.0)).alias("values"), F.coalesce(F.sum(F.when(known, F.col("free") / F.col("n")).otherwise(F.col("free"))), F.lit(0.0)).alias("free"))
        .groupBy("k1", "k2", "field")
        .agg(F.collect_list(F.struct("parse", "div", "text", (F.col("bits") + F.col("values")).alias("bits"), "free", "loose")).alias("parses"))
    )


def _sums(bits: dict[tuple[int, int, str], float], how: str, classes: range, n_fields: int) -> Column:
    """Per field, the bits of every set of ``classes``, at the set's place."""
    each = [[bits[i, c, how] for c in classes] for i in range(n_fields)]
    sums = [[sum(x for b, x in enumerate(own) if chosen >> b & 1) for chosen in range(2 ** len(classes))] for own in each]
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in own) + ")" for own in sums) + ")")


#: Classes whose sets are looked up at once.
_AT_A_TIME = 6


def _winner(bits: dict[tuple[int, int, str], float], free: list[float], loose: list[float], n_fields: int) -> Column:
    """The cheapest of ``parses`` with the bits of (field, class, how), of free delimiters and of loose quotes; ties go to the first parse.

    Sets of classes are looked up, as the rounds weigh every parse anew.
    """
    parts = [(how, at, _sums(bits, how, range(at, min(at + _AT_A_TIME, len(CLASSES))), n_fields)) for how in PRIOR for at in range(0, len(CLASSES), _AT_A_TIME)]
    delimiter, quote = _per_field(free), _per_field(loose)

    def whole(p: Column) -> Column:
        own = [F.get(F.get(sums, F.col("field")), F.shiftright(p[how], at).bitwiseAND(F.lit(2**_AT_A_TIME - 1))) for how, at, sums in parts]
        cost = reduce(Column.__add__, own, p["bits"] + p["free"] * delimiter + p["loose"] * quote)
        return F.struct(F.round(cost, 6).alias("bits"), p["parse"].alias("parse"), p["div"].alias("div"), p["text"].alias("text"))

    return F.array_min(F.transform("parses", whole))


def cheapest(parsed: DataFrame, n_fields: int) -> DataFrame:
    """(k1, k2, parse) of least code length for every text that allows several parses."""
    chars = F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x))
    size = parsed.where("parse = 0").groupBy("field").agg(F.sum(F.size("items")).alias("places"), F.sum(chars).alias("chars")).collect()
    weighed = stored(weights(parsed, {r.field: r.places for r in size}, n_fields))

    def learned(n: dict[tuple[int, int, str], int]) -> tuple[dict[tuple[int, int, str], float], list[float], list[float]]:
        seen = {k: n.get(k, 0) + PRIOR[k[2]] for k in ((i, c, how) for i in range(n_fields) for c in range(len(CLASSES)) for how in PRIOR)}
        bits = {(i, c, how): -log2(v / (seen[i, c, "div"] + seen[i, c, "text"])) for (i, c, how), v in seen.items()}
        free, loose, quote = [1.0] * n_fields, [1.0] * n_fields, len(CLASSES) - 1
        for r in size:
            quotes = n.get((r.field, quote, "text"), 0)
            others = sum(v for (i, c, how), v in n.items() if i == r.field and how == "text" and c != quote)
            free[r.field], loose[r.field] = (max(1.0, log2((PRIOR_CHARS + r.chars) / (0.5 + x))) for x in (others, quotes))
        return bits, free, loose

    costs, before = learned({}), None
    for _ in range(ROUNDS):
        won = weighed.select("field", _winner(*costs, n_fields).alias("w")).groupBy("field", "w.div", "w.text").agg(F.count(F.lit(1)).alias("n"))
        told = [F.when(F.getbit(F.col(how), F.lit(c)) == 1, F.struct(F.lit(c).alias("c"), F.lit(how).alias("how"))) for how in PRIOR for c in range(len(CLASSES))]
        rows = won.select("field", "n", F.explode(F.array_compact(F.array(*told))).alias("t")).groupBy("field", "t.c", "t.how").agg(F.sum("n").alias("count")).collect()
        now = {(r["field"], r["c"], r["how"]): r["count"] for r in rows}
        if now == before:
            break
        costs, before = learned(now), now
    parse = F.coalesce(_winner(*costs, n_fields)["parse"], F.lit(0))  # never null; else joins would weigh a second time to find out
    return weighed.select("k1", "k2", parse.alias("parse"))
