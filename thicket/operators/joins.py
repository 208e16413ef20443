"""Joins the DataFrame API has no name for: containment, template, as-of, first-match and priority lookups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from thicket.functions.predicates import path_matches
from thicket.session import stored

GRAM = 3


def first_rule(c: Column, rules: Sequence[tuple[str, str]], how: str = "prefix") -> Column:
    """Value of the first rule (pattern, value) that ``c`` starts (ends) with; null if none. No join at all."""
    test = {"prefix": lambda p: c.startswith(p), "suffix": lambda p: c.endswith(p), "contains": lambda p: c.contains(p)}[how]
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(test(pattern), F.lit(value)).otherwise(out)
    return out


#: Characters of all needles together up to which they are sent to the executors as one automaton.
AUTOMATON_CHARS = 4_000_000


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Rows of ``texts`` with every needle that the text contains anywhere; exact, without a nested loop.

    The needles are measured first. Up to ``automaton_chars`` they go to the
    executors as one automaton, and each text is read once, without a shuffle of texts. Beyond
    it, every needle is keyed by the rarest of its ``GRAM``-character pieces, counted over the texts, and meets
    in an equi-join the texts that hold this piece; containment is verified there. Null and empty texts or needles match nothing;
    columns of both sides must have different names.
    """
    n = F.col(needle)
    whole = needles.where(F.length(n) > 0)
    size = whole.agg(F.sum(F.length(n))).first()[0] or 0
    return _by_automaton(texts, text, whole, needle) if size <= automaton_chars else _by_grams(texts, text, whole, needle)


def _by_automaton(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    spark = texts.sparkSession
    words = spark.sparkContext.broadcast([r[0] for r in needles.select(needle).distinct().collect()])

    @F.pandas_udf("array<string>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        if words.value:
            automaton.make_automaton()
        for part in parts:
            yield part.map(lambda t: list({w for _, w in automaton.iter(t)}) if t and words.value else [])

    held = texts.withColumn("__w", F.explode(found(F.col(text))))
    # as many rows as the measured needles
    return held.join(F.broadcast(needles.withColumn("__w", F.col(needle))), "__w").drop("__w")


def _by_grams(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    t, n = F.col(text), F.col(needle)

    def grams(c: Column, least: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c))
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[c.substr(i, F.lit(k)) for k in range(least, GRAM + 1)]))))

    held = texts.where(F.length(t) > 0).withColumn("__g", F.explode(grams(t, 1)))
    own = F.filter(grams(n, 1), lambda g: F.length(g) == F.least(F.length(n), F.lit(GRAM)))
    pieces = needles.select(n.alias("__n"), F.explode(own).alias("__g")).distinct()
    counts = held.groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    # a piece that no text holds is the rarest of all: its needle is nowhere
    rarest = pieces.join(counts, "__g", "left").groupBy("__n").agg(F.min_by("__g", F.struct(F.coalesce("__c", F.lit(0)), "__g")).alias("__g"))
    keyed = needles.join(rarest.withColumnRenamed("__n", needle), needle)
    return held.join(keyed, "__g").where(F.contains(t, n)).drop("__g")


def template_join(requests: DataFrame, path: str, templates: DataFrame, template: str, on: Sequence[str] = ()) -> DataFrame:
    """Requests with the templates their path fits.

    Every template is keyed by its number of segments and the one of its literal segments that the fewest templates share at
    that place; distinct paths meet it there, by each of their segments, and what fits is joined back to the requests.
    Templates of nothing but variables meet all paths of their length, which they fit. Null paths fit nothing.
    """
    on = list(on)
    seg = lambda c: F.split(F.col(c), "/")
    spot = lambda i, s: F.struct(i.alias("i"), s.alias("s"))
    none = spot(F.lit(-1), F.lit(""))
    t = templates.select(*on, F.col(template).alias("__t")).where("__t is not null").distinct().withColumn("__n", F.size(seg("__t")))
    literal = F.filter(F.transform(seg("__t"), lambda s, i: spot(i, s)), lambda x: ~x["s"].startswith("{"))
    spots = t.select(*on, "__t", "__n", F.explode(F.when(F.size(literal) > 0, literal).otherwise(F.array(none))).alias("__k"))
    shared = spots.groupBy(*on, "__n", "__k").agg(F.count(F.lit(1)).alias("__c"))
    keyed = spots.join(shared, [*on, "__n", "__k"]).groupBy(*on, "__t", "__n").agg(F.min_by("__k", F.struct("__c", "__k")).alias("__k"))
    p = requests.select(*on, F.col(path).alias("__p")).where("__p is not null").distinct().withColumn("__n", F.size(seg("__p")))
    places = p.withColumn("__k", F.explode(F.array_append(F.transform(seg("__p"), lambda s, i: spot(i, s)), none)))
    fits = places.join(keyed, [*on, "__n", "__k"]).where(path_matches(F.col("__p"), F.col("__t"))).select(*on, "__p", "__t")
    found = fits.join(templates.withColumn("__t", F.col(template)), [*on, "__t"])
    return requests.withColumn("__p", F.col(path)).join(found, [*on, "__p"]).drop("__p", "__t")


def literal_segments(template: Column) -> Column:
    """How many segments of a template are no variables."""
    return F.size(F.filter(F.split(template, "/"), lambda s: ~s.startswith("{")))


def priority_lookup(df: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str], str]], out: str) -> DataFrame:
    """``df`` with ``out`` = the value of the first level that knows the row.

    A level is (table, key columns, value column); its key must be unique, and
    the key columns must bear the names they have in ``df``.
    """
    found = []
    for i, (side, keys, value) in enumerate(levels):
        name = f"__p{i}"
        df = df.join(side.select(*keys, F.col(value).alias(name)), list(keys), "left")
        found.append(F.col(name))
    return df.withColumn(out, F.coalesce(*found)).drop(*[f"__p{i}" for i in range(len(levels))])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], tie: str, partitions: int | None = None) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before its time.

    Both sides have the columns ``keys`` and ``at``; ``tie`` orders right rows of one instant (the greatest wins). Rows of
    both sides are range-partitioned on (keys, time) by sampled quantiles, written to the shared folder with the number of their range,
    and what holds when a range begins is carried over from the aggregated ranges before; so a hot key's rows are spread over as many
    ranges as they fill. Null times or keys find nothing.
    """
    v = F.struct(*[F.col(c) for c in values])
    r = right.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*keys, at]])).select(*keys, at, v.alias("__v"), F.col(tie).alias("__tie"), F.lit(0).alias("__side"))
    others = [c for c in left.columns if c not in (*keys, at)]
    rows = r.unionByName(left.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    order = [*keys, at, "__side", "__tie"]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    rows = stored(ranged.withColumn("__b", F.spark_partition_id()))
    per = Window.partitionBy(*keys).orderBy("__b")  # one row for each range that a key reaches into
    last = rows.where("__side = 0").groupBy(*keys, "__b").agg(F.max_by("__v", F.struct(at, "__tie")).alias("__last"))
    both = last.unionByName(rows.select(*keys, "__b").distinct(), allowMissingColumns=True)
    carry = both.groupBy(*keys, "__b").agg(F.max("__last").alias("__last"))
    carry = carry.select(*keys, "__b", F.last("__last", ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.col(at), F.col("__side"), F.col("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("__own", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    same = reduce(Column.__and__, [F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*keys, "__b"]])
    full = held.alias("h").join(carry.alias("c"), same, "left").withColumn("__got", F.coalesce("h.__own", "c.__carry"))
    known = reduce(Column.__and__, [F.col(f"h.{c}").isNotNull() for c in [*keys, at]])
    return full.select(*[F.col(f"h.{c}").alias(c) for c in [*keys, at, *others]], *[F.when(known, F.col(f"__got.{c}")).alias(c) for c in values])
