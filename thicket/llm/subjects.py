"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

Training takes a bounded, hash-ordered sample (``Bounds``) of documents with hand
labels and of others. Weak labels come from address paths, parameter lines and
section headings: an n-gram there votes for the subject whose name or scope note
alone holds it, and for the one that hand labels tie it to. So without any hand label
the weak ones teach alone. Log odds of n-grams then spread the labels over the sample in
a few rounds, always from documents with one clear subject or none, and logistic
regressions are fitted on the outcome. The weights are non-negative, so a document's
score for a subject is the evidence it holds for it, and shares of evidence tell one
subject, two in about equal part, and passing mentions apart.

All documents are then scored in one pass without a shuffle, whole texts, with a model
of fixed size; their scores are written to the shared folder. Thresholds, one pair for
each subject, are calibrated on a quarter of the hand labels, as weights fitted on the
others see them (the weights in use are fitted on all), and, among settings that these cannot tell apart, where the scores of all documents, counted
in the cluster, are sparsest.

N-grams of the sample are counted in the cluster; only those that enough documents
hold reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from thicket.session import stored

BITS = 22
#: Rounds in which the sample is labelled by the evidence found so far.
ROUNDS = 4
SPACE = 1 << BITS
_UP, _LOW, _CJK = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ", "㐀-䶿一-鿿豈-﫿"
#: Words and parts of compound identifiers of two letters or more, and single CJK characters.
WORD = re.compile(f"[{_UP}][{_LOW}]+|[{_LOW}]{{2,}}|[{_UP}]{{2,}}(?![{_LOW}])|[{_CJK}]")
CJK = re.compile(f"[{_CJK}]")
#: Lines that name what the code serves: addresses, parameters, headings.
METADATA = re.compile(r"^(?:(?:GET|POST|PUT|DELETE|PATCH|HEAD|ALL) +(/\S*)|[Pp]arameters: *(.*)|#{1,6} +(.*))$", re.M)


@dataclass(frozen=True)
class Bounds:
    """Largest numbers of documents a model is fitted on: with hand labels, and others (weak labels, or none). Thresholds come from all."""

    labelled: int = 3_000
    unlabelled: int = 3_000


#: One in so many hand-labelled documents, by hash, is held out of training and calibrates the thresholds.
HELD_OUT = 4
#: Documents of the sample that must hold an n-gram for it to count.
LEAST = 3


class _Hashes(dict):
    """Word -> 32-bit hash, kept while it is small."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = h
        return h


_hashes = _Hashes()
#: Marks the ends of texts put together; no n-gram reaches across it.
_END = -1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(SPACE - 1)).astype("int64")


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed n-gram) of every occurrence, and the words of each document.

    Words and pairs of words; runs of CJK characters, which have no blanks, give
    pairs and triples of characters.
    """
    words, cjk, length = [], [], np.zeros(len(texts), "int64")
    find, code = WORD.findall, _hashes.__getitem__
    for i, t in enumerate(texts):
        w = find(t)
        length[i] = len(w)
        words.append(np.fromiter(map(code, w), "uint64", len(w)))
        cjk.append(bool(w) and CJK.search(t) is not None)
    if not length.sum():
        return np.zeros(0, "int64"), np.zeros(0, "int64"), length
    h = np.concatenate(words)
    doc = np.repeat(np.arange(len(texts)), length)
    p = np.uint64(0x9E3779B97F4A7C15)
    two = (h[:-1] * p + h[1:]) * p
    ok2 = doc[:-1] == doc[1:]
    docs, grams = [doc, doc[:-1][ok2]], [_mix(h * p), _mix(two[ok2] + np.uint64(1))]
    wide = np.repeat(np.asarray(cjk), length)
    if wide.any() and len(h) > 2:
        three = ((h[:-2] * p + h[1:-1]) * p + h[2:]) * p
        ok3 = (doc[:-2] == doc[2:]) & wide[:-2]
        docs.append(doc[:-2][ok3])
        grams.append(_mix(three[ok3] + np.uint64(2)))
    return np.concatenate(docs), np.concatenate(grams), length


def word_grams(text: str) -> set[int]:
    """The hashed n-grams of the single words of a text."""
    return {int(_mix(np.array([_hashes[w]], "uint64") * np.uint64(0x9E3779B97F4A7C15))[0]) for w in WORD.findall(text)}


def metadata(text: str) -> str:
    """The text's addresses, parameter names and headings, one per line."""
    return "\n".join(next(filter(None, m.groups()), "") for m in METADATA.finditer(text))


def _counted(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    doc, gram, length = ngrams(texts)
    key, n = np.unique(doc * SPACE + gram, return_counts=True)
    cut = np.searchsorted(key // SPACE, np.arange(1, len(texts)))
    return np.split((key % SPACE).astype("int32"), cut), np.split(n.astype("int32"), cut), length


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 512):
            part = pdf.iloc[at : at + 512]
            texts = part["text"].fillna("").tolist()
            grams, n, length = _counted(texts)
            meta, _, _ = _counted([metadata(t) for t in texts])
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "grams": grams, "n": n, "words": length, "meta": meta})


class Sparse:
    """Documents x features with sums by row and by column."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        order = np.lexsort((col, row))
        self.row, self.col, self.val, self.shape = row[order], col[order], val[order].astype("float32"), shape
        self.by_col = np.argsort(self.col, kind="stable")

    @staticmethod
    def _sums(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, values.shape[1]), "float32")
        if len(key):
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            out[key[at]] = np.add.reduceat(values, at, axis=0)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.row, w[self.col] * self.val[:, None], self.shape[0])

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        o = self.by_col
        return self._sums(self.col[o], r[self.row[o]] * self.val[o, None], self.shape[1])


def fit_linear(x: Sparse, y: np.ndarray, penalty: float = 2e-4, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative one-versus-rest logistic regressions with an L1 penalty (accelerated projected gradient); (weights, biases)."""
    n, k = y.shape
    w = np.zeros((x.shape[1], k), "float32")
    b = np.full(k, -2.0, "float32")
    v, c, t = w.copy(), b.copy(), 1.0
    sq = np.bincount(x.row, weights=x.val.astype("float64") ** 2, minlength=n)
    step = 4.0 / (1.0 + float(np.quantile(sq, 0.98)))
    for _ in range(rounds):
        r = (1.0 / (1.0 + np.exp(-(x.dot(v) + c))) - y) / np.float32(n)
        new_w = np.maximum(v - np.float32(step * k) * (x.t_dot(r) + np.float32(penalty / k)), 0)
        new_b = c - np.float32(step * k) * r.sum(0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new_w + np.float32((t - 1) / t_next) * (new_w - w), new_b + np.float32((t - 1) / t_next) * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


@dataclass
class Model:
    """Weights of the n-grams that carry evidence; ``slot`` maps a hashed n-gram to its row (0: none).

    A text is about a subject that has ``min_share`` of its evidence and where that is ``min_evidence`` per word or more,
    both given for each subject.
    """

    subjects: list[str]
    slot: np.ndarray
    weights: np.ndarray
    min_evidence: np.ndarray
    min_share: np.ndarray

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Evidence per word for each subject, documents x subjects."""
        out = np.zeros((len(texts), len(self.subjects)))
        doc, gram, length = ngrams(texts)
        s = self.slot[gram]
        hit = s > 0
        d, s = doc[hit], s[hit]
        if len(d):
            for j in range(out.shape[1]):
                out[:, j] = np.bincount(d, weights=self.weights[s, j], minlength=len(texts))
        return out / np.maximum(length, 1)[:, None]


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(23), doc_id), F.lit(HELD_OUT)) == 0


def _sample(documents: DataFrame, labels: DataFrame, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """Hashed counts of the sampled documents, n-grams that fewer than ``LEAST`` of them hold left out, and the labels of the labelled ones."""
    mixed = F.xxhash64(F.lit(11), "doc_id")
    hand = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(mixed, "doc_id").limit(bounds.labelled)
    others = documents.where("doc_id is not null").select("doc_id").orderBy(mixed, "doc_id").limit(bounds.unlabelled)
    wanted = hand.unionByName(others).distinct()
    docs = documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    schema = "doc_id long, grams array<int>, n array<int>, words long, meta array<int>"
    feats = stored(docs.mapInPandas(_features, schema))
    common = feats.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    kept = np.sort(common.select("g").toPandas()["g"].to_numpy("int32"))
    shared = documents.sparkSession.sparkContext.broadcast(kept)

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def among(g: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(shared.value, g), max(0, len(shared.value) - 1))
            return shared.value[at] == g if len(shared.value) else np.zeros(len(g), bool)

        for pdf in batches:
            rows = []
            for g, n, meta in zip(pdf["grams"], pdf["n"], pdf["meta"]):
                own = among(np.asarray(g))
                rows.append((np.asarray(g)[own], np.asarray(n)[own], np.asarray(meta)[among(np.asarray(meta))]))
            yield pdf.assign(**{c: pd.Series([r[i] for r in rows], index=pdf.index, dtype=object) for i, c in enumerate(("grams", "n", "meta"))})

    return feats.mapInPandas(thin, schema), labels.join(hand, "doc_id", "left_semi").withColumn("held", _held_out(F.col("doc_id")))


def _purity(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per feature (0..width-1): documents that hold it, and the smoothed share of each subject among them."""
    df = np.bincount(col, minlength=width)
    share = np.zeros((width, y.shape[1]), "float32")
    base = y.mean(0)
    for j in range(y.shape[1]):
        share[:, j] = (np.bincount(col, weights=y[row, j], minlength=width) + base[j]) / (df + 1)
    return df, share


SCALE = 30.0
#: Standard errors by which log odds are lowered.
CAUTION = 1.5
#: Loss of F1 on the held-out labels within which settings count as equal.
TOLERANCE = 0.006
#: Least share of one subject among the documents that hold an n-gram, for it to enter the regressions.
PURE = 0.7


def _compete(w: np.ndarray) -> np.ndarray:
    """Leave each n-gram only the lead of its first subject over its second, so that shared words carry little."""
    order = np.sort(w, axis=1)
    second = order[:, -2] if w.shape[1] > 1 else np.zeros(len(w), w.dtype)
    return np.maximum(w - second[:, None], 0)


def log_odds(row, col, y: np.ndarray, width: int, least: int = LEAST) -> np.ndarray:
    """Non-negative one-versus-rest log odds of each n-gram from document counts, features x subjects.

    Odds count at the lower end of their uncertainty, so that chance among few documents carries nothing.
    N-grams in fewer than ``least`` or in more than half of the documents carry nothing.
    """
    df = np.bincount(col, minlength=width)
    n = y.sum(0)
    w = np.zeros((width, y.shape[1]), "float32")
    for j in range(y.shape[1]):
        own = np.bincount(col, weights=y[row, j], minlength=width)
        p = (own + 0.5 * n[j] / len(y)) / (n[j] + 1)
        q = (df - own + 0.5) / (len(y) - n[j] + 1)
        spread = np.sqrt(1 / (own + 0.5) + 1 / (df - own + 0.5))
        with np.errstate(divide="ignore"):  # a subject without documents carries nothing
            w[:, j] = np.log(p / q) - CAUTION * spread
    w[w < 1.0] = 0
    w[(df < least) | (df > 0.5 * len(y))] = 0
    return _compete(w)


def _scores(row, col, val, w, n_docs) -> np.ndarray:
    live = w.max(1) > 0
    hit = live[col]
    r, c, v = row[hit], col[hit], val[hit]
    return np.stack([np.bincount(r, weights=v * w[c, j], minlength=n_docs) for j in range(w.shape[1])], 1)


def _fit(row, col, val, y: np.ndarray, n_docs: int, width: int, least: int = LEAST) -> np.ndarray:
    """Regressions over the n-grams that lean to a subject; weights, features x subjects."""
    df, share = _purity(row, col, y, width)
    chosen = np.flatnonzero((df >= least) & (df <= 0.5 * n_docs) & (share.max(1) >= PURE))
    slot = np.full(width, -1)
    if not len(chosen):
        return np.zeros((width, y.shape[1]), "float32")
    slot[chosen] = np.arange(len(chosen))
    keep = slot[col] >= 0
    part, _ = fit_linear(Sparse(row[keep], slot[col[keep]], val[keep], (n_docs, len(chosen))), y.astype("float32"))
    w = np.zeros((width, y.shape[1]), "float32")
    w[chosen] = _compete(part)
    w[w < 0.02 * max(1e-9, float(w.max()))] = 0
    return w


@dataclass
class HeldOut:
    """Labelled documents as weights saw them that were not fitted on their labels.

    ``total``: evidence as a multiple of the sample's median, ``part``: shares of the subjects, ``y``: shares of labellers.
    """

    total: np.ndarray
    part: np.ndarray
    y: np.ndarray


class _Sample:
    """Counts of the sampled documents, ready to learn from."""

    def __init__(self, rows: pd.DataFrame, scope: list[str]):
        self.n, self.k = len(rows), len(scope)
        size = rows["grams"].map(len).to_numpy("int64")
        self.row = np.repeat(np.arange(self.n), size)
        self.grams, self.col = np.unique(np.concatenate(rows["grams"].to_list()).astype("int64"), return_inverse=True)
        self.width = len(self.grams)
        self.val = np.concatenate(rows["n"].to_list()) * SCALE / np.maximum(rows["words"].to_numpy("float64"), 1)[self.row]
        self.mrow = np.repeat(np.arange(self.n), rows["meta"].map(len).to_numpy("int64"))
        meta = np.concatenate(rows["meta"].to_list()).astype("int64")
        self.mcol = np.minimum(np.searchsorted(self.grams, meta), self.width - 1)
        self.mknown = self.grams[self.mcol] == meta
        # words that the scope of one subject alone holds
        self.scope = np.zeros((self.width, self.k), "float32")
        df, own = np.bincount(self.col, minlength=self.width), [word_grams(s) for s in scope]
        for j in range(self.k):
            for g in own[j] - set().union(*(o for i, o in enumerate(own) if i != j)):
                c = int(np.searchsorted(self.grams, g))
                if c < self.width and self.grams[c] == g and df[c] <= max(SCOPE_SPREAD, 1 / self.k) * self.n:
                    self.scope[c, j] = 1

    def votes(self, y: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Documents x subjects: n-grams of addresses and headings that scopes, or the labels ``y`` of the ``seen``, point to."""
        points, hand = self.scope.copy(), seen[self.row]
        df, share = _purity(self.row[hand], self.col[hand], np.where(seen[:, None], y, 0), self.width)
        tied = (df >= LEAST) & (share.max(1) >= 0.6)
        points[tied] = share[tied]
        use = self.mknown & (points[self.mcol].max(1) > 0)
        out = np.zeros((self.n, self.k))
        np.add.at(out, (self.mrow[use], points[self.mcol[use]].argmax(1)), 1)
        return out

    def learn(self, y: np.ndarray, seen: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """Weights, n-grams x subjects, from the labels of the ``seen`` and the weak ones of the others."""
        row, col, n, k = self.row, self.col, self.n, self.k
        weak = np.where(seen[:, None], 0, votes)
        teach = seen | (weak.sum(1) > 0)
        now = np.where(seen[:, None], y, weak / np.maximum(weak.sum(1, keepdims=True), 1))
        clear = seen & (y.max(1) > 0.5)
        for _ in range(ROUNDS):
            index, t = np.cumsum(teach) - 1, teach[row]
            w = log_odds(index[row[t]], col[t], now[teach], self.width)
            total, part = self.shares(w)
            floor = 0.25 * np.median(total[clear]) if clear.any() else 0.0
            none, one = total < 0.25 * floor, (part.max(1) >= 0.7) & (total >= floor)
            teach, now = none | one | seen, np.where(one[:, None], part >= 0.7, False).astype("float64")
            now[seen] = np.where(one[seen, None], (now[seen] + y[seen]) / 2, y[seen])  # labels hold the subjects in place
        two = (np.sort(part, 1)[:, -2:].min(1) >= 0.3) & (total >= floor) if k > 1 else np.zeros(n, bool)
        now[two] = part[two] >= 0.3
        teach = none | one | two
        now[~one & ~two] = 0
        if not teach.any():
            return np.zeros((self.width, k), "float32")
        index, t = np.cumsum(teach) - 1, teach[row]
        return _fit(index[row[t]], col[t], self.val[t], now[teach], int(teach.sum()), self.width)

    def shares(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of each document, and the subjects' shares of it."""
        score = _scores(self.row, self.col, self.val, w, self.n)
        total = score.sum(1)
        return total, score / np.maximum(total, 1e-12)[:, None]


def _hand_labels(labels: DataFrame, at: dict[int, int], known: dict[str, int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of each document's labellers who named each subject, whether it was labelled, and whether it is held out."""
    hand = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject"), F.coalesce("labeller", F.lit("")).alias("labeller"), "held").toPandas()
    y, raters, held = np.zeros((n, len(known))), np.zeros(n), np.zeros(n, bool)
    for (doc, _), g in hand.groupby(["doc_id", "labeller"], sort=False):
        named = {s for s in g["subject"] if isinstance(s, str)}
        if doc in at and (not named or named & known.keys()):
            raters[at[doc]] += 1
            held[at[doc]] = g["held"].iloc[0]
            for s in named & known.keys():
                y[at[doc], known[s]] += 1
    y[raters > 0] /= raters[raters > 0, None]
    return y, raters > 0, held & (raters > 0)


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, bounds: Bounds = Bounds()) -> tuple[Model, HeldOut]:
    """Fit the weights; gives the model, whose thresholds are still open, and what to calibrate them on.

    The weights are fitted twice: without the labels of the held-out documents, to see how these score then, and with all.
    """
    told = subjects.where("subject is not null")
    note = F.col("scope_note") if "scope_note" in subjects.columns else F.lit("")
    scope = {r.subject: f"{r.subject} {r.note or ''}" for r in told.select("subject", note.alias("note")).distinct().collect()}
    names = sorted(scope)
    k = len(names)
    empty = Model(names, np.zeros(SPACE, "int32"), np.zeros((1, max(1, k)), "float32"), np.ones(k), np.ones(k)), HeldOut(np.zeros(0), np.zeros((0, k)), np.zeros((0, k)))
    if not names:
        return empty
    feats, labs = _sample(documents, labels, bounds)
    rows = feats.toPandas()
    if not len(rows) or not rows["grams"].map(len).sum():
        return empty
    sample = _Sample(rows, [scope[s] for s in names])
    at = {d: i for i, d in enumerate(rows["doc_id"])}
    y, seen, held = _hand_labels(labs, at, {s.strip().lower(): i for i, s in enumerate(names)}, sample.n)
    if not y.sum():  # weak labels alone; every fourth document that they are clear about is held out
        weak = sample.votes(y, np.zeros(sample.n, bool))
        y = weak / np.maximum(weak.sum(1, keepdims=True), 1)
        seen = y.max(1) >= 0.75
        y[~seen] = 0
        held = seen & (np.arange(sample.n) % HELD_OUT == 0)
        if not y.sum():
            return empty

    def learned(known: np.ndarray) -> np.ndarray:
        return sample.learn(np.where(known[:, None], y, 0), known, sample.votes(y, known))

    if y[seen & ~held].sum() and held.any():
        total, part = sample.shares(learned(seen & ~held))
        w = learned(seen)
    else:  # too few labels to hold any out
        w, held = learned(seen), seen
        total, part = sample.shares(w)
    if not (total > 0).any() or not w.any():
        return empty
    live = np.flatnonzero(w.max(1) > 0)
    slot = np.zeros(SPACE, "int32")
    slot[sample.grams[live]] = np.arange(1, len(live) + 1)
    model = Model(names, slot, np.concatenate([np.zeros((1, k), "float32"), w[live]]), np.zeros(k), np.full(k, 0.2))
    return model, HeldOut(total[held] / np.median(total[total > 0]), part[held], y[held])


#: Largest share of the sample's documents that may hold a word of a scope note for it to point to its subject; a subject's even share if that is more.
SCOPE_SPREAD = 0.1
SCORES = "doc_id long, total double, subject array<int>, share array<double>"
#: Least share of the evidence that is kept with a document's scores; no threshold is lower.
LEAST_SHARE = 0.1


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, total evidence per word, subjects by number and their shares of it from ``LEAST_SHARE`` on) of every document with evidence."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                e = m.evidence(part["text"].fillna("").tolist())
                total = e.sum(1)
                live = np.flatnonzero(total > 0)
                shares = e[live] / total[live, None]
                kept = [np.flatnonzero(x >= LEAST_SHARE) for x in shares]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy()[live], "total": total[live],
                    "subject": pd.Series([x.astype("int32") for x in kept], dtype=object), "share": pd.Series([x[i] for x, i in zip(shares, kept)], dtype=object),
                })

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, SCORES)


#: Width of the bins in which scores of all documents are counted: log evidence, and shares.
TOTAL_BIN, SHARE_BIN = 0.05, 0.005


def _sparsest(bins: np.ndarray, counts: np.ndarray, among: np.ndarray, width: float) -> float:
    """The candidate with the fewest values (bins and how many in each) around it; of ties the middle one."""
    order = np.argsort(bins)
    v, upto = bins[order], np.concatenate([[0], np.cumsum(counts[order])])
    near = upto[np.searchsorted(v, among + width)] - upto[np.searchsorted(v, among - width)]
    best = among[near == near.min()]
    return float(best[len(best) // 2])


def _f1(y: np.ndarray, about: np.ndarray) -> float:
    return 2 * float((y * about).sum()) / max(1e-9, float(about.sum() + y.sum()))


def calibrate(model: Model, scored: DataFrame, held: HeldOut) -> None:
    """Set the thresholds of evidence and share of each subject.

    Settings common to all subjects whose F1 over the held-out labels is within ``TOLERANCE`` of the best are equally good by so few and
    partly wrong labels; of them those are taken where the evidence of all documents is sparsest. Each subject then moves from there
    as far as its own labels, one of which may be wrong, and the scores of all documents that hold it second, say; subjects with few labels
    stay close.
    """
    k = len(model.subjects)
    tall = scored.select(F.round(F.log("total") / TOTAL_BIN).cast("int").alias("b")).groupBy("b").count().toPandas()
    if not len(tall):
        return
    total, part, y = held.total, held.part, held.y
    order = np.argsort(tall["b"].to_numpy())
    bins, counts = tall["b"].to_numpy()[order] * TOTAL_BIN, tall["count"].to_numpy()[order]
    bins = bins - bins[np.searchsorted(np.cumsum(counts), counts.sum() / 2)]  # from the median on
    middle = float(np.exp(tall["b"].to_numpy()[order][np.searchsorted(np.cumsum(counts), counts.sum() / 2)] * TOTAL_BIN))
    floors = np.geomspace(0.01, 0.5, 40)
    shares = np.linspace(0.12, 0.36, 25)
    f1 = np.array([[_f1(y, (part >= r) & (total >= a)[:, None]) for r in shares] for a in floors])
    good = f1 >= f1.max() - TOLERANCE
    least = float(np.exp(_sparsest(bins, counts, np.log(floors[good.any(1)]), 0.4)))
    row = good[np.argmin(np.abs(np.where(good.any(1), floors, np.inf) - least))]
    # shares of each subject where another has more, in documents with enough evidence
    high = scored.where(F.col("total") >= least * middle)
    pairs = high.select(F.array_max("share").alias("m"), F.explode(F.arrays_zip("subject", "share")).alias("x")).where("x.share < m")
    low = pairs.select("x.subject", F.round(F.col("x.share") / SHARE_BIN).cast("int").alias("b")).groupBy("subject", "b").count().toPandas()
    lb, lc, ls = low["b"].to_numpy() * SHARE_BIN, low["count"].to_numpy(), low["subject"].to_numpy()
    common = _sparsest(lb, lc, shares[row], 0.03)
    model.min_evidence, model.min_share = np.full(k, least * middle), np.full(k, common)
    for j in range(k):
        n = float(y[:, j].sum())
        near = shares[np.abs(shares - common) <= 0.06 * n / (n + FEW_LABELS) + 1e-9]
        own = np.array([_f1(y[:, j], (part[:, j] >= r) & (total >= least)) for r in near])
        model.min_share[j] = _sparsest(lb[ls == j], lc[ls == j], near[own >= own.max() - 1 / (n + 1)], 0.03)
        close = floors[np.abs(np.log(floors / least)) <= n / (n + FEW_LABELS) + 1e-9]
        if len(close):
            own = np.array([_f1(y[:, j], (part[:, j] >= model.min_share[j]) & (total >= a)) for a in close])
            model.min_evidence[j] = middle * float(np.exp(_sparsest(bins, counts, np.log(close[own >= own.max() - 1 / (n + 1)]), 0.4)))


#: Labels of a subject at which its thresholds may move half as far from the common ones as those with very many.
FEW_LABELS = 40


def decide(scored: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, share) of the subjects whose thresholds the scores reach."""
    if not model.subjects:
        return scored.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share")).where("false")
    limits = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(a)).alias("a"), F.lit(float(r)).alias("r")) for s, a, r in zip(model.subjects, model.min_evidence, model.min_share)])
    one = scored.select("doc_id", "total", F.explode(F.arrays_zip("subject", "share")).alias("x"))
    one = one.select("doc_id", "total", "x.share", F.element_at(limits, F.col("x.subject") + 1).alias("l"))
    return one.where((F.col("share") >= F.col("l.r")) & (F.col("total") >= F.col("l.a"))).select("doc_id", F.col("l.s").alias("subject"), "share")


def _trained(documents: DataFrame, labels: DataFrame, subjects: DataFrame, bounds: Bounds) -> tuple[Model, DataFrame]:
    model, held = fit(documents, labels, subjects, bounds)
    scored = stored(score(documents, model))
    calibrate(model, scored, held)
    return model, scored


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """The classifiers of ``subjects`` (subject, scope_note if there is one) from documents (doc_id, text) and labels (doc_id, subject, labeller).

    Subjects are compared trimmed and in lower case. A label without a subject says that its labeller found none; labels of unknown
    subjects are left out. Without any usable label, by hand or weak, the model finds no subject anywhere.
    """
    return _trained(documents, labels, subjects, bounds)[0]


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, share) for every subject each text is about; texts about none give no row.

    Null, blank and very short texts without evidence have no subject; repeated
    texts get the same subjects each.
    """
    return decide(score(documents, model), model)


def classify(documents: DataFrame, labels: DataFrame, subjects: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """:func:`assign` of the very documents that :func:`train` takes, scored once."""
    model, scored = _trained(documents, labels, subjects, bounds)
    return decide(scored, model)
