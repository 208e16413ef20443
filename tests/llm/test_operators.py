"""Percentile digests, packing, mixing and subjects: bounds, exactness and edge cases."""

from __future__ import annotations

import math
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from thicket.llm import mixing, packing, quantiles as q, queries, subjects, tokens

# --- queries -----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, name):
    missing, extra, _ = oracle.compare(spark, data, name, queries.QUERIES[name], queries.SQL[name])
    assert not missing and not extra


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0


# --- percentiles -------------------------------------------------------------------------


def test_buckets_are_ordered_and_narrow(spark):
    values = sorted({0, 1, 126, 127, 128, 129, 255, 256, 257, 10**6, 2**40 + 1, 2**53 + 1, 2**61, 2**62, 2**63 - 1, *(random.Random(1).randrange(2**50) for _ in range(500))})
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", q.bucket(F.col("v")).alias("b"))
    rows = df.select("v", "b", q.bucket_high(F.col("b")).alias("high")).orderBy("v").collect()
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:])) and rows[-1].b < q.UNIVERSE and rows[0].b == 0
    for r in rows:
        assert r.high >= min(r.v, q.LARGEST) and r.high - r.v <= r.v / 128


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_merged_digests_keep_the_rank_error(spark, error):
    rng = np.random.default_rng(5)
    parts = [("hot", d, int(v)) for d in range(5) for v in rng.lognormal(6, 2, 4000)] + [("few", d, v) for d in range(3) for v in (5, 5, 9)] + [(None, 0, 7)]
    df = spark.createDataFrame(parts, "k string, day int, v long")
    daily = q.digest(df, ["k", "day"], "v", error)
    assert daily.groupBy("k", "day").count().agg(F.max("count")).first()[0] <= 3 * q.factor(error)
    whole = q.merge(daily, ["k"], error)
    assert whole.groupBy("k").count().agg(F.max("count")).first()[0] <= 3 * q.factor(error)
    asked = {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in q.percentiles(whole, ["k"], asked, error).collect()}
    assert got.keys() == {"hot", "few", None} and got["few"].n == 9 and got["few"].p50 == 5 and got["few"].p95 == 9 and got[None].p50 == 7
    values = sorted(v for k, _, v in parts if k == "hot")
    for name, share in asked.items():
        rank = math.ceil(share * len(values))
        low, high = np.searchsorted(values, getattr(got["hot"], name) * 127 / 128), np.searchsorted(values, getattr(got["hot"], name), side="right")
        assert low - error * len(values) <= rank <= high + error * len(values), name
    assert got["hot"].max_rank_error == math.ceil(error * len(values))


def test_compress_conserves_counts():
    rng = np.random.default_rng(2)
    g, leaf = rng.integers(0, 3, 4000), rng.integers(0, q.UNIVERSE, 4000) + q.UNIVERSE
    n = rng.integers(1, 50, 4000)
    og, node, c = q.compress_nodes(g, leaf, n, 50)
    assert [c[og == i].sum() for i in range(3)] == [n[g == i].sum() for i in range(3)]
    again = q.compress_nodes(og, node, c, 50)
    assert len(again[2]) <= len(c) <= 3 * 3 * 50


def test_digest_leaves_out_nulls_and_negatives(spark):
    df = spark.createDataFrame([("a", None, "clash"), ("a", -1, ""), ("b", 0, "")], "k string, v long, n string")
    assert [tuple(r) for r in q.percentiles(q.digest(df, ["k"], "v", 0.1), ["k"], {"p50": 0.5}, 0.1).collect()] == [("b", 1, 0, 1)]
    assert q.digest(df.limit(0), ["k"], "v", 0.1).count() == 0
    with pytest.raises(ValueError):
        q.factor(0)


# --- tokens and packing ------------------------------------------------------------------


def test_tokens_as_the_other_library(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + ["", "<|endoftext|>", "é中文🎉 \n\n x" * 50]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(-1, None)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", tokens.n_tokens(F.col("text")).alias("n")).collect()}
    assert got == {-1: 0} | {i: len(e.ids) for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("docs", "budget"), [(1000, 2048**2), (3, 2048**2), (1000, 900_000)])
def test_best_fit_keeps_every_constraint(rule, docs, budget):
    rng = random.Random(4)
    sizes = np.array([min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(3000)])
    bins = packing.best_fit(sizes, 2048, docs, budget, rule=rule)
    for b in range(bins.max() + 1):
        s = sizes[bins == b]
        assert len(s) and s.sum() <= 2048 and len(s) <= docs
        assert (s**2).sum() <= budget or len(s) == 1
    if docs == 1000 and budget == 2048**2:
        assert bins.max() + 1 <= math.ceil(sizes.sum() / 2048) * (1.01 if rule == "norm" else 1.1)


def test_best_fit_edge_cases():
    assert packing.best_fit(np.array([], "int64"), 10, 5, 100).tolist() == []
    assert packing.best_fit(np.array([10, 10]), 10, 5, 100).tolist() == [0, 1]
    assert len(set(packing.best_fit(np.array([5] * 7), 10, 5, 100).tolist())) == 4
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1]), 10, 5, 100, rule="x")


def test_pack_cuts_only_what_exceeds(spark):
    rows = [(1, 5000), (2, 2048), (3, 2049), (4, 0), (5, None), (6, 1), (6, 1), (None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("block", F.lit("clash"))
    p = packing.pack(df, block=4).cache()
    assert {r.doc_id for r in packing.cut_documents(p).collect()} == {1, 3}
    assert p.agg(F.sum("n_tokens")).first()[0] == 5000 + 2048 + 2049 + 1 + 1 + 10
    one = [(r.piece, r.start_token, r.n_tokens, r.n_pieces) for r in p.where("doc_id = 1").orderBy("piece").collect()]
    assert one == [(0, 0, 2048, 3), (1, 2048, 2048, 3), (2, 4096, 904, 3)]
    assert packing.containers(p).where("n_tokens > 2048 or unused < 0").count() == 0
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


def test_pack_fills_well_whatever_the_blocks(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, int(rng.lognormvariate(6, 1)) + 1) for i in range(6000)], "doc_id long, n_tokens int")
    for block in (1500, 100_000):
        c = packing.containers(packing.pack(df, block=block)).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
        assert c.t / (2048 * c.n) > 0.985


# --- mixing ------------------------------------------------------------------------------

TARGETS = "source string, target_weight double, max_repeats int"


def mix(spark, docs, targets, **kw):
    return mixing.Mix(spark.createDataFrame(docs, "doc_id long, source string, n_tokens int"), spark.createDataFrame(targets, TARGETS), **kw)


def simulate(docs, targets, budget):
    """Weighted fair queueing one document at a time, in the order of the hashes that the mix uses."""
    queues = {}
    for key, w, rep in targets:
        own = [d for d in docs if d[1] == key]
        queues[key] = (w, [t for _ in range(rep) for t in own])
    clock, used = {k: 0 for k in queues}, {k: 0 for k in queues}
    total = 0
    heads = {k: 0 for k in queues}
    while True:
        ready = [(clock[k] + x[heads[k]][2]) / w for k, (w, x) in queues.items() if heads[k] < len(x)]
        if not ready:
            return used
        t, k = min(((clock[k] + x[heads[k]][2]) / w, k) for k, (w, x) in queues.items() if heads[k] < len(x))
        size = queues[k][1][heads[k]][2]
        if total + size > budget:
            return used
        clock[k] += size
        used[k] += size
        total += size
        heads[k] += 1


def test_mix_as_simulated(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    docs = [(i, s, 10) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 5)]
    targets = [("a", 1.0, 1), ("b", 1.0, 2), ("c", 2.0, 3), ("d", 1.0, 5)]
    m = mix(spark, docs, targets)
    got = {r.source: r for r in m.report().collect()}
    want = simulate(docs, targets, 3450)
    assert {k: got[k].mix_tokens for k in "abc"} == {k: want[k] for k in "abc"}
    assert {k for k in got if got[k].short} == {"c", "d"}
    assert got["b"].most_copies == 2 and got["c"].most_copies == 3 and got["d"].mix_tokens == 0
    rows = m.queue().orderBy("upto_tokens").collect()
    assert [r.upto_tokens for r in rows] == list(np.cumsum([r.n_tokens for r in rows])) and rows[-1].upto_tokens <= 3450
    assert [r.finish_time for r in rows] == sorted(r.finish_time for r in rows)
    assert len({(r.doc_id, r.round) for r in rows}) == len(rows)


def test_mix_shares_when_all_have_enough(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice([" A", "b ", "B", "x", None]), rng.randrange(1, 60)) for i in range(3000)]
    m = mix(spark, docs, [("a", 3.0, 4), ("b", 1.0, 1), ("x", None, 3), ("y", 0.0, 1)], budget=20_000)
    got = {r.source: r for r in m.report().collect()}
    assert got.keys() == {"a", "b", "y"} and not any(r.short for r in got.values())
    assert abs(got["a"].reached_share - 0.75) < 0.01 and abs(got["b"].reached_share - 0.25) < 0.01


def test_mix_edge_cases(spark):
    none = mix(spark, [], [("a", 1.0, 1)])
    assert none.queue().count() == 0 and [r.source for r in none.report().where("short").collect()] == []
    twice = mix(spark, [(1, "a", 5), (1, "a", 5), (None, "a", 5), (2, "a", None), (3, "a", 0)], [("a", 1.0, None), ("A ", 1.0, 2)])
    assert twice.queue().agg(F.sum("n_tokens")).first()[0] == 15
    assert mix(spark, [(1, "a", 5)], []).queue().count() == 0


def test_fill_level():
    assert mixing.fill_level([1, 1], [10, 10], 10) == 5
    assert mixing.fill_level([1, 1], [2, 10], 10) == 8
    assert mixing.fill_level([1, 1], [2, 3], 10) == math.inf


def test_mix_of_equal_rows_is_spread_and_whole(spark):
    """Rows that nothing but their place tells apart, over several range partitions."""
    docs = spark.createDataFrame([(None, "a", 7)] * 3000 + [(1, "b", 3)] * 1000, "doc_id long, source string, n_tokens int")
    few, mixing.RANGE_ROWS = mixing.RANGE_ROWS, 500
    try:
        m = mixing.Mix(docs, spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2)], "source string, target_weight double, max_repeats int"), budget=20_000)
        rows = m.queue().orderBy("upto_tokens").collect()
    finally:
        mixing.RANGE_ROWS = few
    assert [r.upto_tokens for r in rows] == list(np.cumsum([r.n_tokens for r in rows]))
    assert [r.finish_time for r in rows] == sorted(r.finish_time for r in rows) and 19_990 < rows[-1].upto_tokens <= 20_000


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_no_two_containers_fit_into_one(rule):
    """Under limits that bind, alone and together."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 400)
    cap, docs, budget = 100, 4, 3_000
    at = packing.best_fit(sizes, cap, docs, budget, rule=rule)
    bins = [(sizes[at == b].sum(), (at == b).sum(), (sizes[at == b] ** 2).sum()) for b in range(at.max() + 1)]
    assert all(t <= cap and n <= docs and (c <= budget or n == 1) for t, n, c in bins)
    assert any(n == docs for _, n, _ in bins) and any(c > 0.98 * budget for _, _, c in bins)
    assert not any(a[0] + b[0] <= cap and a[1] + b[1] <= docs and a[2] + b[2] <= budget for i, a in enumerate(bins) for b in bins[:i])


def test_blocks_are_bounded_whatever_the_rows(spark):
    """Ten texts of very many pieces, and very many rows of one null id and one size."""
    long = packing.pack(spark.createDataFrame([(i, 3_000) for i in range(10)], "doc_id long, n_tokens int"), capacity=1, block=2_000)
    same = packing.pack(spark.createDataFrame([(None, 5)] * 8_000, "doc_id long, n_tokens int"), capacity=10, block=1_000)
    for packed, n, most in ((long, 30_000, 2_300), (same, 8_000, 1_150)):
        sizes = [r["count"] for r in packed.groupBy("block").count().collect()]
        assert sum(sizes) == n and max(sizes) < most


def test_weak_labels_alone_teach(spark):
    """Addresses, headings and scope notes, without any label by hand."""
    rng, docs, truth = random.Random(2), [], {}
    scope = {"law": "courts and verdicts", "sport": "coach and league", "travel": "hotel and flights"}
    heads = {"law": "courts", "sport": "league", "travel": "hotel"}
    for i in range(300):
        s = rng.choice(sorted(WORDS))
        words = [rng.choice(PLAIN.split()) for _ in range(40)] + [rng.choice(WORDS[s].split()) for _ in range(16)]
        rng.shuffle(words)
        docs.append((i, (f"GET /v1/{heads[s]}/list\n" if i % 3 == 0 else f"# {heads[s]} page\n" if i % 3 == 1 else "") + " ".join(words)))
        truth[i] = s
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string, labeller string")
    got = subjects.classify(d, none, spark.createDataFrame(sorted(scope.items()), "subject string, scope_note string")).collect()
    assert sum(truth[r.doc_id] == r.subject for r in got) >= 0.95 * len(got) and len({r.doc_id for r in got}) >= 280


# --- subjects ----------------------------------------------------------------------------

WORDS = {"law": "court verdict statute appeal clause", "sport": "match coach league goal relay", "travel": "hotel flight visa ferry luggage"}
PLAIN = "the result of this record and that page is a list with one key for each row"


def corpus(seed=0, n=400):
    rng, docs, truth = random.Random(seed), [], {}
    for i in range(n):
        about = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2]))
        words = [rng.choice(PLAIN.split()) for _ in range(60)] + [rng.choice(WORDS[s].split()) for s in about for _ in range(18 // len(about))]
        if rng.random() < 0.3:
            words.append(rng.choice(WORDS[rng.choice(sorted(WORDS))].split()))  # a passing mention
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        truth[i] = set(about)
    labels = [(i, s.upper() + " ", "x") for i in range(n // 2) for s in truth[i]] + [(i, None, "x") for i in range(n // 2) if not truth[i]]
    wrong = [(i, rng.choice(sorted(WORDS)), "y") for i in range(0, n // 2, 9)]
    return docs, labels + wrong, truth


def test_subjects_held_out(spark):
    docs, labels, truth = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = subjects.train(d, spark.createDataFrame(labels, "doc_id long, subject string, labeller string"), spark.createDataFrame([(s,) for s in WORDS], "subject string"))
    got = {}
    for r in subjects.assign(d, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in range(200, 400))  # documents without labels
    assert right >= 185, right


def test_subjects_edge_cases(spark):
    docs, labels, _ = corpus(1, 120)
    schema = "doc_id long, text string, subject string"
    extra = [(1000, None, "c"), (1001, "", "c"), (1002, " \n", "c"), (1003, "court", "c"), (1004, "court verdict " * 200_000, "c"), (None, "court verdict", "c"), (1003, "court", "c")]
    d = spark.createDataFrame([(*x, "c") for x in docs] + extra, schema)
    lab = spark.createDataFrame(labels + [(None, "law", "x"), (5, "unknown subject", None), (99999, "law", "x")], "doc_id long, subject string, labeller string")
    subj = spark.createDataFrame([("law",), ("sport",), ("travel",), (None,)], "subject string")
    model = subjects.train(d, lab, subj)
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, model).where("doc_id >= 1000").collect()}
    assert got == {(1003, "law"), (1004, "law")}
    assert subjects.assign(d, subjects.train(d, lab.limit(0), subj)).count() == 0
    assert subjects.assign(d.limit(0), subjects.train(d.limit(0), lab, subj)).count() == 0


def test_ngrams_do_not_cross_texts():
    one = subjects.ngrams(["court verdict"])
    two = subjects.ngrams(["court", "verdict"])
    assert len(one[1]) == 3 and len(two[1]) == 2 and subjects.ngrams(["", "X 9"])[1].size == 0
    assert set(subjects.ngrams(["CourtVerdict"])[1]) == set(subjects.ngrams(["court_verdict"])[1])
    assert len(subjects.ngrams(["法院判决"])[1]) == 4 + 3 + 2
    assert subjects.metadata("GET /a/court-file/x\nParameters: caseId long\n# Court flow\nother") == "/a/court-file/x\ncaseId long\nCourt flow"
