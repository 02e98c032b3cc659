import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factorloom.llm import lmscore

ROWS = [(d, " ".join("abcd"[(d * 7 + k * k + k * d // 3) % 4] for k in range(d % 40))) for d in range(120)]


def hashed(h, w):
    one = [lmscore.END if x is None else next(lmscore._tokens(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])))[2][0] for x in (h, w)]
    return lmscore._bigrams(np.array(one, np.uint64))[1]


def plain(learnt, texts):
    """Counts and scores by dictionaries; of bigrams the middle of the power of two that one filter for all gives."""
    tokens = [[*t.split(), None] for t in texts]
    learnt = [[*t.split(), None] for t in learnt]
    one = Counter(w for ws in learnt for w in ws)
    two = Counter(p for ws in learnt for p in zip([None, *ws], ws))
    n, v = sum(one.values()), len(one)
    bits = lmscore._filter(np.array([hashed(*p) for p in two]), np.array(list(two.values())))
    level = {p: int(lmscore._levels(bits, np.array([hashed(*p)]))[0]) for ws in tokens for p in zip([None, *ws], ws)}
    assert all(q >= two[p].bit_length() for p, q in level.items())
    for ws in tokens:
        base = full = 0.0
        for h, w in zip([None, *ws], ws):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            c = min(0.75 * 2 ** level[h, w] - 0.5 if level[h, w] else 0, one[w], one[h])
            base += math.log10(p)
            full += math.log10((c + lmscore.MU * p) / (one[h] + lmscore.MU))
        yield len(ws), sum(one[w] > 0 for w in ws), n, base, full


def test_scores_match_plain_counts_in_any_split(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    want = dict(zip([d for d, _ in ROWS], plain([t for d, t in ROWS if d % 5], [t for _, t in ROWS]), strict=True))
    for training in (docs.where("doc_id % 5 <> 0").select("text"), F.expr("doc_id % 5 <> 0")):
        got = {r.doc_id: r for r in lmscore.score(docs, training).collect()}
        assert got.keys() == want.keys()
        for d, (tokens, known, n, base, full) in want.items():
            assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (tokens, known, n)
            assert abs(got[d].base_score - base) < 1e-9 and abs(got[d].score - full) < 1e-9
    monkeypatch.setattr(lmscore, "RANGE_ENTRIES", 20)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 200)
    for r in lmscore.score(docs, docs.where("doc_id % 5 <> 0").select("text")).collect():
        tokens, known, n, base, _ = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and abs(r.base_score - base) < 1e-9


def test_the_driver_holds_no_table(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    sent = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append([(b"broadcast",)]))
    monkeypatch.setattr(lmscore, "RANGE_ENTRIES", 20)
    lmscore.score(docs, docs.select("text"))
    assert all(len(rows) == 1 and not isinstance(x, bytes | bytearray) for rows in sent for row in rows for x in row)


def test_columns_of_any_type_and_name_pass_through(spark):
    docs = spark.createDataFrame(ROWS[:9], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "timestamp'2024-05-06 07:08:09' as at", "map('k', 2) as m", "'x' as head", "'y' as learn", "cast(null as int) as block", "text")
    for training in (F.expr("doc_id > 3"), docs.where("doc_id > 3").select("text")):
        got = lmscore.score(docs, training)
        assert got.columns[:6] == ["doc_id", "at", "m", "head", "learn", "block"]
        same = docs.select(*got.columns[:6]).withColumn("m", F.col("m")["k"]).exceptAll(got.select(*got.columns[:6]).withColumn("m", F.col("m")["k"]))
        assert got.count() == 9 and same.count() == 0
    assert lmscore.score(docs.where("false"), F.lit(True)).count() == 0
