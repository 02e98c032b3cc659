import math
import uuid

import oracle
import pytest

from factorloom.operators import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert oracle.check(QUERIES[name](spark, sf_dir).toPandas(), oracle.duck(sf_dir, ORACLES[name])) is None


def test_rsi_stays_in_range(spark, sf_dir):
    v = QUERIES["rsi"](spark, sf_dir).toPandas()["v"].dropna()
    assert len(v) and v.between(0, 100).all()


def test_samples(spark, sf_dir):
    a, b = (QUERIES["weighted_sample"](spark, sf_dir).toPandas() for _ in range(2))
    assert a.equals(b) and a.p_partkey.is_unique and len(a) == 100
    both = QUERIES["top_and_random"](spark, sf_dir).toPandas()
    assert both.p_partkey.is_unique and set(both.side) == {"best", "drawn"}


def test_content_ids_are_uuids(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["content_id"](spark, sf_dir).collect()
    assert got and all(r.node == str(uuid.uuid3(uuid.NAMESPACE_DNS, texts[r.doc_id])) for r in got)


def test_sessions(spark, sf_dir):
    import pandas as pd

    e = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas()
    last = e.ts.max() - pd.Timedelta("6h")
    want = {}
    for user, some in e.sort_values("ts").groupby("user_id"):
        run = (some.ts.diff() >= pd.Timedelta("30min")).cumsum()
        for _, s in some.groupby(run):
            if s.ts.max() + pd.Timedelta("30min") <= last:
                a, b = want.get(user, (0, 0))
                want[user] = (a + 1, b + len(s))
    assert {r.user_id: (r.sessions, r.n) for r in QUERIES["stream_sessions"](spark, sf_dir).collect()} == want


def test_clusters_agree_with_a_plain_assignment(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas().set_index("vec_id")
    got = QUERIES["kmeans"](spark, sf_dir).toPandas()
    assert len(got) == len(rows) and list(got.cluster.value_counts().sort_index()) == sorted(got.cluster.value_counts(), reverse=True)
    x = np.stack(rows.loc[got.vec_id].embedding)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = np.stack([x[got.cluster == c].sum(0) for c in range(got.cluster.max() + 1)])
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    assert (np.argmax(x @ centre.T, 1) == got.cluster).mean() > 0.8


def test_smallest_clustering_is_under_the_limit(spark, sf_dir):
    from factorloom.operators.graphs import smallest_clustering, with_norm

    rows = with_norm(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = smallest_clustering(rows, 200, most=8)
    assert out.groupBy("cluster").count().agg({"count": "max"}).first()[0] < 200 or out.select("cluster").distinct().count() == 8


def test_store_of_vectors(spark, sf_dir):
    got = QUERIES["vector_insert"](spark, sf_dir).toPandas()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text is not None]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {t for t in texts} | set(items) | {t[i : i + 400] for t in texts for i in range(0, len(t), 400)}
    assert set(got.id) == {str(uuid.uuid3(uuid.NAMESPACE_DNS, t)) for t in want} and got.id.is_unique


def test_trees(spark, sf_dir):
    from factorloom.operators import trees
    from factorloom.plans.libraries import LIBRARIES
    from factorloom.plans.parser import common_subtree, parse

    wide, zoo = LIBRARIES["wide_158"](), LIBRARIES["compact_20"]()
    assert [len(LIBRARIES[k]()) for k in ("compact_20", "wide_158", "multi_span_66")] == [20, 158, 66]
    got = {r.name: r for r in QUERIES["zoo_match"](spark, sf_dir).collect()}
    for name in list(wide)[::13]:
        assert got[name].n == max(common_subtree(parse(wide[name]), parse(z))[0] for z in zoo.values())
    n = {r.name: r for r in QUERIES["tree_counts"](spark, sf_dir).collect()}
    assert (n["KLEN"].n_nodes, n["KLEN"].n_numbers, n["KLEN"].n_features, n["KLEN"].length) == (5, 0, 3, len(wide["KLEN"]))
    for r in QUERIES["regulator"](spark, sf_dir).collect():
        c = n[r.name]
        light = all(x < c.n_nodes and -math.log(1 - x / c.n_nodes) < 0.693 for x in (c.n_numbers, c.n_features))
        assert r.ok == (r.shared <= 8 and light and c.length <= 300 and c.n_features <= 6)
    assert trees.counts("TS_MEAN($close, 5) + 1e-3")[:3] == (5, 2, 1)


def test_constants_and_flat_regressors(spark, sf_dir):
    from factorloom.operators.factor_queries import panel
    from factorloom.plans.compiler import evaluate

    rows = evaluate(panel(spark, sf_dir), {"a": "NAN", "b": "NULL", "c": "true ? 1 : 0", "d": "false ? 1 : 0", "e": "REGBETA($z, 0 * $z + 3, 4)"}).toPandas()
    assert rows.a.isna().all() and rows.b.isna().all() and (rows.c == 1).all() and (rows.d == 0).all()
    # The least-norm answer where x is constant: slope 3 m / (9 + 1) for a mean m.
    mean = evaluate(panel(spark, sf_dir), {"m": "TS_MEAN($z, 4)"}).toPandas()
    both = rows.merge(mean, on=["instrument", "datetime"]).dropna(subset=["e"])
    assert len(both) and (abs(both.e - 0.3 * both.m) < 1e-9).all()


def test_ranks_of_groups_of_one_and_infinite_values(spark):
    from factorloom.operators.analytics import clean_rank

    rows = [("a", 1, 2.0), ("b", 1, float("inf")), ("c", 1, None), ("d", 1, 2.0), ("a", 2, 5.0)]
    got = {(r.instrument, r.datetime): r.v for r in clean_rank(spark.createDataFrame(rows, "instrument string, datetime int, c double"), "c").collect()}
    assert got == {("a", 1): 0.375, ("b", 1): -0.125, ("c", 1): -0.125, ("d", 1): 0.375, ("a", 2): 0.5}
