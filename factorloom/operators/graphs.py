"""Vector and graph queries: similarity, clusters, chunks, breadth-first search, neighbourhoods.

The graph of the queries is parts and suppliers: a node is (id, label, content), an edge joins a
part with each supplier that shipped it.  Every search is an iterated join on the frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators.factor_queries import rounded
from factorloom.operators.runs import content_id
from factorloom.sources.panel import table

CHUNK = 400
#: Rows of a set that may be broadcast whole.
SMALL = 20_000


# Vectors ------------------------------------------------------------------------------


def with_norm(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v (doubles), n (its length)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = rows.select("vec_id", v.alias("v"))
    return rows.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def cosine(a: str, b: str, na: str, nb: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.col(na) > 0) & (F.col(nb) > 0), dot / (F.col(na) * F.col(nb)))


def similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, sim of all pairs of two stated sets; the right one must be small enough to broadcast."""
    if right.count() > SMALL:
        raise ValueError(f"a similarity matrix against more than {SMALL} rows is a search: use top-k")
    x = left.select(F.col("vec_id").alias("a"), F.col("v").alias("va"), F.col("n").alias("na"))
    y = right.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    return x.crossJoin(F.broadcast(y)).select("a", "b", cosine("va", "vb", "na", "nb").alias("sim"))


def q_similarity_matrix(spark, d):
    """The label centroids' cosine with each other."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
    centre = centre.select(F.col("label").alias("vec_id"), F.transform("s", lambda p: p["m"]).alias("embedding"))
    both = with_norm(centre)
    return rounded(similarity(both, both), "sim")


def spherical_kmeans(rows: DataFrame, k: int, rounds: int = 5) -> DataFrame:
    """vec_id, cluster: cosine assignment to k centres, first taken evenly by id; only the centres reach the driver.

    Clusters are numbered by size, the greatest first (then by least id).
    """
    unit = rows.where("n > 0").select("vec_id", F.transform("v", lambda x: x / F.col("n")).alias("u"))
    first = unit.withColumn("t", F.ntile(k).over(Window.orderBy(F.xxhash64("vec_id")))).groupBy("t").agg(F.min("vec_id").alias("vec_id"))
    centres = [list(r.u) for r in unit.join(F.broadcast(first), "vec_id").orderBy("t").select("u").collect()]

    def assigned():
        dots = [F.aggregate(F.zip_with("u", F.lit(c), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for c in centres]
        best = F.array_max(F.array(*(F.struct(v.alias("s"), F.lit(-i).alias("i")) for i, v in enumerate(dots))))
        return unit.withColumn("c", -best["i"])

    for _ in range(rounds):
        sums = assigned().select("c", F.posexplode("u").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("s"))
        new = {c: [0.0] * len(centres[0]) for c in range(len(centres))}
        for r in sums.collect():
            new[r.c][r.i] = r.s
        lengths = {c: sum(x * x for x in v) ** 0.5 for c, v in new.items()}
        centres = [[x / lengths[c] for x in new[c]] if lengths[c] > 0 else centres[c] for c in range(len(centres))]
    out = assigned().select("vec_id", "c")
    sizes = out.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("f"))
    rank = sizes.select("c", (F.row_number().over(Window.orderBy(F.col("m").desc(), "f")) - 1).alias("cluster"))
    return out.join(F.broadcast(rank), "c").select("vec_id", "cluster")


def smallest_clustering(rows: DataFrame, limit: int, most: int = 16) -> DataFrame:
    """The clustering with the fewest clusters of which none has ``limit`` rows or more, or with ``most``."""
    k = 2
    while True:
        out = spherical_kmeans(rows, k)
        if k >= most or out.groupBy("cluster").count().agg(F.max("count")).first()[0] < limit:
            return out
        k *= 2


def q_kmeans(spark, d):
    return spherical_kmeans(with_norm(table(spark, d, "embeddings")), 8)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, chunk, text: whole texts in pieces of ``size`` characters; an empty text has none."""
    n = F.ceil(F.length("text") / F.lit(float(size))).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = docs.where("text is not null").select("doc_id", "text", F.explode(starts).alias("chunk"))
    return rows.select("doc_id", "chunk", F.substring("text", F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def q_chunks(spark, d):
    return chunks(table(spark, d, "documents"))


def inserted(known: DataFrame, docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """A store (id, content) after documents and their chunks are added; a content already there stays once."""
    parts = docs.where("text is not null").select(F.col("text").alias("content")).unionByName(chunks(docs, size).select(F.col("text").alias("content")))
    new = parts.select(content_id(F.col("content")).alias("id"), "content").dropDuplicates(["id"])
    return known.unionByName(new.join(known.select("id"), "id", "left_anti"))


def q_vector_insert(spark, d):
    """The benchmark's items are in the store already."""
    known = table(spark, d, "benchmark").where("text is not null").select(content_id(F.col("text")).alias("id"), F.col("text").alias("content")).dropDuplicates(["id"])
    return inserted(known, table(spark, d, "documents")).select("id", F.length("content").alias("n_chars"))


# Graphs -------------------------------------------------------------------------------


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, content; kept once by id, then by (label, content)."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"), F.lit("part").alias("label"), F.col("p_name").alias("content"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.lit("supplier").alias("label"), F.col("s_name").alias("content"))
    return p.unionByName(s)


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One node of each id, then one of each (label, content): that with the least id."""
    first = rows.groupBy("id").agg(F.min(F.struct("label", "content")).alias("x")).select("id", "x.*")
    return first.groupBy("label", "content").agg(F.min("id").alias("id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of every edge, once."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))


def reached(edges: DataFrame, start: DataFrame, steps: int, through: DataFrame | None = None) -> DataFrame:
    """id, step of nodes within ``steps`` of ``start`` (id), not the start itself.

    With ``through`` (ids) the search goes on only from those nodes; others are reached and end it.
    """
    seen = start.select("id", F.lit(0).alias("step"))
    front = start.select("id")
    for k in range(1, steps + 1):
        new = front.join(edges, front["id"] == edges["a"]).select(F.col("b").alias("id")).distinct()
        new = new.join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(new.withColumn("step", F.lit(k)))
        front = new if through is None else new.join(through.select("id"), "id", "left_semi")
    return seen.where("step > 0")


def q_nodes(spark, d):
    return merged_nodes(nodes(spark, d))


def _first_parts(spark, d, n: int = 3) -> DataFrame:
    return table(spark, d, "part").orderBy("p_partkey").limit(n).select((F.col("p_partkey") * 2).alias("id"))


def q_bfs(spark, d):
    return reached(edges(spark, d), _first_parts(spark, d, 1), 2)


def q_bfs_blocked(spark, d):
    """Only rich suppliers are passed through; parts alone are returned."""
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select((F.col("s_suppkey") * 2 + 1).alias("id"))
    found = reached(edges(spark, d), _first_parts(spark, d, 1), 2, rich)
    return found.join(nodes(spark, d).where("label = 'part'").select("id"), "id", "left_semi")


def common_neighbours(edges: DataFrame, start: DataFrame, least: int) -> DataFrame:
    """id, n: nodes next to at least ``least`` of the start nodes, most first: n-fold intersections of
    neighbourhoods in one grouping, whatever the combination."""
    met = edges.join(start.select(F.col("id").alias("a")), "a", "left_semi").select("a", F.col("b").alias("id")).distinct()
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def q_common_neighbours(spark, d):
    return common_neighbours(edges(spark, d), _first_parts(spark, d), 2)


def q_semantic_entry(spark, d, k: int = 5, cap: int = 20):
    """The vectors nearest the first one, then what their labels' nodes touch, at most ``cap`` by id."""
    rows = with_norm(table(spark, d, "embeddings"))
    first = rows.orderBy("vec_id").limit(1)
    near = similarity(rows, first).where("a <> b").orderBy(F.col("sim").desc(), "a").limit(k).select((F.col("a") * 2).alias("id"))
    return reached(edges(spark, d), near, 1).orderBy("id").limit(cap).select("id")


def constrained(rows: DataFrame, constraint: DataFrame, most: float) -> DataFrame:
    """The nodes, kept if some node is further than ``most`` (1 - cosine) from a constraint node, else none."""
    far = similarity(rows, constraint).where(1 - F.col("sim") > most).limit(1).select(F.lit(True).alias("some"))
    return rows.crossJoin(F.broadcast(far)).drop("some")


def q_constraint(spark, d):
    rows = with_norm(table(spark, d, "embeddings"))
    return constrained(rows, rows.orderBy("vec_id").limit(1), 0.5).select("vec_id")


_EDGES = "e as (select distinct l_partkey * 2 as a, l_suppkey * 2 + 1 as b from lineitem), g as (select a, b from e union all select b, a from e), st as (select min(p_partkey) * 2 as id from part)"
_NORM = "with v as (select vec_id, embedding::double[] as v from embeddings), n as (select *, sqrt(list_dot_product(v, v)) as n from v), f as (select * from n order by vec_id limit 1)"

_Q = {
    "similarity_matrix": (
        q_similarity_matrix,
        "with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as m from x group by 1, 2), c as (select label, list(m order by i) as v from m group by 1) "
        "select a.label as a, b.label as b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) + 0.0 as sim from c a, c b",
    ),
    "kmeans": (q_kmeans, None),
    "chunks": (
        q_chunks,
        f"with c as (select doc_id, text, unnest(range(0, cast(ceil(length(text) / {CHUNK}.0) as integer))) as chunk from documents where text is not null) select doc_id, cast(chunk as integer) as chunk, substring(text, cast(chunk * {CHUNK} + 1 as integer), {CHUNK}) as text from c",
    ),
    "vector_insert": (q_vector_insert, None),
    "graph_nodes": (
        q_nodes,
        "with u as (select p_partkey * 2 as id, 'part' as label, p_name as content from part union all select s_suppkey * 2 + 1, 'supplier', s_name from supplier) select label, content, min(id) as id from u group by 1, 2",
    ),
    "graph_bfs": (
        q_bfs,
        f"with {_EDGES}, one as (select distinct b as id from g join st on a = id), two as (select distinct b as id from g join one on a = id where b not in (select id from one) and b not in (select id from st)) select id, 1 as step from one union all select id, 2 from two",
    ),
    "graph_bfs_blocked": (
        q_bfs_blocked,
        f"with {_EDGES}, rich as (select s_suppkey * 2 + 1 as id from supplier where s_acctbal > 5000), one as (select distinct b as id from g join st on a = id), two as (select distinct b as id from g join one on a = id where a in (select id from rich) and b not in (select id from st)) select id, 2 as step from two",
    ),
    "graph_common": (
        q_common_neighbours,
        f"with {_EDGES}, fs as (select p_partkey * 2 as id from part order by p_partkey limit 3) select b as id, count(*) as n from g where a in (select id from fs) group by 1 having count(*) >= 2",
    ),
    "graph_semantic_entry": (
        q_semantic_entry,
        _NORM + ", k as (select n.vec_id * 2 as id from n, f where n.vec_id <> f.vec_id order by list_dot_product(n.v, f.v) / (n.n * f.n) desc, n.vec_id limit 5), "
        + _EDGES + " select distinct b as id from g where a in (select id from k) and b not in (select id from k) order by id limit 20",
    ),
    "graph_constraint": (
        q_constraint,
        _NORM + " select vec_id from n where exists (select 1 from n x, f where 1 - list_dot_product(x.v, f.v) / (x.n * f.n) > 0.5)",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
