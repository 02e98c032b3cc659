"""Queries over expression trees: counts, subtree matches in a library, acceptance, dialects.

A library is a table (name, expr).  Its trees are exploded to canonical subtrees once, so that
the largest common subtree with every other expression is an equi-join on a hash.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.factor_queries import rounded
from factorloom.plans.libraries import LIBRARIES
from factorloom.plans.parser import Field, Num, canonical, parse, size, walk

#: Limits of acceptance: shared subtree, length of the text, base features; and of the ratios' penalty.
LIMITS = {"shared": 8, "length": 300, "features": 6, "penalty": 0.693}

# What the rolling dialect has no word for, and its names of common functions.
UNSUPPORTED = [
    "ZSCORE(", "RANK(", "TS_ZSCORE(", "TS_RANK(", "DELAY(", "DELTA(", "DECAYLINEAR(", "REGBETA(", "REGRESI(", "SEQUENCE(",
    "SUMIF(", "COUNTIF(", "FILTER(", "POW(", "SIGN(", "INV(", "RSI(", "MACD(", "BB_", "EMA(", "WMA(", "SMA(",
    "TS_CORR(", "TS_COVARIANCE(", "TS_MAD(", "TS_QUANTILE(", "TS_PCTCHANGE(", "HIGHDAY(", "LOWDAY(", "SUMAC(",
    "TS_ARGMAX(", "TS_ARGMIN(", "?", ":",
]
RENAMES = {
    "TS_MEAN": "Mean", "TS_STD": "Std", "TS_VAR": "Var", "TS_MAX": "Max", "TS_MIN": "Min", "TS_SUM": "Sum",
    "$return": "($close/Ref($close,1)-1)",
}


def library_table(spark: SparkSession, library: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in library.items()], "name string, expr string")


def counts(text: str) -> tuple[int, int, int, int]:
    """Nodes, numbers, distinct base features, and length of the text."""
    tree = parse(text)
    nodes = list(walk(tree))
    return len(nodes), sum(isinstance(n, Num) for n in nodes), len({n.name.lower() for n in nodes if isinstance(n, Field)}), len(text.strip())


def tree_counts(rows: DataFrame) -> DataFrame:
    """name, n_nodes, n_numbers, n_features, length of every (name, expr)."""

    def run(batches):
        for b in batches:
            names, texts = (b.column(i).to_pylist() for i in (0, 1))
            cols = list(zip(*(counts(t) for t in texts), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["name", "n_nodes", "n_numbers", "n_features", "length"])

    return rows.select("name", "expr").mapInArrow(run, "name string, n_nodes long, n_numbers long, n_features long, length long")


def subtrees(rows: DataFrame) -> DataFrame:
    """name, tree (hash), n (nodes), text of every distinct subtree, up to commutativity."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for name, expr in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for text, n in {canonical(x): size(x) for x in walk(parse(expr))}.items():
                    for c, v in zip(out, (name, hashlib.md5(text.encode()).hexdigest(), n, text), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["name", "tree", "n", "text"])

    return rows.select("name", "expr").mapInArrow(run, "name string, tree string, n long, text string")


def zoo_match(candidates: DataFrame, zoo: DataFrame) -> DataFrame:
    """name, match, n, text: for each candidate its largest subtree found in the zoo and where; the least by name of equals.

    A subtree that much of the zoo has (a bare field) is kept once, with the least name that has it.
    """
    known = subtrees(zoo).groupBy("tree").agg(F.min("name").alias("match"))
    met = subtrees(candidates).join(known, "tree")
    best = met.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "match", "text")).alias("b"))
    found = best.select("name", F.col("b.match").alias("match"), (-F.col("b.n")).alias("n"), F.col("b.text").alias("text"))
    return candidates.select("name").join(found, "name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def acceptable(shared: Column, limits: dict = LIMITS) -> Column:
    """Five conditions on a row of ``tree_counts``; a ratio of 1 or no nodes fails."""
    ratio = lambda c: F.col(c) / F.col("n_nodes")
    light = lambda c: (ratio(c) < 1) & (-F.log(F.greatest(1 - ratio(c), F.lit(1e-300))) < limits["penalty"])
    return (
        (F.col("n_nodes") > 0) & (shared <= limits["shared"]) & light("n_numbers") & light("n_features")
        & (F.col("length") <= limits["length"]) & (F.col("n_features") <= limits["features"])
    )


def complexity(length: Column, numbers: Column, features: Column, weights=(1.0, 1.0, 1.0)) -> Column:
    """Weighted sum of length, numbers and the logarithm of base features."""
    return weights[0] * length + weights[1] * numbers + weights[2] * F.log1p(features.cast("double"))


def compatible(expr: Column) -> Column:
    """Whether a text uses nothing that the rolling dialect lacks."""
    upper, ok = F.upper(expr), F.lit(True)
    for word in UNSUPPORTED:
        ok = ok & ~upper.contains(word.upper())
    return ok


def to_dialect(expr: Column) -> Column:
    """The text with the dialect's names, or null where there are none."""
    for old, new in RENAMES.items():
        expr = F.replace(expr, F.lit(old), F.lit(new))
    return F.when(compatible(expr), expr)


def _whole(spark) -> DataFrame:
    return library_table(spark, LIBRARIES["wide_158"]())


def q_tree_counts(spark, d):
    rows = tree_counts(_whole(spark))
    return rounded(rows.withColumn("cx", complexity(F.col("length"), F.col("n_numbers"), F.col("n_features"))), "cx")


def q_zoo_match(spark, d):
    return zoo_match(_whole(spark), library_table(spark, LIBRARIES["compact_20"]()))


def q_regulator(spark, d):
    match = q_zoo_match(spark, d).select("name", F.col("n").alias("shared"))
    return tree_counts(_whole(spark)).join(match, "name").select("name", "shared", acceptable(F.col("shared")).alias("ok"))


def q_dialect(spark, d):
    return _whole(spark).select("name", compatible(F.col("expr")).alias("ok"), to_dialect(F.col("expr")).alias("dialect"))


def _values() -> str:
    return "(values " + ", ".join(f"('{k}', '{v}')" for k, v in LIBRARIES["wide_158"]().items()) + ") as l(name, expr)"


def _dialect_sql() -> str:
    bad = lambda e: " or ".join(f"contains(upper({e}), '{w}')" for w in UNSUPPORTED)
    new = "expr"
    for a, b in RENAMES.items():
        new = f"replace({new}, '{a}', '{b}')"
    return f"with l as (select *, {new} as e2 from {_values()}) select name, not ({bad('expr')}) as ok, case when not ({bad('e2')}) then e2 end as dialect from l"


def largest_penalised_ratio(penalty: float = LIMITS["penalty"]) -> float:
    """The ratio at which the penalty is reached."""
    return 1 - math.exp(-penalty)


def queries() -> dict:
    return {"tree_counts": q_tree_counts, "zoo_match": q_zoo_match, "regulator": q_regulator, "dialect": q_dialect}


def oracles() -> dict[str, str]:
    return {"dialect": _dialect_sql()}
