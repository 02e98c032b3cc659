"""Panels (instrument x datetime) over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume", "amount", "vwap")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: First and last trades of a bar are found by one number of fixed size, so that bars are hash-aggregated:
#: order and line number, then part, then price in cents.
_ORDER = (
    "cast(l_orderkey * 16 + l_linenumber as decimal(38, 0)) * 1000000000000000000000BD"
    " + cast(l_partkey as decimal(38, 0)) * 100000000000BD + cast(round(l_extendedprice * 100) as decimal(38, 0))"
)


def bars(spark: SparkSession, sf_dir: str, grain: str = "month", start: str | None = None, end: str | None = None) -> DataFrame:
    """instrument, datetime and FIELDS of one bar per supplier and ``grain``, of the dates from ``start`` to ``end``.

    One partial aggregation by (instrument, datetime); only the columns it needs are scanned, and the
    dates reach the scan as filters.  The order of trades inside a bar ends with the price, so that
    ties change nothing.
    """
    rows = table(spark, sf_dir, "lineitem")
    if start is not None:
        rows = rows.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("l_shipdate") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    price = F.col("l_extendedprice")
    order = F.expr(_ORDER)
    day = F.to_date("l_shipdate")
    out = rows.groupBy(
        F.col("l_suppkey").cast("string").alias("instrument"),
        (day if grain == "day" else F.trunc(day, grain).cast("date")).alias("datetime"),
    ).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum(price).alias("amount"),
    )
    return out.withColumn("vwap", F.col("amount") / F.col("volume"))


#: The same monthly bars for the SQL check.
BARS_SQL = """bars as (
  select cast(l_suppkey as varchar) as instrument, cast(date_trunc('month', l_shipdate) as date) as datetime,
    arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as open,
    max(l_extendedprice) as high, min(l_extendedprice) as low,
    arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) as close,
    sum(l_quantity) as volume, sum(l_extendedprice) as amount, sum(l_extendedprice) / sum(l_quantity) as vwap
  from lineitem group by 1, 2)"""
