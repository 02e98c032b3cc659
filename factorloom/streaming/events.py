"""Streams: windowed bars of events with a watermark, and a ledger that is followed as it grows.

Sinks are Parquet folders in append mode with a checkpoint beside them, so that a query that is
stopped goes on where it was and nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorloom.sources.panel import table
from factorloom.sources.stores import append_ledger, fresh

DELAY = "6 hours"
SPAN = "1 hour"
LEDGER = "event_id long, user_id long, event_type string"


def follow(spark: SparkSession, path: str, schema, form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The files of a folder or pattern, those to come included."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def follow_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """Whole lines of a JSON ledger; torn ones are skipped."""
    raw = spark.readStream.schema(f"{schema}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    return raw.where("_torn is null").drop("_torn")


def bars_of(events: DataFrame, span: str = SPAN, delay: str = DELAY, slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of windows over ``ts``; rows later than ``delay`` are late and left out."""
    late = events.withWatermark("ts", delay)
    out = late.groupBy(F.window("ts", span, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions_of(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """user_id, start, n of runs of a user's events without a gap."""
    late = events.withWatermark("ts", delay)
    out = late.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def members_of(ledger: DataFrame) -> DataFrame:
    """user_id, event_id, member after every batch that has events of the user: the event with the greatest id decides.

    The state of a user is two numbers, whatever the length of the ledger.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, member = state.get if state.exists else (-1, False)
        for f in frames:
            at = f["event_id"].idxmax()
            if f.at[at, "event_id"] > last:
                last, member = int(f.at[at, "event_id"]), f.at[at, "event_type"] != "error"
        state.update((last, bool(member)))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [last], "member": [bool(member)]})

    out = "user_id long, event_id long, member boolean"
    return ledger.groupBy("user_id").applyInPandasWithState(run, out, "last long, member boolean", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all there is now, into a Parquet folder, and read it."""
    spark = stream.sparkSession
    path = fresh(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = table(spark, sf_dir, "events")
    return follow(spark, f"{sf_dir}/events.parquet*", still.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def q_bars(spark, d):
    out = drain(bars_of(_events(spark, d)), "event-bars")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", (F.round("total", 2) + 0.0).alias("total"))


def q_sessions(spark, d):
    out = drain(sessions_of(_events(spark, d)), "sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


def q_members(spark, d):
    """The ledger in three appends; the last word on each user is that of the greatest event."""
    path, e = fresh(spark, "ledger"), table(spark, d, "events").where("event_type in ('purchase', 'signup', 'error')")
    for kind in ("signup", "error", "purchase"):
        append_ledger(e.where(F.col("event_type") == kind).select("event_id", "user_id", "event_type"), path)
    out = drain(members_of(follow_ledger(spark, path)), "members")
    last = out.groupBy("user_id").agg(F.max(F.struct("event_id", "member")).alias("x"))
    return last.where("x.member").select("user_id", "x.event_id")


def queries() -> dict:
    return {"stream_event_bars": q_bars, "stream_sessions": q_sessions, "stream_members": q_members}


def oracles() -> dict[str, str]:
    return {
        "stream_event_bars": "with w as (select date_trunc('hour', ts) as s, event_type, count(*) as n, sum(value) as total from events group by 1, 2) select strftime(s, '%Y-%m-%d %H:%M') as start, event_type, n, round(total, 2) + 0.0 as total from w where s + interval 1 hour <= (select max(ts) - interval 6 hour from events)",
        "stream_members": "with l as (select * from events where event_type in ('purchase', 'signup', 'error') qualify row_number() over (partition by user_id order by event_id desc) = 1) select user_id, event_id from l where event_type <> 'error'",
    }
