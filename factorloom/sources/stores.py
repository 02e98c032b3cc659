"""Files and keyed stores: CSV, JSON, ledgers, signal caches, logs, configuration, snapshots.

Everything is read and written by Spark, so a path may be of any file system it knows.  A
torn or foreign line of a ledger is skipped, never fatal; a keyed store is append-only and its
latest row wins.  Queries write to the folder that the cluster shares and read back.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.plans.compiler import evaluate
from factorloom.sources.panel import bars, table


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where there is no cluster and no setting."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="loom-store-")
        shared_dir.own = path
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Formats ------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a CSV with a header; only the wanted columns are parsed."""
    out = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)
    return out.select(*columns) if columns else out


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_ledger(events: DataFrame, path: str) -> None:
    """One JSON object a line; files are only ever added."""
    events.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole lines of a ledger; torn ones and those that are no object of the schema are skipped."""
    raw = spark.read.schema(f"{schema}, _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    return raw.where("_torn is null").drop("_torn")


def factors_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """name, expression, description of every factor in JSON objects {name: {expression, description}}."""
    body = F.from_json(F.col(column), "map<string, struct<expression: string, description: string>>")
    return rows.select(F.explode(body).alias("name", "x")).select("name", "x.*")


# Keyed stores -------------------------------------------------------------------------


def put(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append (key, value, seq); nothing is rewritten."""
    rows.select("key", "value", "seq").write.mode("append").parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """key, value of the greatest seq of each key."""
    w = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("value").desc())
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "value")


def compact(spark: SparkSession, path: str, out: str) -> None:
    """A new store with the latest rows only; the old one stays until its readers are done."""
    latest(spark.read.parquet(path)).withColumn("seq", F.lit(0).cast("long")).write.parquet(out)


class SignalCache:
    """Values of expressions over a panel, one Parquet folder an expression, named by its md5."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def key(self, expr: str) -> str:
        import hashlib

        return hashlib.md5(expr.encode()).hexdigest()

    def known(self) -> set[str]:
        """Keys whose folder is complete (it has the mark that a finished write leaves)."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        disk = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not disk.exists(root):
            return set()
        found = [s.getPath() for s in disk.listStatus(root) if s.isDirectory()]
        return {p.getName().split("=", 1)[1] for p in found if "=" in p.getName() and disk.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}

    def get(self, expr: str, panel: Callable[[], DataFrame]) -> DataFrame:
        """instrument, datetime, v; computed and stored the first time."""
        at = f"{self.path}/expr_md5={self.key(expr)}"
        if self.key(expr) not in self.known():
            evaluate(panel(), {"v": expr}).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def status(self, library: DataFrame) -> DataFrame:
        """expr, key, cached for a library (expr), and rows without expr for orphans of the cache."""
        have = self.spark.createDataFrame([(k,) for k in sorted(self.known())], "key string").withColumn("cached", F.lit(True))
        want = library.select("expr", F.md5("expr").alias("key"))
        return want.join(have, "key", "full").select("expr", "key", F.coalesce("cached", F.lit(False)).alias("cached"))

    def _remove(self, keys) -> None:
        for k in keys:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/expr_md5={k}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def prune(self, library: DataFrame) -> int:
        """Remove the orphans; how many there were."""
        gone = [r.key for r in self.status(library).where("expr is null").collect()]
        self._remove(gone)
        return len(gone)

    def warm(self, exprs: list[str], panel: Callable[[], DataFrame]) -> int:
        """Compute all missing expressions in one pass over the panel; how many there were."""
        missing = [e for e in dict.fromkeys(exprs) if self.key(e) not in self.known()]
        if missing:
            wide = evaluate(panel(), {f"v{i}": e for i, e in enumerate(missing)}).persist()
            for i, e in enumerate(missing):
                wide.select("instrument", "datetime", F.col(f"v{i}").alias("v")).write.mode("overwrite").parquet(f"{self.path}/expr_md5={self.key(e)}")
            wide.unpersist()
        return len(missing)

    def repair(self) -> int:
        """Remove folders of unfinished writes; how many there were."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        disk = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = {s.getPath().getName().split("=", 1)[-1] for s in disk.listStatus(root) if s.isDirectory()} if disk.exists(root) else set()
        torn = names - self.known()
        self._remove(torn)
        return len(torn)


def memo(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a stored table, computed once a key however often and wherever it is asked for."""
    return _stored(spark, f"{path.rstrip('/')}/memo={key}", make)


def _stored(spark: SparkSession, at: str, make: Callable[[], DataFrame]) -> DataFrame:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


@dataclass
class Session:
    """A run of named steps, each stored when done; a new run of the same path goes on where the last one ended."""

    spark: SparkSession
    path: str
    done: list[str] = field(default_factory=list)

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        self.done.append(name)
        return _stored(self.spark, f"{self.path.rstrip('/')}/{len(self.done):03d}-{name}", make)


# Configuration ------------------------------------------------------------------------


@dataclass(frozen=True)
class Protocol:
    """What an evaluation is held to; unknown names, wrong types and impossible values are errors."""

    train_end: str = "1998-01-01"
    test_end: str = "2001-12-31"
    topk: int = 10
    n_drop: int = 2
    decay_splits: int = 5
    decay_lambda: float = 0.5
    turnover_cost: float = 0.0005
    seeds: tuple = (1, 2, 3)

    @classmethod
    def load(cls, text: str) -> Protocol:
        """From JSON or from ``name: value`` lines."""
        try:
            given = json.loads(text)
        except ValueError:
            lines = (x.split("#", 1)[0] for x in text.splitlines())
            given = {k.strip(): _value(v.strip()) for k, _, v in (x.partition(":") for x in lines if x.strip())}
        known = {f.name: f for f in fields(cls)}
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        for k, v in given.items():
            default = known[k].default
            if isinstance(default, tuple):
                given[k] = tuple(v)
            elif isinstance(default, float) and isinstance(v, int) and not isinstance(v, bool):
                given[k] = float(v)
            elif not isinstance(v, type(default)):
                raise ValueError(f"{k} must be {type(default).__name__}, not {v!r}")
        out = cls(**given)
        if not out.train_end < out.test_end:
            raise ValueError("train_end must come before test_end")
        if not 0 < out.n_drop <= out.topk or out.decay_splits < 2 or not out.seeds:
            raise ValueError("n_drop must be from 1 to topk, decay_splits 2 or more, and there must be a seed")
        return out

    def key(self) -> str:
        """A hash of all settings, the same for the same settings."""
        import hashlib

        return hashlib.sha256(json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, sort_keys=True).encode()).hexdigest()


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


# Documents ----------------------------------------------------------------------------

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|\bT\*|\bTd\b|\bET\b")
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")


def pdf_text(raw: bytes) -> str:
    """Literal strings that the content streams of a PDF show; a broken stream is skipped."""
    out = []
    for head, body in _STREAM.findall(raw):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        for m in _SHOWN.findall(body):
            if m[:1] == b"(":
                plain = _ESCAPE.sub(lambda x: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(x[1], x[1] if not x[1].isdigit() else bytes([int(x[1], 8) & 255])), m[1:-1])
                out.append(plain.decode("latin-1"))
            else:
                out.append("\n")
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every PDF under a folder."""

    def run(batches):
        for b in batches:
            texts = [pdf_text(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


# Queries ------------------------------------------------------------------------------

EXPR = "TS_MEAN($close, 5) / $close"


def q_csv(spark, d):
    path = fresh(spark, "csv")
    write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), path)
    return read_csv(spark, path, "p_partkey long, p_name string, p_brand string, p_retailprice double", ["p_partkey", "p_name"])


def q_json(spark, d):
    path = fresh(spark, "json")
    table(spark, d, "supplier").select("s_suppkey", "s_name", F.struct("s_nationkey", "s_acctbal").alias("metrics")).write.json(path)
    out = spark.read.schema("s_suppkey long, s_name string, metrics struct<s_nationkey: int, s_acctbal: double>").json(path)
    return out.select("s_suppkey", "s_name", "metrics.*")


def q_ledger(spark, d):
    """Two appends and a folder of torn lines; only whole events are read."""
    path, e = fresh(spark, "ledger"), table(spark, d, "events")
    schema = "event_id long, user_id long, event_type string"
    append_ledger(e.where("event_type = 'purchase'").select("event_id", "user_id", "event_type"), path)
    append_ledger(e.where("event_type = 'signup'").select("event_id", "user_id", "event_type"), path)
    torn = e.where("event_type = 'error'").select(F.expr("concat('{\"event_id\": ', event_id, ', \"user_id')"))
    torn.write.mode("append").text(path)
    return read_ledger(spark, path, schema)


def q_keyed_store(spark, d):
    """The latest event of each user, from two appends."""
    path, e = fresh(spark, "keyed"), table(spark, d, "events")
    rows = e.select(F.md5(F.col("user_id").cast("string")).alias("key"), "event_type", F.col("event_type").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("seq"))
    put(spark, path, rows.where("event_type in ('view', 'click')"))
    put(spark, path, rows.where("event_type not in ('view', 'click')"))
    return latest(spark.read.parquet(path))


def q_conversation_log(spark, d):
    """Conversations as JSON files by role, read back whole."""
    path = fresh(spark, "talk")
    table(spark, d, "conversations").write.partitionBy("role").json(path)
    out = spark.read.schema("conv_id long, turn long, text string, role string").json(path)
    return out.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def q_signal_cache(spark, d):
    cache = SignalCache(spark, fresh(spark, "signals"))
    cache.warm([EXPR, "$close - $open"], lambda: bars(spark, d))
    out = cache.get(EXPR, lambda: bars(spark, d))
    return out.select("instrument", "datetime", (F.round("v", 6) + 0.0).alias("v"))


def q_cache_status(spark, d):
    """One expression is cached, one missing, one an orphan."""
    cache = SignalCache(spark, fresh(spark, "signals"))
    cache.warm([EXPR, "$close - $open"], lambda: bars(spark, d))
    return cache.status(spark.createDataFrame([(EXPR,), ("$high - $low",)], "expr string"))


def q_parquet_sink(spark, d):
    """Two factors of one pass, stored by year and read back by it."""
    path = fresh(spark, "factors")
    wide = evaluate(bars(spark, d), {"a": "$close - $open", "b": EXPR}).withColumn("year", F.year("datetime"))
    wide.write.partitionBy("year").parquet(path)
    out = spark.read.parquet(path).where("year = 1997")
    return out.select("instrument", "datetime", *((F.round(c, 6) + 0.0).alias(c) for c in "ab"))


def q_json_factors(spark, d):
    """Factor definitions from JSON objects, one a brand, checked by the parser's own fields."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("n"))
    text = F.to_json(F.create_map("p_brand", F.struct(F.concat(F.lit("TS_MEAN($close, "), F.col("n"), F.lit(")")).alias("expression"), F.lit("mean").alias("description"))))
    return factors_from_json(p.select(text.alias("json")))


def q_memo(spark, d):
    path = fresh(spark, "memo")
    make = lambda: table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    memo(spark, path, "status", make)
    return memo(spark, path, "status", lambda: (_ for _ in ()).throw(AssertionError("computed twice")))


def q_session(spark, d):
    path = fresh(spark, "session")
    first = Session(spark, path)
    first.step("orders", lambda: table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    again = Session(spark, path)
    orders = again.step("orders", lambda: (_ for _ in ()).throw(AssertionError("computed twice")))
    return again.step("customers", lambda: orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))


_W5 = "over (partition by instrument order by datetime rows between 4 preceding and current row)"


def _bars_sql() -> str:
    from factorloom.sources.panel import BARS_SQL

    return BARS_SQL


_Q = {
    "store_csv": (q_csv, "select p_partkey, p_name from part"),
    "store_json": (q_json, "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"),
    "store_ledger": (q_ledger, "select event_id, user_id, event_type from events where event_type in ('purchase', 'signup')"),
    "store_keyed": (
        q_keyed_store,
        "select md5(cast(user_id as varchar)) as key, event_type as value from events qualify row_number() over (partition by user_id order by epoch_us(ts) * 1000 + event_id % 1000 desc, event_type desc) = 1",
    ),
    "store_conversations": (q_conversation_log, "select conv_id, turn, role, md5(coalesce(text, '')) as text_md5 from conversations"),
    "store_signal_cache": (q_signal_cache, f"with {_bars_sql()} select instrument, datetime, round(avg(close) {_W5} / close, 6) + 0.0 as v from bars"),
    "store_cache_status": (
        q_cache_status,
        f"select '{EXPR}' as expr, md5('{EXPR}') as key, true as cached union all select '$high - $low', md5('$high - $low'), false union all select null, md5('$close - $open'), true",
    ),
    "store_parquet_sink": (
        q_parquet_sink,
        f"with {_bars_sql()}, f as (select instrument, datetime, round(close - open, 6) + 0.0 as a, round(avg(close) {_W5} / close, 6) + 0.0 as b from bars) select * from f where year(datetime) = 1997",
    ),
    "store_json_factors": (q_json_factors, "select p_brand as name, 'TS_MEAN($close, ' || max(p_size) || ')' as expression, 'mean' as description from part group by 1"),
    "store_memo": (q_memo, "select o_orderstatus, count(*) as n from orders group by 1"),
    "store_session": (q_session, "select o_custkey, count(*) as n from orders group by 1"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items()}
