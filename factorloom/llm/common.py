"""Shared plumbing: shared-folder tables, Arrow batch helpers and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at a time; bounds the numpy temporaries (about 50 x this).
CHUNK_BYTES = 1 << 20

SPACE_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII that is no digit and no lower-case letter (upper case is folded first).
ALNUM_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and there is no cluster (tests, a laptop) a local folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        shared_dir.own = path
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of the shared folder that this process wrote and nobody has dropped, oldest first.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    What was written survives the loss of executors, and is computed once however
    often it is read.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``written``, and the tables made after the first ``since`` ones dropped: nothing reads them any more."""
    out = written(df, name)
    for path in _made[since:-1]:
        drop_path(df.sparkSession, path)
    del _made[since:-1]
    return out


def n_made() -> int:
    return len(_made)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small: texts may be long, and a batch is held whole by a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast; clashing or extra columns of the caller play no part."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty texts."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return buf[base : int(offsets[-1]) if len(offsets) else 0], offsets - base


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs of whole texts of about ``limit`` bytes; a longer text is a run by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        one = np.ones(size, np.uint64)
        up, down = one.copy(), one
        up[1:] = _BASE
        down[1:] = _BASE_INV
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 8 * CHUNK_BYTES:
            _powers[0] = have
    return have


def _sep_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(separators, np.uint8)] = True
    return table


_SEPS = {s: _sep_table(s) for s in (SPACE_SEPARATORS, ALNUM_SEPARATORS)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(low: np.ndarray, offsets: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word of the concatenated texts."""
    word = ~_SEPS[separators][low]
    if not len(word):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(word))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by a prefix sum over position-weighted byte values."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix64(h + (end - start).astype(np.uint64) * _POS[0])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes (runs may cross texts; the caller masks those)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64) * _POS[1]
    for k in range(width):
        out += words[k : k + n] * _POS[2 + k % 60] ^ np.uint64(k)
    return mix64(out)


def long_list(values) -> pa.Array:
    return pa.array(values, pa.int64())
