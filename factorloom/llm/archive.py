"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id.  Ids whose hash is a multiple of a number may begin a
shard, wherever the ids are; exact byte counts between them choose those that do, so the
same table gives the same files whatever the cluster.  Within a shard files roll when
their compressed size passes ``ROLL_BYTES``.  Every record is a gzip member of its own with
headers, ids and SHA-1 digests made anew from the payload.  A file is written under a
temporary name and renamed when complete; the manifest, a file renamed into the folder
last, lists what counts, and what failed attempts left is removed.  A rerun writes the
same bytes under the same names.

Of records with equal payloads of ``MIN_SHARED`` bytes or more the one with the largest
page_id is the response and the others refer to it.

Defined results: a null html is an empty payload; rows with the same page_id and the same
payload are alike responses or alike revisits; a null url becomes an empty URI and a null
page_id is written as an empty id, sorts first and reads back as null; an empty table
gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import fresh_path, only, read_table, small_batches, written

MIN_SHARED = 1000
#: Compressed bytes at which a file is closed.
ROLL_BYTES = 64 << 20
#: Payload bytes of one shard, about; more where there would be over MOST_SHARDS, which bounds what the driver holds.
SHARD_BYTES = 32 << 20
MOST_SHARDS = 100_000
#: Ids that may begin a shard, for each shard, about.
CUTS = 8
# A fixed value, as the bytes must not depend on when they are written.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Sorts before every id: where rows without one go.
FIRST = -(1 << 63)
MANIFEST = "manifest.jsonl"
_MANIFEST = "path string, shard long, records long, bytes long, sha1 string"


def _filesystem(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One gzip member: a response, or a revisit of the page ``refers_to``."""
    digest = hashlib.sha1(payload).hexdigest()
    ident = "" if page_id is None else str(page_id)
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{ident}:{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Page-Id: {ident}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to}:{digest}')}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def _shards(pages: DataFrame) -> np.ndarray:
    """Ids at which a shard begins, sorted; the first shard begins before them."""
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.length("payload"))).first()
    want = min(MOST_SHARDS, max(1, -(-(size or 0) // SHARD_BYTES)))
    if want == 1:
        return np.zeros(0, np.int64)
    some = F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // (CUTS * want)))) == 0
    cuts = np.sort(np.array([r[0] for r in pages.where(F.col("page_id").isNotNull() & some).select("page_id").distinct().collect()], np.int64))

    def count(batches):
        for b in batches:
            at = np.searchsorted(cuts, b.column(0).to_numpy(), side="right")
            held = np.bincount(at, weights=b.column(1).to_numpy(), minlength=len(cuts) + 1).astype(np.int64)
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["bin", "bytes"])

    sizes = pages.select(F.coalesce("page_id", F.lit(FIRST)).alias("page_id"), F.length("payload").cast("long").alias("bytes"))
    held = dict(sizes.mapInArrow(count, "bin long, bytes long").groupBy("bin").agg(F.sum("bytes")).collect())
    begins, now = [], 0
    for k in range(len(cuts) + 1):
        if now * want >= size:
            begins.append(cuts[k - 1])
            now = 0
        now += held.get(k, 0)
    return np.array(begins, np.int64)


def _publish(manifest: DataFrame, path: str, attempt: str) -> None:
    """Write the manifest beside the archives, rename it last, and remove what this attempt left unfinished."""
    disk, root = _filesystem(path)
    disk.create_dir(root, recursive=True)
    temp = f"{root}/.tmp-{attempt}-manifest"
    with disk.open_output_stream(temp, compression=None) as f:
        for r in manifest.orderBy("path").toLocalIterator():
            f.write((json.dumps(r.asDict()) + "\n").encode())
    disk.move(temp, f"{root}/{MANIFEST}")
    for x in disk.get_file_info(pafs.FileSelector(root)):
        if x.base_name.startswith(f".tmp-{attempt}"):
            disk.delete_file(x.path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{path}/{MANIFEST}")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` under ``path``; the manifest (path, shard, records, bytes, sha1)."""
    spark = pages.sparkSession
    small_batches(spark, 64)
    src = only(pages, page_id="long", url="string", html="string")
    src = src.withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    sha1 = F.sha1("payload")
    marked = written(src.select("page_id", F.length("payload").alias("length"), sha1.alias("digest")).where(F.col("length") >= MIN_SHARED), "digests")
    shared = written(
        marked.groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("first <> last")
        .drop("first"),
        "payloads",
    )
    # Revisits as rows of their own, which sort just before their page.  A payload may be that of a
    # third of all pages: its lookup is spread over salts.
    salts = 64
    salted = shared.withColumn("salt", F.explode(F.when(F.col("n") > 10_000, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    hot = shared.where("n > 10000").select("digest", F.lit(salts).alias("salts"))
    looked = marked.join(hot, "digest", "left") if hot.head(1) else marked.withColumn("salts", F.lit(None).cast("int"))
    looked = looked.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("salts").cast("long")), F.lit(0)).cast("int"))
    revisits = looked.join(salted.select("digest", "salt", "last"), ["digest", "salt"]).where("page_id is null or page_id < last")
    notes = revisits.select("page_id", F.col("digest").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("last").alias("refers"))
    begins = _shards(src)
    rows = src.withColumn("refers", F.lit(None).cast("long")).unionByName(notes.distinct())

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins, ids.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(FIRST))))
    # A task a shard: shard numbers are partition numbers, not hashed to them.
    rows = rows.repartitionById(len(begins) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("payload").isNotNull(), "url", "payload")
    attempt = uuid.uuid4().hex

    def write(batches):
        out, state = [], {}
        disk, root = _filesystem(path)
        disk.create_dir(root, recursive=True)

        def close():
            if not state:
                return
            state["file"].close()
            name = f"part-{state['shard']:06d}-{state['seq']:04d}.warc.gz"
            disk.move(state["temp"], f"{root}/{name}")
            out.append((f"{path}/{name}", state["shard"], state["records"], state["bytes"], state["sha1"].hexdigest()))

        def start(shard: int, seq: int):
            close()
            temp = f"{root}/.tmp-{attempt}-{uuid.uuid4().hex}"
            state.update(file=disk.open_output_stream(temp, compression=None), temp=temp, shard=shard, seq=seq, records=0, bytes=0, sha1=hashlib.sha1())

        notes, at = {}, object()
        for b in batches:
            for page, url, payload, refers, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if page != at:
                    notes, at = {}, page
                if payload is None:
                    notes[url] = refers
                    continue
                if state.get("shard") != shard:
                    start(shard, 0)
                elif state["bytes"] >= ROLL_BYTES:
                    start(shard, state["seq"] + 1)
                raw = record(page, url, payload, notes.get(hashlib.sha1(payload).hexdigest()) if notes else None)
                state["file"].write(raw)
                state["sha1"].update(raw)
                state["records"] += 1
                state["bytes"] += len(raw)
        close()
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _MANIFEST.split(", ")])

    manifest = written(rows.select("page_id", "url", "payload", "refers", "shard").mapInArrow(write, _MANIFEST), "manifest")
    _publish(manifest, path, attempt)
    return manifest


def _records(stream, size: int = 1 << 20):
    """Decompressed members of an archive, one after another."""
    rest, unzip, parts = b"", zlib.decompressobj(31), []
    while chunk := rest or stream.read(size):
        rest = b""
        parts.append(unzip.decompress(chunk))
        if unzip.eof:
            yield b"".join(parts)
            rest, unzip, parts = unzip.unused_data, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict, bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; digests of responses are checked."""
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in _READ.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                disk, name = _filesystem(path)
                rows, held = [], 0
                with disk.open_input_stream(name, compression=None) as f:
                    for raw in _records(f):
                        h, body = parse(raw)
                        kind, digest, size = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if kind == "response":
                            size, found = len(body), hashlib.sha1(body).hexdigest()
                            if found != digest:
                                raise ValueError(f"{path}: payload of page {h['X-Page-Id']} does not match its digest")
                        to = h.get("X-Refers-To-Page-Id")
                        rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], kind, size, digest, int(to) if to else None, body if payloads else None))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, _READ)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(read_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as d from p),
r as (select *, max(page_id) over (partition by d, n) as last from q)
select page_id, n as payload_bytes, d as payload_digest,
  case when n >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < last then last end as refers_to
from r"""
