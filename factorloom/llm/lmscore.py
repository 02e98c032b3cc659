"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Documents are put into blocks, rows of the shared folder.  A task sends the sorted, delta-coded
hashes of a block's distinct tokens and bigrams, with their counts in its training rows, to
ranges of the hash space.  Tokens keep exact counts.  The bigrams of a range go into a
Bloom filter of its own: one of quantised count q (1 + floor(log2 c)) is entered at levels
1..q.  A reader probes level after level until one is absent.  The range answers each
block in the order of the block's hashes, and a block meets its answers in one task, which
hashes its texts again: each table is held by one task, and the driver gets two sums.

Smoothing: p(w | h) = (c(h w) + MU p(w)) / (c(h) + MU), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

Defined results: a null or empty text is the end token alone; equal texts have equal
scores; without training rows all counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import SPACE_SEPARATORS, binary_columns, chunks, lower_ascii, mix64, only, read_table, small_batches, word_hashes, word_spans, written
from factorloom.llm.jaccard import _pack, _planes, _unpack, _unplanes

MU = 1000.0
#: Probes per level, and bits per entry.
PROBES = 5
ENTRY_BITS = 7.3
MAX_LEVEL = 40
#: Tokens or bigrams of one hash range, about.
RANGE_ENTRIES = 2_000_000
#: Bytes of the texts of one block; a longer text is a block by itself.
BLOCK_BYTES = 8 << 20
END = np.uint64(0x5851F42D4C957F2D)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Per run of texts: (lo, hi, token hashes with an end after each text, ends of texts among them)."""
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        low = lower_ascii(data[base : offsets[hi]])
        s, e, doc = word_spans(low, offsets[lo : hi + 1] - base, SPACE_SEPARATORS)
        ends = np.searchsorted(doc, np.arange(hi - lo), side="right")
        yield lo, hi, np.insert(word_hashes(low, s, e), ends, END), ends + np.arange(1, hi - lo + 1)


def _bigrams(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a text follows an end."""
    before = np.concatenate((np.array([END], np.uint64), tokens[:-1]))
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) ^ tokens)


def _positions(h: np.ndarray, level: int, size: np.ndarray | int):
    a = mix64(h + np.uint64((0xD1342543DE82EF95 * level) & (2**64 - 1)))
    b = mix64(a ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for k in range(PROBES):
        yield ((a + np.uint64(k) * b) >> np.uint64(11)) % np.asarray(size, np.uint64)


def _filter(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits (packed) of the filter of one range."""
    levels = np.minimum(1 + np.floor(np.log2(counts)).astype(np.int64), MAX_LEVEL)
    size = max(64, math.ceil(ENTRY_BITS * int(levels.sum()) / 8) * 8)
    bits = np.zeros(size, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        part = h[levels >= q]
        for at in _positions(part, q, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def _levels(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Greatest level up to which every probe of a range's filter is found."""
    out = np.zeros(len(h), np.uint8)
    live = np.arange(len(h))
    for q in range(1, MAX_LEVEL + 1):
        if not len(live):
            break
        ok = np.ones(len(live), bool)
        for at in _positions(h[live], q, 8 * len(bits)):
            at = at.astype(np.int64)
            ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        live = live[ok]
        out[live] = q
    return out


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """block, wanted (by any row), rows: those of a block (head, text, learn, wanted), as an Arrow stream."""

    def gather(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            wanted = any(any(part.column(part.schema.get_field_index("wanted")).to_pylist()) for part in held)
            values = (uuid.uuid4().int >> 65, wanted, _stream(held))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["block", "wanted", "rows"])

        for b in batches:
            offsets = binary_columns(b, "text")[1]
            for lo, hi in chunks(offsets, limit):
                n = int(offsets[hi] - offsets[lo])
                if held and size + n > limit:
                    yield flush()
                    held, size = [], 0
                held.append(b.slice(lo, hi - lo))
                size += n
        if held:
            yield flush()

    return rows.mapInArrow(gather, "block long, wanted boolean, rows binary")


def _opened(blob: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block, hashes of their tokens and of the bigrams, ends of the texts among them."""
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    rows = table.to_batches()[0]
    tokens, bigrams, ends, n = [], [], [], 0
    for _, _, t, e in _tokens(*binary_columns(rows, "text")):
        tokens.append(t)
        bigrams.append(_bigrams(t))
        ends.append(e + n)
        n += len(t)
    return rows, np.concatenate(tokens), np.concatenate(bigrams), np.concatenate(ends)


def _answered(blocks: DataFrame, bits: int) -> DataFrame:
    """kind (0 tokens, 1 bigrams), bucket, block, answer: counts (tokens) or levels (bigrams) of a block's distinct
    hashes in a range, in their order; and a row per range without a block, with its distinct and all entries."""

    def send(batches):
        for b in batches:
            for block, wanted, blob in zip(*(b.column(b.schema.get_field_index(x)) for x in ("block", "wanted", "rows")), strict=True):
                rows, tokens, bigrams, ends = _opened(blob.as_py())
                learn = np.repeat(rows.column(rows.schema.get_field_index("learn")).to_numpy(zero_copy_only=False).astype(bool), np.diff(ends, prepend=0))
                cols: list[list] = [[], [], [], [], []]
                for kind, hashes in enumerate((tokens, bigrams)):
                    every, back = np.unique(hashes, return_inverse=True)
                    count = np.bincount(back[learn], minlength=len(every))
                    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
                    edges = np.concatenate(([0], np.searchsorted(every, starts), [len(every)]))
                    for k in np.flatnonzero(np.diff(edges)):
                        part = slice(edges[k], edges[k + 1])
                        for c, v in zip(cols, (kind, int(k), block.as_py() if wanted.as_py() else None, _pack(every[part]), _planes(count[part], 5)), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "bucket", "block", "keys", "counts"])

    def reply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, bucket = key[0].as_py(), key[1].as_py()
        have, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts, held = [], [], 0
        asked: list[tuple[int, bytes]] = []

        def fold():
            nonlocal have, total, keys, counts, held
            every, n = np.concatenate([have, *keys]), np.concatenate([total, *counts])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            have, total = every[first], np.add.reduceat(n, first) if len(first) else n
            keys, counts, held = [], [], 0

        def out(blocks, answers, entries=None, n=None):
            cols = ([kind] * len(blocks), [bucket] * len(blocks), blocks, answers, [entries] * len(blocks), [n] * len(blocks))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "bucket", "block", "answer", "entries", "total"])

        for b in batches:
            for block, k, c in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("block", "keys", "counts")), strict=True):
                if block is not None:
                    asked.append((block, k))
                n = _unplanes(c, 5).astype(np.int64)
                keys.append(_unpack(k)[n > 0])
                counts.append(n[n > 0])
                held += len(keys[-1])
                if held > 4 * RANGE_ENTRIES:
                    fold()
        fold()
        yield out([None], [None], len(have), int(total.sum()))
        if kind:
            filter_bits = _filter(have, total)
            have = total = np.zeros(0, np.int64)
        while asked:
            # Many small questions are looked up together.
            some, n = [], 0
            while asked and n < RANGE_ENTRIES // 4:
                block, k = asked.pop()
                some.append((block, _unpack(k)))
                n += len(some[-1][1])
            h = np.concatenate([x for _, x in some])
            if kind:
                found = _levels(filter_bits, h)
            else:
                at = np.minimum(np.searchsorted(have, h), max(0, len(have) - 1))
                found = np.where(have[at] == h, total[at], 0) if len(have) else np.zeros(len(h), np.int64)
            parts = np.split(found, np.cumsum([len(x) for _, x in some])[:-1])
            yield out([block for block, _ in some], [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) if kind else _planes(x) for x in parts])

    sent = blocks.mapInArrow(send, "kind long, bucket long, block long, keys binary, counts binary")
    return sent.groupBy("kind", "bucket").applyInArrow(reply, "kind long, bucket long, block long, answer binary, entries long, total long")


def _expected(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts that a level stands for."""
    return np.where(levels > 0, 0.75 * 2.0**levels - 0.5, 0.0)


def score(docs: DataFrame, training: DataFrame | Column, mu: float = MU) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) but text, and n_tokens, n_known, train_tokens, base_score, score.

    ``training`` has the texts to learn from, or is a condition on the rows of ``docs``.
    """
    small_batches(docs.sparkSession)
    names = [f for f in docs.columns if f != "text"]
    others = F.struct(*(F.col(f"`{f}`") for f in names)).alias("head")
    if isinstance(training, Column):
        rows = docs.select(others, "text", F.coalesce(training, F.lit(False)).alias("learn"), F.lit(True).alias("wanted"))
    else:
        rows = docs.select(others, "text", F.lit(False).alias("learn"), F.lit(True).alias("wanted"))
        rows = rows.unionByName(training.select(F.lit(None).cast(rows.schema["head"].dataType).alias("head"), "text", F.lit(True).alias("learn"), F.lit(False).alias("wanted")))
    size = rows.agg(F.sum(F.when(F.col("learn"), F.octet_length("text"))), F.sum(F.octet_length("text"))).first()
    # By what is learnt; a range answers for at most about twice as many entries, however much is asked.
    bits = max(0, *(math.ceil(math.log2(max(1, (x or 0) / 6 / n))) for x, n in zip(size, (RANGE_ENTRIES, 2 * RANGE_ENTRIES), strict=True)))
    blocks = written(_blocks(rows, BLOCK_BYTES), "blocks")
    answers = written(_answered(blocks, bits), "answers")
    found = answers.where("block is null and kind = 0").agg(F.sum("total"), F.sum("entries")).first()
    N, V = found[0] or 0, found[1] or 0

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, tokens, bigrams, ends = _opened(left.column("rows")[0].as_py())
        parts: list[list] = [[], []]
        for kind, bucket, answer in zip(*(right.column(x).to_pylist() for x in ("kind", "bucket", "answer")), strict=True):
            parts[kind].append((bucket, answer))
        counts, levels = (sorted(p, key=lambda x: x[0]) for p in parts)
        c = np.concatenate([_unplanes(x) for _, x in counts]).astype(np.int64)[np.unique(tokens, return_inverse=True)[1]]
        q = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for _, x in levels])[np.unique(bigrams, return_inverse=True)[1]]
        p = (c + 0.5) / (N + 0.5 * (V + 1))
        first = np.concatenate(([0], ends[:-1]))
        # The context of a text's first token is an end; if any end was counted, one ended each text.
        context = np.concatenate(([0], c[:-1]))
        context[first] = c[ends - 1]
        together = np.minimum(np.minimum(_expected(q), c), context)
        known = np.add.reduceat((c > 0).astype(np.int64), first)
        base = np.add.reduceat(np.log10(p), first)
        full = np.add.reduceat(np.log10((together + mu * p) / (context + mu)), first)
        more = [pa.array(np.diff(ends, prepend=0)), pa.array(known), pa.array(np.full(len(ends), N, np.int64)), pa.array(base), pa.array(full)]
        head = rows.column(rows.schema.get_field_index("head"))
        done = pa.RecordBatch.from_arrays([*head.flatten(), *more], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return pa.table({"rows": pa.array([_stream([done.filter(rows.column(rows.schema.get_field_index("wanted")))])], pa.binary())})

    def unpacked(batches):
        # Not by ``finish`` itself: Spark holds its types, time zones of columns too, to the letter.
        for b in batches:
            for blob in b.column(0):
                yield from pa.ipc.open_stream(blob.as_py())

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    shape = f"{head}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = answers.where("block is not null").select("kind", "bucket", "block", "answer")
    scored = blocks.where("wanted").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(finish, "rows binary")
    # Written in between, as two functions in one stage keep two Python workers a task.
    return written(scored, "scored").mapInArrow(unpacked, shape)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return score(docs, ~held_out()).withColumn("held_out", held_out())
