"""Benchmark decontamination by a broadcast set of normalised n-grams.

Every window of ``width`` consecutive item words (an item of fewer: its whole word
sequence) is hashed; the set is broadcast and the words of each document are scanned
by vectorised window hashes behind a bitmap.  A hash hit is verified word by word.

The broadcast is made only of benchmark blocks of at most ``BLOCK_BYTES`` of text; a
larger benchmark is scanned block by block and the findings are merged per document.

Defined results: null, empty or wordless texts have no words and no hits; so have
null items; repeated items count by item_id; an empty benchmark leaves every document
clean; documents with equal doc_id are reported one by one; columns other than those
named are kept out of the way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import (
    ALNUM_SEPARATORS,
    binary_columns,
    chunks,
    lower_ascii,
    only,
    read_table,
    small_batches,
    window_hashes,
    word_hashes,
    word_spans,
)

WIDTH = 10
#: Text bytes of the benchmark that one broadcast may hold.
BLOCK_BYTES = 32 << 20
_BITS = 1 << 22


class Index:
    """Windows of the items: hash -> [(words, item_ids)], by window length."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width = width
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, dict]] = {}
        found: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            low = lower_ascii(np.frombuffer(text.encode(), np.uint8))
            s, e, _ = word_spans(low, np.array([0, len(low)]), ALNUM_SEPARATORS)
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(s, e, strict=True)]
            size = min(width, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), set()).add(item)
        for size, windows in found.items():
            texts = list(windows)
            raw = np.frombuffer(b" ".join(texts), np.uint8)
            s, e, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM_SEPARATORS)
            hashes = window_hashes(word_hashes(raw, s, e), size)[::size]
            table: dict[int, list[tuple[bytes, set[str]]]] = {}
            for h, t in zip(hashes.tolist(), texts, strict=True):
                table.setdefault(h, []).append((t, windows[t]))
            bits = np.zeros(_BITS, bool)
            bits[(hashes & np.uint64(_BITS - 1)).astype(np.int64)] = True
            self.lengths[size] = bits, np.sort(hashes), table

    def scan(self, low: np.ndarray, offsets: np.ndarray):
        """Per text: word spans (start, end), a hit mask over them, and the items found."""
        s, e, doc = word_spans(low, offsets, ALNUM_SEPARATORS)
        hashes = word_hashes(low, s, e)
        marks = np.zeros(len(s) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, (bits, known, table) in self.lengths.items():
            h = window_hashes(hashes, size)
            at = np.flatnonzero(bits[(h & np.uint64(_BITS - 1)).astype(np.int64)])
            at = at[doc[at] == doc[at + size - 1]]
            pos = np.searchsorted(known, h[at])
            at = at[known[np.minimum(pos, len(known) - 1)] == h[at]]
            for i in at.tolist():
                words = b" ".join(low[s[k] : e[k]].tobytes() for k in range(i, i + size))
                for text, ids in table[int(h[i])]:
                    if text == words:
                        marks[i] += 1
                        marks[i + size] -= 1
                        items.setdefault(int(doc[i]), set()).update(ids)
        return s, e, doc, np.cumsum(marks[:-1]) > 0, items


def _cut(index: Index, raw: bytes) -> bytes:
    """``raw`` without hit spans, scanned again until nothing is found."""
    while True:
        low = lower_ascii(np.frombuffer(raw, np.uint8))
        s, e, _, hit, _ = index.scan(low, np.array([0, len(low)]))
        if not hit.any():
            return raw
        keep = np.ones(len(low), bool)
        edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            keep[s[a] : e[b - 1]] = False
        raw = np.frombuffer(raw, np.uint8)[keep].tobytes()


def _scan_block(docs: DataFrame, index, keep_text: bool) -> DataFrame:
    """Adds n_words, hit_spans (word positions, end exclusive), items and, if asked for, clean_text."""
    schema = docs.schema
    names = schema.names

    def run(batches):
        ix = index.value
        for b in batches:
            data, offsets = binary_columns(b, "text")
            low = lower_ascii(data)
            n_words, spans, found, clean = [], [], [], []
            for lo, hi in chunks(offsets):
                base = offsets[lo]
                s, e, doc, hit, items = ix.scan(low[base : offsets[hi]], offsets[lo : hi + 1] - base)
                count = np.bincount(doc, minlength=hi - lo)
                first = np.concatenate(([0], np.cumsum(count)))
                n_words += count.tolist()
                for k in range(hi - lo):
                    if k not in items:
                        spans.append([])
                        found.append([])
                        if keep_text:
                            clean.append(data[offsets[lo + k] : offsets[lo + k + 1]].tobytes())
                        continue
                    edge = np.diff(np.concatenate(([0], hit[first[k] : first[k + 1]].view(np.int8), [0])))
                    spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                    found.append(sorted(items[k]))
                    if keep_text:
                        clean.append(_cut(ix, data[offsets[lo + k] : offsets[lo + k + 1]].tobytes()))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            keep = [i for i, n in enumerate(names) if keep_text or n != "text"]
            cols = [*(b.column(i) for i in keep), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))]
            heads = [*(names[i] for i in keep), "n_words", "hit_spans", "items"]
            if keep_text:
                cols.append(pa.array(clean, pa.binary()).cast(pa.string()))
                heads.append("clean_text")
            yield pa.RecordBatch.from_arrays(cols, names=heads)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema if keep_text or f.name != "text"]
    more = ["n_words long", "hit_spans array<struct<begin:bigint,end:bigint>>", "items array<string>"]
    return docs.mapInArrow(run, ", ".join(kept + more + ["clean_text string"] * keep_text))


def _blocks(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(-(-size // BLOCK_BYTES)) or 1


def _block_index(benchmark: DataFrame, block: int, blocks: int, width: int):
    part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else benchmark
    items = [(r.item_id, r.text) for r in part.where("text is not null and item_id is not null").collect()]
    return benchmark.sparkSession.sparkContext.broadcast(Index(items, width))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, hit_spans, items (sorted as strings) of every document."""
    src = only(docs, doc_id="long", text="string")
    bench = only(benchmark, item_id="string", text="string")
    small_batches(src.sparkSession)
    blocks = _blocks(bench)
    if blocks == 1:
        return _scan_block(src, _block_index(bench, 0, 1, width), False)
    # Rows are told apart by a key of their own, as doc_ids may repeat.
    src = src.withColumn("row", F.xxhash64("doc_id", "text"))
    parts = [_scan_block(src, _block_index(bench, k, blocks, width), False) for k in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("copies"),
        F.flatten(F.collect_set("hit_spans")).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    positions = F.expr(
        "array_sort(array_distinct(flatten(transform(raw, s -> sequence(s.begin, s.end - 1)))))"
    )
    spans = F.expr("transform(words, w -> struct(w as begin, w + 1 as end))")
    return (
        merged.withColumn("words", positions)
        .withColumn("hit_spans", spans)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("copies") / blocks).cast("int"))))
        .select("doc_id", "n_words", "hit_spans", "items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, drop_share: float = 1.0) -> DataFrame:
    """The documents without the words of benchmark windows.

    Hit spans are cut from the text (again, if the cut joins words to a new hit);
    a document goes if at least ``drop_share`` of its words were hit.  All columns of
    ``docs`` are returned; n_chars, where present, is that of the text as returned.
    """
    columns = docs.columns
    text = docs.withColumn("text", F.col("text").cast("string"))
    bench = only(benchmark, item_id="string", text="string")
    small_batches(docs.sparkSession)
    blocks = _blocks(bench)
    for k in range(blocks):
        plain = text.select(F.struct("*").alias("row"), F.col("text"))
        scanned = _scan_block(plain, _block_index(bench, k, blocks, width), True)
        n_hit = F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.end - s.begin)")
        kept = scanned.where((n_hit == 0) | (n_hit < F.col("n_words") * drop_share))
        new = F.when(n_hit > 0, F.col("clean_text")).otherwise(F.col("row.text"))
        fields = {c: F.col(f"row.`{c}`") for c in columns} | {"text": new}
        if "n_chars" in columns:
            fields["n_chars"] = F.when(n_hit > 0, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        text = kept.select(*(fields[c].alias(c) for c in columns))
    return text


def op5_query(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.end - s.begin)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> dict:
    """Reference of the tests: doc_id -> (n_words, n_hit, items), by plain scanning."""
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = {c: c + 32 for c in range(0x41, 0x5B)}
    split = lambda t: pattern.findall((t or "").translate(fold))
    out = {}
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, body in items:
            w = split(body)
            n = min(width, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        out[doc] = len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return out
