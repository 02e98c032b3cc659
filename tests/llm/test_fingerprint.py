import hashlib
import random
import re

import pytest
import xxhash

from factorloom.llm import fingerprint

SEED = 42


def sketch(text):
    """Retained shingle hashes of a text, by plain hashing."""
    words = [w for w in re.split("[\t-\r ]+", text.lower()) if w]
    if not words:
        return []
    h = [xxhash.xxh64_intdigest(w.encode(), SEED) for w in words]
    every = []
    for i in range(max(1, len(h) - 4)):
        x = SEED
        for v in h[i : i + 5]:
            x = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), x)
        every.append(x & 0xFFFFFFFF)
    return sorted({x for x in every if x < (1 << 32) // fingerprint.SCALE}) or [min(every)]


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return len(set(a) & set(b)) / min(len(a), len(b))


def expected(rows):
    """doc rows -> the query's rows, by sorting everything."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        hexes = lambda s: "".join(f"{x:08x}" for x in s)
        out.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), hexes(a), hexes(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out)


def actual(spark, tmp_path, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sketch string, __block int")
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op10_query(spark, str(tmp_path)).collect()
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice("aa bb cc dd ee é ff gg hh ii".split()) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["plain", "hashed", "outlier", "two clusters"])
def test_query_matches_plain_hashing(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    ids = {
        "plain": list(range(300)),
        "hashed": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)],
        "outlier": [*range(299), (1 << 63) - 1],
        "two clusters": [*range(150), *range(1 << 40, (1 << 40) + 150)],
    }[kind]
    rows = list(zip(ids, texts(300), strict=True)) + [(None, None), (-(1 << 63), ""), (None, "no id here at all")]
    assert actual(spark, tmp_path, rows) == expected(rows)


def test_small_tables(spark, tmp_path):
    for rows in ([(1, "only one text of a few words here")], [(5, None), (2, "x " * 50_000)], [(1 << 62, "a"), (-(1 << 62), "b"), (0, "c")]):
        assert actual(spark, tmp_path, rows) == expected(rows)
    docs = spark.createDataFrame([], "doc_id long, text string")
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert fingerprint.op10_query(spark, str(tmp_path)).count() == 0
