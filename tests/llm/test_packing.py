import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from factorloom.llm import packing

ODD = ["it's we'll x'sy !'s 12's", "a\n\nb  \n c", "x\t\ty  ", "foo<|endoftext|>bar <|endoftext|>", "é,è. “q” —x", "\x00\x01a b\x1cc", "  ", "  x 　y", ""]


def plain(texts):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_units_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab1 2.,'\n\t s!é— <|") for _ in range(60)) for _ in range(3000)] + ["long words " * 200_000]
    got = packing.UnitTokenizer(packing.tokenizer_path()).encode(texts)
    assert [x.tolist() for x in got] == plain(texts)


def test_pieces_are_the_ids_of_their_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*ODD, None, None])], "doc_id long, text string"))
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text or "" for r in rows]), strict=True))
    pieces = packing.pack_documents(docs, packing.tokenizer_path(), window=64, open_windows=3).collect()
    for r in pieces:
        ids = np.array([*want[r.doc_id], packing.END_ID], np.uint32)
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in pieces) == sum(len(x) + 1 for x in want.values())


def test_ties_nulls_and_clashing_columns(spark):
    rows = [(1, "a b c", 7, "x"), (1, "a b c", 7, "x"), (None, None, None, None), (2, "", 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long, ids string")
    pieces = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pieces) == [("1", 4), ("1", 4), ("2", 1), ("None", 1)]


def test_little_padding():
    fill = []
    packer = packing.Packer(2048, 32, lambda pieces: fill.append(sum(len(p[2]) for p in pieces)))
    rng = random.Random(2)
    for k in range(3000):
        packer.add(k, 0, np.zeros(rng.randint(1, 3000), np.uint32), 0)
    assert max(fill) <= 2048 and 1 - np.mean(fill) / 2048 < 0.01
