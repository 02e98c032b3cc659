"""Nulls, empty and long texts, ties, empty tables and clashing columns, for operators without a file of their own."""

import hashlib

from factorloom.llm import chat, decontam, jaccard, lmscore, templates

CHAT = "conv_id long, turn long, role string, text string, rendered string, loss_start int"


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 300_000), (None, None, None, None), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (3, 0, "[INST]", "</s>")]
    rows = [(*r, "clash", 1) for r in rows]
    formatted = chat.format_conversations(spark.createDataFrame(rows, CHAT))
    for r in formatted.collect():
        assert [(a, b) for a, b, _, _ in chat.parse_turns(r.rendered)] == [(r.role, r.text)]
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 300_000 and got[None].n_turns == 1 and got[None].loss_chars == 0
    assert got[2].loss_sha256 == hashlib.sha256(b"aa").hexdigest() and got[3].turns_sha256 == hashlib.sha256(b"[INST]\n</s>\n").hexdigest()
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], CHAT))).count() == 0


def test_contamination(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "x " * 200_000 + item, "a", 1), (None, item.upper(), "a", 1), (None, item.upper(), "a", 1), (4, "short item here", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame([(7, item, 0), (8, "item here", 0), (9, None, 0), (10, "", 0), (7, item, 0)], "item_id long, text string, hit_spans int")
    got = sorted((str(r.doc_id), r.n_words, len(r["items"])) for r in decontam.find_contamination(docs, bench).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("3", 200_011, 1), ("4", 3, 1), ("None", 11, 1), ("None", 11, 1)]
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    # Documents of which every word was hit go; the long one loses the item alone.
    assert sorted((str(r.doc_id), len((r.text or "").split())) for r in kept.collect()) == [("1", 0), ("2", 0), ("3", 200_000), ("4", 1)]
    assert decontam.find_contamination(docs.where("false"), bench).count() == 0 and decontam.decontaminate(docs, bench.where("false")).count() == 6


def test_lines(spark):
    long = "many words in one line " * 40_000
    rows = [(1, long, "c", "r", 0), (2, long + "\nown", "c", "r", 0), (None, None, "c", "r", 0), (3, "", "c", "r", 0), (4, "\n".join(f"line {chr(97 + i % 26)} here" for i in range(20_000)), "c", "r", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drop string, row string, __n_lines int")
    out = templates.drop_templates(docs.drop("__n_lines"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: long, 2: "own", None: None, 3: "", 4: rows[4][1]}
    assert templates.deduplicated(docs).columns == docs.columns


def test_near_duplicates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, v string, n int")
    assert jaccard.near_duplicates(docs).count() == 0 and jaccard.keep_one(docs).columns == docs.columns


def test_scores(spark):
    rows = [(1, "a " * 200_000, "x", 0), (2, "", "x", 0), (2, "", "x", 0), (None, "a b", "x", 0), (None, "a b", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c string, q int").select("doc_id", "text")
    got = lmscore.score(docs, docs.where("doc_id = 1").select("text")).collect()
    assert len(got) == 5 and all(r.score <= 0 and r.train_tokens == 200_001 for r in got)
    assert len({(r.score, r.base_score) for r in got if r.doc_id is None}) == 1
    assert lmscore.score(docs, docs.where("false").select("text")).where("n_known <> 0").count() == 0
