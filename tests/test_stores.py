import zlib

import pytest

from factorloom.sources import stores as S


def test_a_torn_ledger(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_id": 1, "user_id": 2, "event_type": "x"}\n{"event_id": 2, "us\n[1, 2]\n\n{"event_id": "word"}\n')
    got = S.read_ledger(spark, f"file://{tmp_path}", "event_id long, user_id long, event_type string").collect()
    assert [tuple(r) for r in got if r.event_id is not None] == [(1, 2, "x")]


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, "line\nbreak"), (3, None)], "k long, v string")
    S.write_csv(rows, f"file://{tmp_path}/c")
    assert sorted(map(tuple, S.read_csv(spark, f"file://{tmp_path}/c", "k long, v string").collect())) == [(1, 'a "b", c'), (2, "line\nbreak"), (3, None)]


def test_keyed_store_compacts(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    for seq, v in enumerate("abc"):
        S.put(spark, path, spark.createDataFrame([("k", v, seq), (f"k{seq}", v, seq)], "key string, value string, seq long"))
    S.compact(spark, path, f"{path}2")
    got = {r.key: r.value for r in S.latest(spark.read.parquet(f"{path}2")).collect()}
    assert got == {"k": "c", "k0": "a", "k1": "b", "k2": "c"}


def test_signal_cache(spark, sf_dir, tmp_path):
    from factorloom.sources.panel import bars

    cache = S.SignalCache(spark, f"file://{tmp_path}/signals")
    assert cache.warm(["$close", "$open", "$close"], lambda: bars(spark, sf_dir)) == 2
    assert cache.warm(["$close"], lambda: 1 / 0) == 0
    cache.get("$close", lambda: 1 / 0).count()
    (tmp_path / "signals" / "expr_md5=torn").mkdir()
    assert cache.repair() == 1
    assert cache.prune(spark.createDataFrame([("$close",)], "expr string")) == 1 and cache.known() == {cache.key("$close")}


def test_protocols():
    p = S.Protocol.load("topk: 20\nn_drop: 3  # few\ndecay_lambda: 1\nseeds: [4, 5]\n")
    assert (p.topk, p.decay_lambda, p.seeds) == (20, 1.0, (4, 5)) and p.key() == S.Protocol.load('{"topk": 20, "n_drop": 3, "decay_lambda": 1.0, "seeds": [4, 5]}').key() != S.Protocol().key()
    for bad in ("colour: 1", "topk: word", "n_drop: 99", "train_end: 2030-01-01", '{"seeds": []}'):
        with pytest.raises(ValueError):
            S.Protocol.load(bad)


def test_pdf_text(spark, tmp_path):
    body = rb"BT /F1 12 Tf (Hello \(there\)) Tj T* (second\040line) Tj ET"
    raw = b"%PDF-1.4\n1 0 obj <</Length 9 /Filter /FlateDecode>> stream\n" + zlib.compress(body) + b"\nendstream\n2 0 obj <</Length 3>> stream\nBT (plain) Tj ET\nendstream\n<</Filter /FlateDecode>> stream\nbroken\nendstream"
    (tmp_path / "a.pdf").write_bytes(raw)
    got = S.read_pdfs(spark, f"file://{tmp_path}").collect()
    assert got[0].text == "Hello (there)\nsecond line\nplain"


def test_sessions_go_on(spark, tmp_path):
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n)
    for _ in range(2):
        s = S.Session(spark, f"file://{tmp_path}/run")
        assert s.step("a", make(3)).count() == 3 and s.step("b", make(4)).count() == 4
    assert made == [3, 4]
