import zlib

import numpy as np

from factorloom.llm import toxicity


def plain_logit(model, text):
    """A document's logit, word by word and window by window."""
    raw = (text or "").encode()
    w = toxicity.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    at, grams = 0, []
    for n in w.size:
        grams.append(model.grams[w.gram[at : at + n]].mean(0))
        at += n
    words = [np.concatenate([model.words[model.rows[w.word[i]]], grams[i]]) for i in w.index]
    p, h = model.net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(d, xs):
        s, out = np.zeros(h), []
        for x in xs if d == "f" else xs[::-1]:
            a, u = x @ p[f"W{d}"] + p[f"c{d}"], p[f"U{d}"]
            r, z = np.split(sig(a[: 2 * h] + s @ u[:, : 2 * h]), 2)
            s = s + z * (np.tanh(a[2 * h :] + (r * s) @ u[:, 2 * h :]) - s)
            out.append(s)
        return out if d == "f" else out[::-1]

    best = -np.inf
    for start in toxicity.windows(len(words)):
        xs = words[start : start + toxicity.WINDOW]
        n = len(xs)
        xs = xs + [np.zeros(toxicity.FEATURES)] * (toxicity.WINDOW - n)
        states_ = np.array([np.concatenate(x) for x in zip(states("f", xs), states("b", xs), strict=True)])
        e = (np.tanh(states_ @ p["A"]) @ p["a"])[:, 0] + np.where(np.arange(len(xs)) < n, 0, -30)
        weight = np.exp(e - e.max())
        best = max(best, float((weight / weight.sum()) @ states_ @ p["o"][:, 0] + p["z"][0]))
    return best


def test_query_against_a_plain_network(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in toxicity.op9_query(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for d in sorted(texts, key=lambda d: len(texts[d] or ""))[:40]:
        want = 1 / (1 + np.exp(-(model.scale[0] * plain_logit(model, texts[d]) + model.scale[1])))
        assert abs(got[d].score - want) < 1e-3
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t, set()).add(round(got[d].score, 5))
    assert all(len(s) == 1 for s in by_text.values())


def test_odd_rows_and_columns(spark):
    rows = [(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "  \n ", 3.0), (3, "word " * 60_000, 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __score double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (None, 1), (5, 7)], "doc_id long, toxic int")
    scored, name = toxicity.score(docs, toxicity.train(docs, labels))
    got = scored.collect()
    assert len(got) == 5 and scored.columns == ["doc_id", "text", "__score", name] and len({r[name] for r in got if not (r.text or "").strip()}) == 1
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    none = spark.createDataFrame([], docs.schema)
    assert toxicity.clean_documents(none, labels).count() == 0
    assert toxicity.clean_documents(docs, labels.where("toxic = 9")).count() == 5


def test_the_network_separates_toxic_windows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    bad = [f"bad{c}" for c in "abcdefgh"]
    texts, labels = [], []
    for k in range(900):
        t = list(rng.choice(words, rng.integers(40, 200)))
        if k % 4 == 0:
            at = rng.integers(len(t))
            t[at:at] = list(rng.choice(bad, 6))
        texts.append(" ".join(t))
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts[:600], labels[:600])
    raw = [t.encode() for t in texts[600:]]
    s = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert ((s >= 0.5) == np.array(labels[600:], bool)).mean() > 0.97
