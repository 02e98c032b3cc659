import hashlib
import random
import zlib

import duckdb
import numpy as np
import oracle
import pytest

from factorloom.llm import archive, catalog, chat, decontam, fingerprint, jaccard, lmscore, packing, sitetree, templates, toxicity

DOCS = "doc_id long, text string, extra int"


def sample_docs(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 5))]
        out.append([i, "\n".join(lines)])
    shared = " ".join(rng.choice(words) for _ in range(55))
    for i in range(0, 12):
        out[i][1] += "\n" + shared
    for i in range(20, 26):
        out[i][1] = out[19][1] + (" tail" if i % 2 else "")
    return [tuple(r) for r in out] + [(n, ""), (n + 1, None), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "one two")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], DOCS)


def test_near_duplicates_match_brute_force(spark):
    rows = sample_docs()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == jaccard.brute_force(rows)


def test_line_dedup_matches_brute_force(spark):
    rows = sample_docs()
    got = {r.doc_id: r.text for r in templates.drop_templates(frame(spark, rows)).collect()}
    assert got == templates.brute_force(rows)
    assert sum(a != b for a, b in ((got[d], t) for d, t in rows)) >= 11


def test_contamination_matches_brute_force(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    items = [(str(a), b) for a, b in duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()]
    want = decontam.brute_force(docs, items)
    got = {r.doc_id: r for r in decontam.op5_query(spark, sf_dir).collect()}
    assert {d: (r.n_words, r.n_hit, r.items_sha256) for d, r in got.items()} == want
    assert any(r.contaminated for r in got.values()) and all(r.contaminated == (r.n_hit > 0) for r in got.values())


def test_packing_holds_every_id_once(spark, sf_dir):
    rows = packing.op2_query(spark, sf_dir).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0)
        at[r.doc_id] = r.start + r.length
    assert all(at[r.doc_id] == r.doc_tokens for r in rows)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and sum(v < 2048 for v in fill.values()) <= 1


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_sql(spark, sf_dir, name):
    assert oracle.check(catalog.queries()[name](spark, sf_dir).toPandas(), oracle.duck(sf_dir, catalog.oracles()[name])) is None


def test_archives_are_deterministic_and_complete(spark, tmp_path):
    big = "<p>" + "x" * 1500
    pages = spark.createDataFrame([(3, "u", big), (1, "v", big), (2, None, None), (9, "w", "short"), (8, "w", "short")], "page_id long, url string, html string")
    hashes = []
    for k in range(2):
        manifest = archive.write_archives(pages.repartition(k + 1), f"file://{tmp_path}/{k}")
        hashes.append(sorted(r.sha1 for r in manifest.collect()))
        got = {r.page_id: r for r in archive.read_archives(manifest).collect()}
        assert got[1].record_type == "revisit" and got[1].refers_to == 3 and got[1].payload_bytes == len(big)
        assert got[3].payload == big.encode() and got[2].payload == b"" and got[8].record_type == got[9].record_type == "response"
        assert all(r.payload_digest == hashlib.sha1({1: big, 3: big, 2: "", 8: "short", 9: "short"}[p].encode()).hexdigest() for p, r in got.items())
    assert hashes[0] == hashes[1]


def test_main_text(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div>"
        "<article><h1>Head&amp;line</h1><p>One  <b>two<p>three<br>four</article><div class=sidebar>side</div>"
        "<section id='comments'><p>first!</p></section><script>x</script><footer>f</footer>"
    )
    rows = [(1, "http://a/1", html), (2, "http://a/2", None), (3, None, "plain <i>te</i>xt")]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head&line One two three four", 2: "", 3: "plain text"}


def test_style_tree_cuts_what_pages_of_a_host_repeat(spark):
    rows = [(i, f"http://h/{i}", f"<div><p>Same words everywhere</p></div><section><p>own text {i}</p></section>") for i in range(8)]
    got = {r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"own text {i}" for i in range(8)}


def test_base_scores_match_plain_counts(spark):
    rows = [(i, t) for i, t in enumerate(["a b a", "A c", "", None, "b b b c d", "a b a", "z " * 50, "q"])]
    docs = frame(spark, rows).select("doc_id", "text").fillna({"text": ""})
    got = {r.doc_id: r for r in lmscore.score(docs, docs.where("doc_id < 6").select("text")).collect()}
    tokens = {d: [*(t or "").lower().split(), None] for d, t in rows}
    train = [w for d in range(6) for w in tokens[d]]
    n, v = len(train), len(set(train))
    for d, ws in tokens.items():
        want = sum(np.log10((train.count(w) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert got[d].train_tokens == n and got[d].n_tokens == len(ws) and got[d].n_known == sum(w in train for w in ws)
        assert abs(got[d].base_score - want) < 1e-9 and got[d].score < 0


def test_block_passes_give_the_same_scores(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.score for r in lmscore.score(docs, docs.select("text")).collect()}
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 1)
    parts = {r.doc_id: r.score for r in lmscore.score(docs, docs.select("text")).collect()}
    assert whole == parts


def test_toxicity_on_held_out_rows(sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = duckdb.sql(f"select doc_id, text, toxic from '{big}/documents.parquet' join '{big}/labels.parquet' using (doc_id) order by 1").fetchall()
    out = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    model = toxicity.fit([r[1] for r in rows if not out(r)], [r[2] for r in rows if not out(r)])
    test = [r for r in rows if out(r)]
    raw = [(r[1] or "").encode() for r in test]
    s = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y = np.array([r[2] for r in test])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.85 and ((s >= 0) & (s <= 1)).all()


def test_chat_round_trip():
    for text in ("", "</s>[INST] ok [/INST]", "plain", "\\<|x|>\n", "é\u2028"):
        assert chat.unescape(chat.escape(text)) == text


def test_fingerprints_are_equal_for_equal_texts(spark):
    rows = {r.doc_id: list(r.sketch) for r in fingerprint.fingerprints(frame(spark, sample_docs())).collect()}
    assert rows[63] == rows[64] and rows[60] == rows[61] == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert jaccard.near_duplicates(none).count() == 0
    assert templates.deduplicated(none).count() == 0
    assert sitetree.extract(pages).count() == 0
    assert lmscore.score(none, none.select("text")).count() == 0
    assert packing.pack_documents(none, packing.tokenizer_path()).count() == 0


def edited_lines(n=12, words=40):
    """Rows whose one line differs from the first's in two far words each, and one line unlike them."""
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") + f"x{chr(97 + i % 26)}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        w[4], w[words - 3] = f"{chr(97 + i)}left", f"{chr(97 + i)}right"
        rows.append((i, " ".join(w)))
    return rows + [(n, " ".join(base[:2] + [x + "q" for x in base[2:]]))]


@pytest.mark.parametrize("part", [128, 2])
def test_line_templates_vary_at_any_position(spark, monkeypatch, part):
    monkeypatch.setattr(templates, "PART", part)
    rows = edited_lines()
    got = {r.doc_id: r.text for r in templates.drop_templates(frame(spark, rows)).collect()}
    assert got == templates.brute_force(rows)
    assert got == {d: t if d in (0, 12) else "" for d, t in rows}


def test_lines_without_letters_keep_their_digits(spark):
    rows = [(i, f"{i} {i + 1} 3 4 5 6 7") for i in range(4)]
    got = {r.doc_id: r.text for r in templates.drop_templates(frame(spark, rows)).collect()}
    assert got == dict(rows)


def test_short_lines_are_templates(spark):
    heads = ["All rights reserved.", "ok", "one two three four five six seven"]
    rows = [(i, "\n".join([f"own text {chr(97 + i) * 3}", "", *heads, f"see page and {chr(97 + i)} for the rest"])) for i in range(4)]
    got = {r.doc_id: r.text for r in templates.drop_templates(frame(spark, rows)).collect()}
    assert got == templates.brute_force(rows)
    assert got == {d: t if d == 0 else f"own text {chr(97 + d) * 3}\n" for d, t in rows}


def test_exact_copies_lose_their_lines(spark):
    text = "a passage that every copy has\nand one more line of it"
    rows = [(3, text), (1, text), (2, text), (None, text), (None, text), (None, "only here"), (7, "x"), (7, "x")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in templates.drop_templates(frame(spark, rows)).collect())
    assert got == [(-1, ""), (-1, ""), (-1, "only here"), (1, text), (2, ""), (3, ""), (7, ""), (7, "x")]


def test_one_row_of_each_component_is_kept(spark):
    words = lambda c: " ".join(f"{c}{chr(97 + i)}" for i in range(20))
    rows = [(None, words("a")), (None, words("b")), (None, words("c")), (4, words("c")), (5, words("d")), (5, words("e")), (6, words("e"))]
    rows += [(None, None), (None, None), (7, ""), (8, "")]
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows)).collect()]
    want = [rows[i] for i in (0, 1, 3, 4, 5, 7, 9, 10)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entropy_decides_inside_articles(spark):
    """Boilerplate of an article goes and its own text under a low class stays; equal articles are not emptied."""
    page = lambda i: (
        f"<nav>menu</nav><div class=ad>unique advert {i}</div><article><p>own text {i}</p><div class=notice>own notice {i}</div>"
        f"<div class=block>Read this first</div><section class=related>Same list</section></article><section id=comments>unique {i}</section>"
    )
    rows = [(i, f"http://h/{i}", page(i)) for i in range(8)]
    rows += [(100 + i, f"http://g/{i}", f"<nav>{i}</nav><article><p>The one article</p></article>") for i in range(8)]
    rows += [(200 + i, f"http://f/{i}", f"<nav>menu</nav><div class=header>only text {i}</div>") for i in range(8)]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"own text {i} own notice {i}" for i in range(8)}
    assert got == want | {100 + i: "The one article" for i in range(8)} | {200 + i: f"only text {i}" for i in range(8)}
