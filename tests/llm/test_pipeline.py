"""The pipeline against its stages done plainly, on a fixture with repeated and missing ids."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factorloom.llm import common, decontam, jaccard, packing, templates, toxicity

WORDS = [f"w{i}" for i in range(3000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def documents():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    bench = [say(30), say(14), say(6)]
    passage, rows = say(60), []
    for i in range(70):
        lines = [say(rng.randint(3, 40)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.append(passage)
        if i % 11 == 0:
            lines.append(f"{say(4)} {bench[i % 3]} {say(4)}")
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (3, rows[3][1]), (3, say(20)), (None, say(20)), (None, say(25)), (None, rows[4][1])]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "one two")]
    rows += [(300 + i, " ".join([say(10), *["vile", "vermin", "scum"] * 3, say(10)])) for i in range(30)]
    docs = [(d, t, "en", "s", None if t is None else len(t), "extra") for d, t in rows]
    labels = [(i, 1, int(i >= 300)) for i in [*range(70), *range(300, 330)]]
    return docs, labels, [(i, t) for i, t in enumerate(bench)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    docs, labels, bench = documents()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)


def plain_lines(rows):
    """Each row loses the lines whose template a row with a lesser (doc_id, text) has; rows without a line left go."""
    ids = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    out = templates.brute_force([(k, rows[i][1]) for k, i in enumerate(ids)])
    kept = []
    for k, i in enumerate(ids):
        if out[k] == rows[i][1]:
            kept.append(rows[i])
        elif out[k].strip():
            kept.append((rows[i][0], out[k], len(out[k])))
    return sorted(kept, key=str)


def plain_groups(rows):
    """One row of each component, that of the least id; rows without words are copies if id and text are equal."""
    found = jaccard.brute_force([(i, r[1]) for i, r in enumerate(rows)])
    groups = {}
    for i, r in enumerate(rows):
        n, root = found[i]
        groups.setdefault(root if n else (r[0], r[1]), []).append(r)
    return [sorted(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_stages_match_plain_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    tox, lines, near, clean, pack = (f for _, f in corpus_pipeline.STAGES)

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    raw = rows_of(docs)
    data = [(t or "").encode() for _, t, _ in raw]
    s = model.scores(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    one = common.written(tox(spark, docs, folder), "one")
    assert one.columns == docs.columns
    assert rows_of(one) == [r for r, x in zip(raw, s, strict=True) if x < toxicity.THRESHOLD]
    gone = {r[0] for r in raw} - {r[0] for r in rows_of(one)}
    assert len([d for d in gone if d >= 300]) >= 25 and not [d for d in gone if d < 300]

    two = common.written(lines(spark, one, folder), "two")
    assert two.columns == docs.columns and rows_of(two) == plain_lines(rows_of(one))

    three = common.written(near(spark, two, folder), "three")
    got = rows_of(three)
    groups = plain_groups(rows_of(two))
    assert three.columns == docs.columns and len(got) == len(groups)
    assert all(sum(r in g for r in got) >= 1 and any(r[0] == g[0][0] for r in got if r in g) for g in groups)

    four = common.written(clean(spark, three, folder), "four")
    assert four.columns == docs.columns
    hits = {i: v for i, v in decontam.brute_force([(i, r[1]) for i, r in enumerate(got)], bench).items()}
    left = rows_of(four)
    assert all(v[1] == 0 for v in decontam.brute_force([(i, r[1]) for i, r in enumerate(left)], bench).values())
    assert [r for i, r in enumerate(got) if not hits[i][1]] == [r for r in left if r in [g for i, g in enumerate(got) if not hits[i][1]]]
    assert all(r[2] == len(r[1]) for r in left if r[1] is not None and r not in got)

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces = pack(spark, four, folder).collect()
    assert sum(r.length for r in pieces) == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in left)


def test_run_gives_what_the_stages_give(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), "step")
    digest = lambda df: sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    whole = lambda rows: sorted({(d, n) for d, _, _, _, n in rows})
    assert whole(digest(corpus_pipeline.run(spark, folder))) == whole(digest(docs))


def test_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
