import random

import pytest

from factorloom.llm import jaccard

WORDS = [f"w{i}" for i in range(5000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")


def chain(rng, links, words, step):
    """Texts of which each differs from the last in its first words: neighbours are near, the ends are not."""
    text = [rng.choice(WORDS) for _ in range(words)]
    out = [" ".join(text)]
    for _ in range(links):
        text = text[step:] + [rng.choice(WORDS) for _ in range(step)]
        out.append(" ".join(text))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(60)]
    texts = chain(rng, 12, 60, 5) + chain(rng, 6, 40, 3)
    # Groups of near copies that all hold one passage, so that different groups meet at its shingles.
    for _ in range(6):
        own = [rng.choice(WORDS) for _ in range(50)]
        for _ in range(8):
            copy = own + passage
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    # Texts around the threshold, short texts, and words that are everywhere.
    base = [rng.choice(WORDS) for _ in range(44)]
    for k in range(0, 12):
        texts.append(" ".join(base[: 44 - k] + [rng.choice(WORDS) for _ in range(k)]))
    texts += [" ".join(rng.choice(WORDS[:4]) for _ in range(rng.randint(1, 7))) for _ in range(40)]
    texts += ["the same five words here", "the same five words here", "one two", "one two", "", "  ", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == jaccard.brute_force(rows)


def test_many_ranges_blocks_and_salts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "BLOCK_GROUP", 2)
    monkeypatch.setattr(jaccard, "HOT_TOKEN", 3)
    rows = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == jaccard.brute_force(rows)


def test_equal_ids_are_joined_by_their_texts(spark):
    a, b = " ".join(WORDS[:20]), " ".join(WORDS[100:120])
    rows = [(5, a), (5, b), (2, a), (None, b), (None, "other words than these all"), (9, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([("5", 16, "2"), ("5", 16, "5"), ("2", 16, "2"), ("None", 16, "5"), ("None", 1, "None"), ("9", 0, "9")])


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(WORDS) for _ in range(120_000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2])]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_links_join_classes(spark):
    rows = corpus(5)
    members, links = jaccard.linked_classes(frame(spark, rows))
    of = {r.doc_id: r.v for r in members.collect()}
    want = jaccard.brute_force(rows)
    name = {}
    for d, v in of.items():
        name.setdefault(v, set()).add(want[d][1])
    assert all(name[r.a] == name[r.b] for r in links.collect())
