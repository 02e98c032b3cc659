import gzip
import hashlib
import random

import pytest

from factorloom.llm import archive

SCHEMA = "page_id long, url string, html string, shard string, payload int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)


def pages(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), f"http://h/{i}", "".join(rng.choice("abcdef <>") for _ in range(rng.randint(0, 3000)))) for i in range(n)]
    shared = "<p>" + "y" * 2000
    rows += [(k, None, shared) for k in (-5, 7, (1 << 63) - 1, -(1 << 63))] + [(None, "u", shared), (None, None, None), (3, "", ""), (3, "", "")]
    rng.shuffle(rows)
    return rows


def plain(rows):
    """Records by the contract, from sorting everything."""
    out = []
    last: dict = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, page), page)
    for page, _, html in rows:
        raw = (html or "").encode()
        to = last.get(html)
        revisit = len(raw) >= 1000 and to is not None and page != to
        out.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(to if revisit else None)))
    return sorted(out)


@pytest.mark.parametrize("roll,shard", [(1 << 20, 1 << 30), (20_000, 1 << 30), (20_000, 60_000)])
def test_archives_hold_the_pages(spark, tmp_path, monkeypatch, roll, shard):
    monkeypatch.setattr(archive, "ROLL_BYTES", roll)
    monkeypatch.setattr(archive, "SHARD_BYTES", shard)
    rows, hashes = pages(), []
    for parts in (1, 5):
        path = f"file://{tmp_path}/{parts}"
        manifest = archive.write_archives(frame(spark, rows).repartition(parts), path)
        listed = sorted(map(tuple, manifest.collect()))
        assert listed == sorted(map(tuple, archive.read_manifest(spark, path).collect()))
        names = {p.name for p in (tmp_path / str(parts)).iterdir() if not p.name.endswith(".crc")}
        assert names == {x[0].rsplit("/", 1)[1] for x in listed} | {archive.MANIFEST}
        hashes.append([(x[0].rsplit("/", 1)[1], x[4]) for x in listed])
        got = archive.read_archives(manifest)
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got.collect()) == plain(rows)
        for name, _, _, size, sha1 in listed:
            raw = (tmp_path / str(parts) / name.rsplit("/", 1)[1]).read_bytes()
            assert len(raw) == size and hashlib.sha1(raw).hexdigest() == sha1 and gzip.decompress(raw).startswith(b"WARC/1.1")
            assert size < roll + 6000
    assert hashes[0] == hashes[1]
    assert (len(hashes[0]) > 3) == (roll == 20_000) and (len({n[:11] for n, _ in hashes[0]}) > 1) == (shard == 60_000)
    # Records are in order over all files.
    ids = [r.page_id for name, _ in hashes[0] for r in archive.read_archives(spark.createDataFrame([(f"file://{tmp_path}/1/{name}",)], "path string")).collect()]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    manifest = archive.write_archives(frame(spark, []), path)
    assert manifest.count() == 0 and archive.read_archives(manifest).count() == 0 and archive.read_manifest(spark, path).count() == 0
