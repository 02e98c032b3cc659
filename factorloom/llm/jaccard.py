"""Exact Jaccard join on word shingles by prefix filters under several global orders.

Documents with the same shingle set form a class (the set's digest is its key), and
classes are joined, not documents.

1. ``classes``: n_shingles and class key of every document.
2. ``_frequencies``: how many blocks of classes hold each shingle.  A task gathers its
   distinct classes in blocks and sends sorted, delta-coded hashes to ranges of the
   hash space.  Shingles found once are in no other class and are not spoken of again.
3. ``_profiles``: each block gets back those of its shingles that others share, with
   their frequency.  Under an order by frequency a class's unshared shingles come
   first, so a class with at least ``n - ceil(t n) + 1`` of them is linked with nothing
   and ends here.  The overlap of two classes is that of their shared shingles, so
   profiles are all that verification needs.
4. ``_chained``: classes meet at the shingles of their prefix, neighbours by size are tried,
   and what verification links is one component: as many pairs as postings.
5. ``_component_pairs``: components that still meet at a shingle are paired.  A pair must
   agree in size, have enough shingles left for its overlap from the first common one on,
   and share prefix shingles under every other order (by signatures carried with the
   postings).  One member of each, in later rounds a few, are tried at each shingle; what is linked
   becomes one component, and the round is repeated while it links any.
   ``_across``: likeness being a metric, components whose roots are far apart end here;
   members of the others are paired under the same filters.  So a group of copies costs
   about as many pairs as it has members, and no link is lost.
6. ``_verified``: pairs must share a prefix shingle under every order, and then reach
   the threshold by their exact overlap.

Hot shingles: frequencies are summed from per-block counts, and the blocks' postings
are dealt by hash range and block group, so that a shingle of a third of all documents
meets a task only as often as a group of blocks holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import (
    SPACE_SEPARATORS,
    binary_columns,
    chunks,
    lower_ascii,
    mix64,
    only,
    read_table,
    small_batches,
    window_hashes,
    word_hashes,
    word_spans,
    written,
)
from factorloom.llm.components import connected

SHINGLE_WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
#: Shingles of one block of classes, and of one hash range.
BLOCK_SHINGLES = 2_000_000
#: Blocks whose postings of one hash range go to one task.
BLOCK_GROUP = 256
#: Bits of a shingle's hash that are kept: enough that unequal shingles of a pair differ.
TOKEN_BITS = 48
#: Bits by which frequencies are counted (a clash only raises a frequency).
COUNT_BITS = 40
#: Rounds in which components that meet are tried by some of their members at each shingle, and how many at most.
ROUNDS, REPS = 3, 16
#: Global orders: by rarity, and two by hashes.
ORDERS = (0, 1, 2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        low = lower_ascii(data[base : offsets[hi]])
        s, e, doc = word_spans(low, offsets[lo : hi + 1] - base, SPACE_SEPARATORS)
        words = word_hashes(low, s, e)
        long = window_hashes(words, width)
        ends = np.searchsorted(doc, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            a, b = int(ends[k]), int(ends[k + 1])
            if b - a >= width:
                out.append(np.unique(long[a : b - width + 1]))
            else:
                out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _class_key(hashes: np.ndarray) -> bytes:
    """128 bits, so that no two sets of a very large corpus are taken for one."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), v (class key; null without words)."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(*binary_columns(b, "text"))
            keys = [_class_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n", "v"]
            )

    return docs.mapInArrow(run, "doc_id long, n long, v binary")


# Sorted integers travel as deltas in byte planes: the high planes are nearly all zero.
def _pack(values: np.ndarray, planes: int = 8) -> bytes:
    deltas = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def _planes(raw: np.ndarray, planes: int = 8) -> bytes:
    """Unsorted integers, as byte planes."""
    view = np.ascontiguousarray(raw.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :planes]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(view.T).tobytes())


def _unplanes(blob: bytes, planes: int = 8) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(planes, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, :planes] = raw.T
    return wide.reshape(-1).view("<u8")


def _unpack(blob: bytes, planes: int = 8) -> np.ndarray:
    return np.cumsum(_unplanes(blob, planes), dtype=np.uint64)


def _blocks(batches):
    """Distinct classes of a task in blocks: class keys, set sizes, and the sets' hashes one after another."""
    seen: set[bytes] = set()
    keys, sets, total = [], [], 0
    for b in batches:
        for s in shingle_sets(*binary_columns(b, "text")):
            if not len(s) or (key := _class_key(s)) in seen:
                continue
            seen.add(key)
            keys.append(key)
            sets.append(s >> np.uint64(64 - TOKEN_BITS))
            total += len(s)
            if total >= BLOCK_SHINGLES:
                yield keys, [len(x) for x in sets], np.concatenate(sets)
                seen.clear()
                keys, sets, total = [], [], 0
    if keys:
        yield keys, [len(x) for x in sets], np.concatenate(sets)


_DROP = np.uint64(TOKEN_BITS - COUNT_BITS)


def _range_edges(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Where each hash range begins among sorted tokens."""
    starts = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS - bits)
    return np.searchsorted(tokens, starts)


def _frequencies(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, tokens, counts: shingles (their first COUNT_BITS bits) found more than once, and how often."""

    def send(batches):
        for _, _, tokens in _blocks(batches):
            tokens = np.sort(tokens)
            edges = _range_edges(tokens, bits)
            buckets, values, counts = [], [], []
            for k in np.flatnonzero(np.diff(edges)):
                found, n = np.unique(tokens[edges[k] : edges[k + 1]] >> _DROP, return_counts=True)
                buckets.append(int(k))
                values.append(_pack(found))
                counts.append(_planes(n, 4))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(values, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "tokens", "counts"])

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held_t, held_n, held = [], [], 0
        def fold():
            nonlocal have, total, held_t, held_n, held
            every = np.concatenate([have, *held_t])
            order = np.argsort(every, kind="stable")
            every, n = every[order], np.concatenate([total, *held_n])[order]
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            have, total = every[first], np.add.reduceat(n, first) if len(first) else n
            held_t, held_n, held = [], [], 0
        for b in batches:
            for t, n in zip(b.column("tokens").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held_t.append(_unpack(t))
                held_n.append(_unplanes(n, 4).astype(np.int64))
                held += len(held_t[-1])
                if held > 4 * BLOCK_SHINGLES:
                    fold()
        fold()
        often = total > 1
        if often.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()], pa.int64()), pa.array([_pack(have[often])], pa.binary()), pa.array([_planes(total[often], 6)], pa.binary())],
                names=["bucket", "tokens", "counts"],
            )

    schema = "bucket long, tokens binary, counts binary"
    return docs.mapInArrow(send, schema).groupBy("bucket").applyInArrow(gather, schema)


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Frequency class of a shingle: quarter powers of two, in a byte."""
    return np.minimum(255, np.round(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, rarity: np.ndarray, n: int, order: int, percent: int = PERCENT) -> np.ndarray:
    """Shared shingles in the prefix of a set of ``n`` under a global order; the unshared ones come before.

    Order 0 has the rarest first (of equals, by hash); the others go by a hash of their own alone.
    """
    room = prefix_length(n, percent) - (n - len(tokens))
    if room <= 0:
        return tokens[:0]
    place = mix64(tokens * np.uint64(2 * order + 3) + np.uint64((order + 1) << 50))
    return tokens[(np.argsort(place) if order else np.lexsort((place, rarity)))[:room]]


def signature(tokens: np.ndarray) -> list[int]:
    """128 bits in which shingles set a bit each: sets without a common bit have no common shingle."""
    bit = mix64(tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(57)
    words = np.zeros(2, np.uint64)
    np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return words.view(np.int64).tolist()


def _profiles(docs: DataFrame, frequencies: DataFrame, bits: int, salts: int, percent: int) -> DataFrame:
    """v, n, tokens (6 bytes each, sorted), rarity (a byte each) of the classes that may have links."""

    def send(batches):
        for keys, sizes, tokens in _blocks(batches):
            owner = np.repeat(np.arange(len(keys), dtype=np.uint64), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            block = xxhash.xxh3_64_intdigest(b"".join(keys)) - (1 << 63)
            edges = _range_edges(tokens, bits)
            home = block % (1 << bits)
            cols: list[list] = [[], [], [], [], [], []]
            for k in sorted({home, *np.flatnonzero(np.diff(edges)).tolist()}):
                part = slice(edges[k], edges[k + 1])
                own = k == home
                row = (k, block % salts, block, _pack(tokens[part]), _planes(owner[part], 4),
                       b"".join(keys) + np.array(sizes, np.int64).tobytes() if own else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "salt", "block", "tokens", "owners", "roster"])

    def reply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known = _unpack(right.column("tokens")[0].as_py()) if len(right) else np.zeros(0, np.uint64)
        often = _rarity(_unplanes(right.column("counts")[0].as_py(), 6).astype(np.int64)) if len(right) else np.zeros(0, np.uint8)
        blocks, tokens, owners, rarity, rosters = [], [], [], [], []
        for i in range(len(left)):
            t = _unpack(left.column("tokens")[i].as_py())
            at = np.searchsorted(known, t >> _DROP)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == t >> _DROP) if len(known) else np.zeros(0, np.int64)
            roster = left.column("roster")[i].as_py()
            if not len(hit) and roster is None:
                continue
            blocks.append(left.column("block")[i].as_py())
            tokens.append(_pack(t[hit]))
            owners.append(_planes(_unplanes(left.column("owners")[i].as_py(), 4)[hit], 4))
            rarity.append(often[at[hit]].tobytes())
            rosters.append(roster)
        return pa.table({"block": pa.array(blocks, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "owners": pa.array(owners, pa.binary()),
                         "rarity": pa.array(rarity, pa.binary()), "roster": pa.array(rosters, pa.binary())})

    def assemble(table: pa.Table) -> pa.Table:
        # A block's profiles: at most BLOCK_SHINGLES tokens and one more text.
        roster = next(x for x in table.column("roster").to_pylist() if x is not None)
        many = len(roster) // 24
        keys, sizes = [roster[16 * k : 16 * k + 16] for k in range(many)], np.frombuffer(roster, np.int64, offset=16 * many)
        tokens = np.concatenate([_unpack(x) for x in table.column("tokens").to_pylist()])
        owners = np.concatenate([_unplanes(x, 4) for x in table.column("owners").to_pylist()]).astype(np.int64)
        rarity = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("rarity").to_pylist()])
        order = np.lexsort((tokens, owners))
        tokens, owners, rarity = tokens[order], owners[order], rarity[order]
        edges = np.searchsorted(owners, np.arange(len(keys) + 1))
        rows = []
        for k in range(len(keys)):
            part, n = slice(edges[k], edges[k + 1]), int(sizes[k])
            if n - (edges[k + 1] - edges[k]) < prefix_length(n, percent):
                rows.append((keys[k], n, tokens[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), rarity[part].tobytes()))
        v, n, t, r = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"v": pa.array(v, pa.binary()), "n": pa.array(n, pa.int64()), "tokens": pa.array(t, pa.binary()), "rarity": pa.array(r, pa.binary())})

    postings = docs.mapInArrow(send, "bucket long, salt long, block long, tokens binary, owners binary, roster binary")
    spread = frequencies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    shared = (
        postings.groupBy("bucket", "salt")
        .cogroup(spread.groupBy("bucket", "salt"))
        .applyInArrow(reply, "block long, tokens binary, owners binary, rarity binary, roster binary")
    )
    found = shared.groupBy("block").applyInArrow(assemble, "v binary, n long, tokens binary, rarity binary")
    return found.dropDuplicates(["v"])


def _tokens(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


#: Postings of a token that meet in one window; more are dealt by salt.
HOT_TOKEN = 4096


_SIGNS = [f"s{o}{k}" for o in ORDERS[1:] for k in range(2)]
_MEETING = "token long, salt long, v binary, n long, rest long, " + ", ".join(f"{c} long" for c in _SIGNS)


def _meetings(profiles: DataFrame, percent: int) -> DataFrame:
    """A row for each shingle of a class's prefix under the first order.

    token, salt, v, n, rest (the class's shared shingles from this one on in the first order), and
    signatures of its prefixes under the other orders.
    """

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5 + len(_SIGNS))]
            for key, size, raw, rare in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                tokens, rarity = _tokens(raw), np.frombuffer(rare, np.uint8)
                p = prefix(tokens, rarity, size, ORDERS[0], percent)
                # About how often a token occurs is known from its rarity.
                lots = np.maximum(1, 2.0 ** (rarity[np.searchsorted(tokens, p)] / 4.0) / HOT_TOKEN).astype(np.uint64)
                signs = [w for o in ORDERS[1:] for w in signature(prefix(tokens, rarity, size, o, percent))]
                row = [p.astype(np.int64), (np.uint64(int.from_bytes(key[:7], "little")) % lots).astype(np.int64), None, np.full(len(p), size), len(tokens) - np.arange(len(p))]
                for c, x in zip(cols, [*row, *(np.full(len(p), w) for w in signs)], strict=True):
                    c.append(x)
                cols[2][-1] = np.array([key] * len(p), object)
            if cols[0]:
                flat = [np.concatenate(c) for c in cols]
                names = [c.split()[0] for c in _MEETING.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(flat)], names=names)

    return profiles.select("v", "n", "tokens", "rarity").mapInArrow(run, _MEETING)


def _side(profiles: DataFrame, c: str) -> DataFrame:
    return profiles.select(F.col("v").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "tokens", "rarity")))


def _overlaps(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """a, b, near: exact likeness (shared over all) of the pairs."""

    def run(batches):
        for b in batches:
            near = []
            for nx, tx, ny, ty in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                both = len(np.intersect1d(_tokens(tx), _tokens(ty), True))
                near.append(both / (nx + ny - both))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(near, pa.float64())], names=["a", "b", "near"])

    rows = pairs.join(_side(profiles, "a"), "a").join(_side(profiles, "b"), "b")
    return rows.select("a", "b", "n_a", "tokens_a", "n_b", "tokens_b").mapInArrow(run, "a binary, b binary, near double")


def _verified(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share prefix shingles under every order and reach the threshold."""

    def run(batches):
        for b in batches:
            keep = []
            for nx, tx, rx, ny, ty, ry in zip(*(b.column(i).to_pylist() for i in range(2, 8)), strict=True):
                x, y = _tokens(tx), _tokens(ty)
                rx, ry = np.frombuffer(rx, np.uint8), np.frombuffer(ry, np.uint8)
                ok = all(len(np.intersect1d(prefix(x, rx, nx, s, percent), prefix(y, ry, ny, s, percent), True)) for s in ORDERS)
                if ok:
                    both = len(np.intersect1d(x, y, True))
                    ok = 100 * both >= percent * (nx + ny - both)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    rows = pairs.join(_side(profiles, "a"), "a").join(_side(profiles, "b"), "b")
    rows = rows.select("a", "b", "n_a", "tokens_a", "rarity_a", "n_b", "tokens_b", "rarity_b")
    return rows.mapInArrow(run, "a binary, b binary")


def _chained(meetings: DataFrame, percent: int) -> DataFrame:
    """Neighbours by size among the classes that meet at a shingle: no more pairs than postings."""
    fits = F.expr(f"a is not null and 100 * n_small >= {percent} * n_large")
    order = Window.partitionBy("token", "salt").orderBy("n", "v")
    rows = meetings.select("*", F.lag("v").over(order).alias("a"), F.lag("n").over(order).alias("n_small"))
    near = rows.select("a", F.col("v").alias("b"), "n_small", F.col("n").alias("n_large"))
    # The first of each salt are neighbours in their turn.
    heads = rows.where("a is null").select("token", "v", "n")
    order = Window.partitionBy("token").orderBy("n", "v")
    heads = heads.select(F.lag("v").over(order).alias("a"), F.col("v").alias("b"), F.lag("n").over(order).alias("n_small"), F.col("n").alias("n_large"))
    near = near.unionByName(heads).where(fits)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def class_links(docs: DataFrame, total: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, bool]:
    """Verified links (a, b) of classes that together connect all that are linked; the components that the
    first round of them gives (node, root); and whether that round found them all."""
    bits = max(0, math.ceil(math.log2(max(total, 1) / BLOCK_SHINGLES)))
    salts = max(1, math.ceil(total / BLOCK_SHINGLES / BLOCK_GROUP))
    profiles = written(_profiles(docs, _frequencies(docs, bits), bits, salts, percent), "profiles")
    meetings = written(_meetings(profiles, percent), "meetings")
    links = written(_verified(_chained(meetings, percent), profiles, percent), "links")
    parts = written(connected(links), "parts")

    # What meets at a shingle and is not in one component yet.
    placed = meetings.join(parts.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    rest, found, met = written(_apart(placed), "rest"), links, None
    for k in range(ROUNDS):
        met = written(_component_pairs(rest, percent, k), "met")
        tests = written(_tests(met), "tests")
        new = written(_verified(tests.select("a", "b").distinct(), profiles, percent), "new")
        if not new.head(1):
            break
        found = found.unionByName(new)
        rest = written(_apart(_hooked(rest, new.join(tests, ["a", "b"]).select("root_l", "root_r"))), "rest")
    else:
        met = written(_component_pairs(rest, percent, ROUNDS), "met")
    far = written(_verified(_across(rest, met, profiles, percent), profiles, percent), "far")
    return found.unionByName(far), parts, found is links and not far.head(1)


def _hooked(rest: DataFrame, linked: DataFrame) -> DataFrame:
    """Postings whose components took the name of the least one linked with them, or of that one's least.

    Names need not be whole components: what is linked and named apart is tried again, and components
    are found from all links in the end.
    """
    both = linked.unionByName(linked.select(F.col("root_r").alias("root_l"), F.col("root_l").alias("root_r")))
    hook = written(both.groupBy(F.col("root_l").alias("root")).agg(F.min("root_r").alias("to")).select("root", F.least("root", "to").alias("to")), "hook")
    jump = hook.join(hook.select(F.col("root").alias("to"), F.col("to").alias("on")), "to", "left")
    jump = jump.select("root", F.coalesce("on", "to").alias("new"))
    return rest.join(jump, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")


def _apart(placed: DataFrame) -> DataFrame:
    """The postings (token, v, n, rest, signatures, root) at shingles where components meet."""
    mark = F.xxhash64("root")
    mixed = placed.groupBy("token").agg(F.min(mark).alias("r0"), F.max(mark).alias("r1")).where("r0 <> r1").select("token")
    return placed.join(mixed, "token", "left_semi").select("token", "v", "n", "rest", *_SIGNS, "root")


def _may_share(percent: int, signs: list[str]) -> str:
    """What two sides (l, r; of a class or of a component) that meet at a shingle must fulfil to be linked by it.

    Sizes must agree; if this is their first common shingle, what is left of both must hold the
    overlap they need; and they must share a prefix shingle under every other order as well.
    """
    sizes = f"100 * hi_l >= {percent} * lo_r and 100 * hi_r >= {percent} * lo_l"
    left = f"least(rest_l, rest_r) * {100 + percent} >= {percent} * (lo_l + lo_r)"
    orders = " and ".join(f"(({a}_l & {a}_r) <> 0 or ({b}_l & {b}_r) <> 0)" for a, b in zip(signs[0::2], signs[1::2], strict=True))
    return f"{sizes} and {left} and {orders}"


_PARTS = ["root", "lo", "hi", "rest", *_SIGNS]


def _component_pairs(rest: DataFrame, percent: int, round_: int) -> DataFrame:
    """token, root_l, root_r, reps_l, reps_r: components that may be linked where they meet, and some members of
    each there: one in the first round, others and up to REPS later.

    A shingle's members are combined by slot and then by component, before and after the shuffle, so that
    the members of a large component meet no task whole.
    """
    slots = REPS if round_ else 1
    mark = F.xxhash64("v", F.lit(round_))
    least = [F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"), *(F.bit_or(c).alias(c) for c in _SIGNS)]
    rows = rest.withColumnsRenamed({"n": "lo"}).withColumns({"hi": F.col("lo"), "m": F.lit(1), "slot": F.pmod(mark, F.lit(slots))})
    slotted = rows.groupBy("token", "root", "slot").agg(*least, F.min_by("v", mark).alias("rep"))
    gathered = written(slotted.groupBy("token", "root").agg(*least, F.array_sort(F.collect_list("rep")).alias("reps")), "gathered")
    left, right = (gathered.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ["reps", "m", *_PARTS])) for s in "lr")
    met = left.join(right, "token").where(F.expr(f"root_l < root_r and {_may_share(percent, _SIGNS)}"))
    return met.select("token", "root_l", "root_r", "reps_l", "reps_r", (F.col("m_l") <= F.col("m_r")).alias("left_is_less"))


def _tests(met: DataFrame) -> DataFrame:
    """a, b, root_l, root_r: the members of one side beside those of the other, the shorter list over again."""
    beside = F.expr(
        "explode(transform(sequence(0, greatest(size(reps_l), size(reps_r)) - 1),"
        " i -> struct(reps_l[i % size(reps_l)] as l, reps_r[i % size(reps_r)] as r)))"
    )
    rows = met.select("root_l", "root_r", beside.alias("p"))
    return rows.select(F.least("p.l", "p.r").alias("a"), F.greatest("p.l", "p.r").alias("b"), "root_l", "root_r").distinct()


def _across(rest: DataFrame, met: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may be linked.

    With d = 1 - likeness, which is a metric, two classes are no closer than their components'
    roots are, less their distances to them; so components whose roots are far apart are left
    without looking at their members' pairs.
    """
    pairs = written(met.select(F.col("root_l").alias("a"), F.col("root_r").alias("b")).distinct(), "root-pairs")
    # Distances of members to their root, and of roots.
    some = pairs.select(F.col("a").alias("root")).unionByName(pairs.select(F.col("b").alias("root"))).distinct()
    members = rest.join(some, "root", "left_semi").select("v", "root").distinct()
    gaps = _overlaps(members.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")), profiles)
    gaps = gaps.select(F.col("a").alias("v"), (1 - F.col("near")).alias("gap"))
    members = written(members.join(gaps, "v", "left").select("v", "root", F.coalesce("gap", F.lit(0.0)).alias("gap")), "members-gap")
    widest = members.groupBy("root").agg(F.max("gap").alias("gap"))
    apart = _overlaps(pairs, profiles).select("a", "b", (1 - F.col("near")).alias("apart"))
    for c in "ab":
        apart = apart.join(widest.select(F.col("root").alias(c), F.col("gap").alias(f"gap_{c}")), c)
    slack = 1 - percent / 100 + 1e-9
    close = apart.where(F.col("apart") <= F.col("gap_a") + F.col("gap_b") + slack)
    close = close.select(F.col("a").alias("root_l"), F.col("b").alias("root_r"), "apart")
    close = met.select("token", "root_l", "root_r", "left_is_less").join(close, ["root_l", "root_r"])
    # The component with fewer members at the shingle is looked up first.
    less, more = (F.when(F.col("left_is_less") == k, F.col("root_l")).otherwise(F.col("root_r")) for k in (True, False))
    close = written(close.select("token", less.alias("root_l"), more.alias("root_r"), "apart"), "close")

    # Members of the components left, where those meet at a shingle.
    each = rest.join(members, ["v", "root"]).withColumnsRenamed({"n": "lo"}).withColumn("hi", F.col("lo"))
    side = lambda s: each.select(F.col("token"), *(F.col(c).alias(f"{c}_{s}") for c in ["v", "gap", *_PARTS]))
    both = close.join(side("l"), ["token", "root_l"]).join(side("r"), ["token", "root_r"])
    both = both.where(F.expr(f"gap_l + gap_r + {slack} >= apart and {_may_share(percent, _SIGNS)}"))
    return both.select(F.least("v_l", "v_r").alias("a"), F.greatest("v_l", "v_r").alias("b")).distinct()


def class_roots(docs: DataFrame, total: int, percent: int = PERCENT) -> DataFrame:
    """Components (node, root) of the classes of ``docs`` that are linked with others."""
    links, parts, whole = class_links(docs, total, percent)
    return parts if whole else connected(links)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Defined results: null, empty and wordless texts have no shingles and are linked with
    nothing; equal rows are reported one by one; documents of one doc_id with different
    texts are joined by their texts, each row reporting its own; a null doc_id never is a
    component_id unless it stands alone; an empty table gives no rows.
    """
    src = only(docs, doc_id="long", text="string")
    small_batches(src.sparkSession)
    members = written(classes(src), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    roots = class_roots(src.select("text"), total, percent)
    # Everything is found by class, of which there is a row each; members join on their class alone.
    each = members.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("least"))
    placed = written(each.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("id"))
    ids = written(placed.join(least, "root").select("v", "id"), "ids")
    return members.join(ids, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"))


def linked_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, v) of the classes of equal shingle sets, and the verified links (a, b) between classes
    that connect every component; copies are not expanded into pairs."""
    src = only(docs, doc_id="long", text="string")
    small_batches(src.sparkSession)
    members = written(classes(src), "members")
    links, _, _ = class_links(src.select("text"), members.agg(F.sum("n")).first()[0] or 0, percent)
    return members.select("doc_id", "v"), links


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows with one of each component: that with the smallest doc_id (nulls last), then text.

    Rows without words are copies of each other if their doc_id and text are equal.
    """
    # Rows are numbered once, so that neither null nor repeated ids tie rows together.
    rows = written(docs.select(F.struct("*").alias("r"), F.monotonically_increasing_id().alias("row")), "rows")
    src = rows.select(F.col("row").alias("doc_id"), F.col("r.`text`").cast("string").alias("text"))
    found = near_duplicates(src, percent).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    ids = rows.select("row", F.col("r.`doc_id`").cast("long").alias("id"), F.xxhash64(F.col("r.`text`").cast("string")).alias("body"), F.col("r.`text`").isNull().alias("none"))
    ids = ids.join(found, "row")
    wordless = F.col("n_shingles") == 0
    group = (F.when(wordless, F.col("id")), F.when(wordless, F.col("body")), F.when(wordless, F.col("none")), F.when(~wordless, F.col("component_id")))
    first = F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)), F.col("body"), F.col("row"))).alias("first")
    kept = ids.groupBy(*(g.alias(f"g{k}") for k, g in enumerate(group))).agg(first).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*(F.col(f"r.`{c}`").alias(c) for c in docs.columns))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple], percent: int = PERCENT) -> dict:
    """Reference of the tests: doc_id -> (n_shingles, component_id) by comparing all pairs."""
    import re

    fold = {c: c + 32 for c in range(0x41, 0x5B)}
    sets = {}
    for doc, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(fold))
        sets[doc] = {tuple(w[i : i + SHINGLE_WORDS]) for i in range(max(1, len(w) - SHINGLE_WORDS + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}
