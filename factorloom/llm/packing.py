"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps ``open_windows`` windows.  A piece goes best-fit into the open
window it leaves the least room in.  When none fits, the fullest is emitted, topped up
with the piece's head (pieces may be cut anywhere), so that no window is padded.  At the
end a partition merges its own open windows in the same way, which leaves at most one
unfilled window; those are merged over groups of partitions.  Memory: the open windows
and one Arrow batch.

Stage one is written to the shared folder before its rows are split into emitted
pieces and leftovers, so a rerun after a lost executor cannot mix two runs.

Defined results: a null or empty text is the end id alone; repeated rows are packed
once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import CHUNK_BYTES, binary_columns, only, read_table, small_batches, word_hashes, written

WINDOW = 2048
OPEN_WINDOWS = 32
END_ID = 1
#: Units kept by a worker's cache of token ids; it starts afresh beyond.
CACHE_UNITS = 1_000_000
#: Ids kept there.
CACHE_IDS = 8_000_000
#: Partitions whose leftovers one task merges.
MERGE_FAN_IN = 256

_worker: dict = {}
# Kinds of ASCII bytes (0: not known), and bytes that may begin white space.
_KIND = np.zeros(256, np.uint8)
_KIND[0:9] = _KIND[0x0E:0x1C] = _KIND[0x21:0x80] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 4
_KIND[[*range(0x09, 0x0E), 0x20]] = 5
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Kinds between which pre-tokens always end: letters 1, digits 2, signs 3, apostrophe 4, white space 5.
_ENDS = np.zeros((6, 6), bool)
for _a, _b in ((1, 2), (1, 3), (1, 5), (2, 1), (2, 3), (2, 5), (3, 1), (3, 2), (3, 5), (4, 2), (4, 5)):
    _ENDS[_a, _b] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where units begin: at each text, where the kind of an ASCII byte ends a pre-token, and
    at each space that plain text follows; never inside the strings ``whole``.

    Pre-tokens of a byte-level BPE are tokenised by themselves, so cuts between them change no ids.
    """
    cut = np.zeros(len(data), bool)
    kind = _KIND[data]
    cut[1:] = _ENDS[kind[:-1], kind[1:]]
    cut[:-1] |= (data[:-1] == 0x20) & ~_WHITE[data[1:]]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    # The last byte of a text is followed by nothing; a space there belongs to the white space before it.
    last = edges[edges > 1] - 1
    cut[last] = _ENDS[kind[last - 1], kind[last]]
    cut[edges] = True
    cut[:1] = True
    raw = data.tobytes() if whole else b""
    for special in whole:
        at = raw.find(special)
        while at >= 0:
            inside = np.arange(at + 1, at + len(special))
            cut[inside[~np.isin(inside, edges)]] = False
            at = raw.find(special, at + len(special))
    return np.flatnonzero(cut)


#: What keeps a unit apart from the text before it, by its first byte; None where nothing does for certain.
_SEPARATOR = [None if k == 0 else b"" if c == 0x20 else b" ." if k in (1, 2) else b" x" for c, k in enumerate(_KIND.tolist())]


class UnitTokenizer:
    """Token ids of texts by way of their distinct units, found by hash and compared byte by byte."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.whole = tuple(sorted(x.encode() for x in special))
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        # In a byte-level vocabulary each character stands for a byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token.encode()) if token in special else len(token)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.end = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, units: list[bytes]) -> None:
        """Token ids of new units.  They are encoded as running text, kept apart by pre-tokens of
        their own, and told apart by the bytes that each id stands for."""
        led, each, begins = [], [], []
        for u in units:
            sep = _SEPARATOR[u[0]]
            if sep is None or u.isspace():
                each.append(u)
            else:
                led.append(u)
                begins.append(sep)
        for lo in range(0, len(led), 10_000):
            part, seps = led[lo : lo + 10_000], begins[lo : lo + 10_000]
            joined = [x for pair in zip(seps, part, strict=True) for x in pair]
            ends = np.cumsum([len(x) for x in joined])
            ids = np.array(self._encode([b"".join(joined)])[0], np.int64)
            reach = np.append(np.cumsum(self.bytes_of[ids]), 0)
            at = np.searchsorted(reach[:-1], ends)
            if reach[-2] == ends[-1] and (reach[at][ends > 0] == ends[ends > 0]).all():
                after = np.where(ends > 0, at + 1, 0)
                take = np.zeros(len(ids) + 1, np.int64)
                np.add.at(take, after[0::2], 1)
                np.add.at(take, after[1::2], -1)
                self._keep(part, ids[np.cumsum(take)[:-1] > 0], after[1::2] - after[0::2])
            else:
                each += part
        for lo in range(0, len(each), 10_000):
            part = each[lo : lo + 10_000]
            found = self._encode(part)
            self._keep(part, np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found]))

    def _encode(self, raw: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([x.decode("utf-8", "replace") for x in raw], add_special_tokens=False)]

    def _keep(self, units: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.known), len(units)
        if k + n > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros(max(n, len(x)), np.int64)]) for x in (self.start, self.size))
        if self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.known.update(zip(units, range(k, k + n), strict=True))
        self.start[k : k + n], self.size[k : k + n] = self.end + np.cumsum(sizes) - sizes, sizes
        self.ids[self.end : self.end + len(ids)] = ids
        self.end += len(ids)

    def _units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one after another, and how many each has."""
        _, first, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        back = back.reshape(-1)
        size = end - start
        same = size == size[first][back]
        # Units of one hash are compared in full; any that differ stand for themselves.
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        owner = np.repeat(np.arange(len(size)), size)
        twin = np.minimum(np.repeat(start[first][back], size) + inner, len(data) - 1)
        same[owner[data[start[owner] + inner] != data[twin]]] = False
        odd = np.flatnonzero(~same)
        back[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.known) > CACHE_UNITS or self.end > CACHE_IDS:
            self.clear()
        if missing := list({u for u in units if u not in self.known}):
            self._learn(missing)
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))[back]
        n = self.size[at]
        place = np.arange(int(n.sum())) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        return self.ids[place], n

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins and the last ends among them."""
        start = unit_starts(data, offsets, self.whole)
        end = np.append(start[1:], len(data))
        ids, sizes, lo = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK_BYTES, side="right")))
            base = start[lo]
            some, n = self._units(data[base : end[hi - 1]], start[lo:hi] - base, end[lo:hi] - base)
            ids.append(some)
            sizes.append(n)
            lo = hi
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(ids), before[np.searchsorted(start, offsets)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        ids, at = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def tokenizer_for(path: str) -> UnitTokenizer:
    """One per worker process, kept between tasks."""
    if _worker.get("path") != path:
        _worker.update(path=path, tok=UnitTokenizer(path))
    return _worker["tok"]


class Packer:
    """The open windows of one partition; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, emit):
        self.window, self.limit, self.emit = window, open_windows, emit
        self.room: list[tuple[int, int]] = []  # (room left, window key), sorted
        self.held: dict[int, list] = {}
        self.key = 0

    def _put(self, key: int, room: int, piece) -> None:
        self.held.setdefault(key, []).append(piece)
        room -= len(piece[2])
        if room:
            insort(self.room, (room, key))
        else:
            self.emit(self.held.pop(key))

    def add(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        at = bisect_left(self.room, (len(ids), -1))
        if at < len(self.room):
            room, key = self.room.pop(at)
            self._put(key, room, (doc, start, ids, total))
        elif len(self.room) < self.limit:
            self.key += 1
            self._put(self.key, self.window, (doc, start, ids, total))
        else:
            room, key = self.room.pop(0)
            self._put(key, room, (doc, start, ids[:room], total))
            self.add(doc, start + room, ids[room:], total)

    def close(self) -> list:
        """Merge what is open, fullest first; the pieces of the one window left unfilled."""
        pieces = [p for _, key in self.room for p in self.held.pop(key)]
        self.room, self.limit = [], 1
        for p in pieces:
            self.add(*p)
        return [p for _, key in self.room for p in self.held.pop(key)]


_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "part long, ids binary"
)


class _Rows:
    """Collects piece rows; ids only where a later stage still has to move the piece."""

    def __init__(self, first_sequence: int, part: int):
        self.next, self.part, self.rows = first_sequence, part, []

    def emit(self, pieces, keep: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, None if keep else self.next, offset, self.part, raw if keep else None))
            offset += len(ids)
        self.next += not keep

    def batch(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.binary()]
        cols = list(zip(*self.rows, strict=True)) or [[]] * 9
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    src = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    small_batches(src.sparkSession)

    def first(batches):
        tok = tokenizer_for(tokenizer_path)
        part = TaskContext.get().partitionId()
        out = _Rows(part << 33, part)
        packer = Packer(window, open_windows, out.emit)
        for b in batches:
            every, at = tok.encode_bytes(*binary_columns(b, "text"))
            for doc, lo, hi in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = np.append(every[lo:hi], np.uint32(end_id))
                packer.add(doc, 0, ids, len(ids))
            if out.rows:
                yield out.batch()
        out.emit(packer.close(), keep=True)
        yield out.batch()

    def merge(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py() // MERGE_FAN_IN
        out = _Rows((2 * group + 1) << 32, group)
        packer = Packer(window, open_windows, out.emit)
        for r in table.sort_by([("part", "ascending"), ("offset", "ascending")]).to_pylist():
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], np.uint32), r["doc_tokens"])
        if left := packer.close():
            out.emit(left)
        return pa.Table.from_batches([out.batch()])

    pieces = written(src.mapInArrow(first, _PIECES), "packing")
    left = pieces.where("ids is not null")
    merged = left.groupBy((F.col("part") / MERGE_FAN_IN).cast("long")).applyInArrow(merge, _PIECES)
    return pieces.where("ids is null").unionByName(merged).drop("part", "ids")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
