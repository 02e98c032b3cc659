"""Line deduplication by a fixed-depth log-template tree.

A line's way through the tree is its token count, then its leading tokens; runs of digits are
a variable field from the start, but for a line without letters, which they tell from
others (a letter is an ASCII one, whose case is folded, or any character beyond ASCII).
Equal lines are one form.  At each leaf forms are taken in the order of their least
doc_id: a form that differs from an earlier template's first form in at most
``allowance`` tokens, wherever they are, falls under that template, any other founds
one.  A template that occurs in two or more rows recurs; it stays in the row with the least
doc_id (then hash of the text) and its lines go from all others, exact copies of that row
included.

Lines are cut and hashed in numpy, many texts at a time.  Every line sends one hash;
aggregation by form combines before the shuffle and keeps a fixed number of fields.  Only
forms that may fall under another's template are compared, a part of a leaf at a time.
Forms of very many lines are spread over salts when the lines look them up.

Defined results: of rows equal in doc_id and text any one is the first; null and empty
texts have no lines to drop; blank lines are structure and stay; repeats within one row
stay; a null doc_id is greater than all others; an empty table gives no rows; other
columns, whatever their names, are carried along.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import CHUNK_BYTES, SPACE_SEPARATORS, binary_columns, lower_ascii, mix64, read_table, small_batches, word_hashes, word_spans, written

#: Tokens at the head of a line that are part of its way through the tree.
DEPTH = 2
SEGMENTS = 3
#: Lines with this many tokens or more vary by a third of their later tokens, shorter ones by a fifth of all.
VARIABLE_TOKENS = 12
#: A template with more lines is looked up under salts.
HOT_LINES = 20_000
SALTS = 64
#: Forms of a leaf that are compared by one task at a time; a larger leaf is settled in rounds, part by part.
PART = 2048
LAST = (1 << 63) - 1


def allowance(n: int) -> int:
    """Most variable tokens of a template of ``n`` tokens; under five tokens there is none."""
    return -(-(n - DEPTH) // SEGMENTS) if n >= VARIABLE_TOKENS else n // 5


#: Least tokens of a line that may vary.
MIN_VARIABLE = next(n for n in range(1, 100) if allowance(n))


def line_tokens(data: np.ndarray, offsets: np.ndarray):
    """Per run of whole lines: text, line (position in it), n, h (form), leaf of each line with
    tokens, and all token hashes one after another."""
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 0x0A) + 1]))
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, side="right") - 1
    place = np.arange(len(starts)) - np.searchsorted(starts, offsets[text])
    ends = np.append(starts[1:], len(data))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right")))
        base = starts[lo]
        low, begin = lower_ascii(data[base : ends[hi - 1]]), starts[lo:hi] - base
        letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
        digit = (low >= 0x30) & (low <= 0x39)
        digit &= np.repeat(np.maximum.reduceat(letter, begin), ends[lo:hi] - starts[lo:hi])
        again = digit.copy()
        again[1:] &= digit[:-1]
        again[begin] = False
        low[digit] = 0x30
        kept = np.concatenate([[0], np.cumsum(~again)])
        low = low[~again]
        s, e, line = word_spans(low, np.append(kept[begin], len(low)), SPACE_SEPARATORS)
        hashes = word_hashes(low, s, e)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        n = np.diff(np.append(first, len(line)))
        at = (np.arange(len(line)) - np.repeat(first, n)).astype(np.uint64)
        whole = np.add.reduceat(mix64(hashes + (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), first) if len(first) else np.zeros(0, np.uint64)
        size = n.astype(np.uint64)
        leaf = mix64(size * np.uint64(0xD1342543DE82EF95))
        for k in range(DEPTH):
            token = np.where(n > k, hashes[np.minimum(first + k, len(line) - 1)], np.uint64(k)) if len(first) else hashes
            leaf = mix64(leaf * np.uint64(0xA0761D6478BD642F) ^ token)
        which = line[first] + lo
        yield text[which], place[which], n, mix64(whole ^ size).view(np.int64), leaf.view(np.int64), hashes
        lo = hi


def _lines(rows: DataFrame) -> DataFrame:
    """row, d (doc_id, nulls last), body (hash of the text), line (position), n, h, leaf of every line of (row, doc_id, text)."""

    def run(batches):
        for b in batches:
            row, doc, body = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for text, line, n, h, leaf, _ in line_tokens(*binary_columns(b, "text")):
                cols = (row[text], doc[text], body[text], line.astype(np.int32), n.astype(np.int32), h, leaf)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "d", "body", "line", "n", "h", "leaf"])

    src = rows.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("body"), "text")
    return src.mapInArrow(run, "row long, d long, body long, line int, n int, h long, leaf long")


def _form_tokens(rows: DataFrame) -> DataFrame:
    """h, t (32 bits of each token's hash) of the forms whose length lets them vary."""

    def run(batches):
        for b in batches:
            for _, _, n, h, _, hashes in line_tokens(*binary_columns(b, "text")):
                first = np.cumsum(n) - n
                some = np.unique(h, return_index=True)[1]
                some = some[n[some] >= MIN_VARIABLE]
                tokens = (hashes >> np.uint64(32)).astype(np.uint32)
                t = [tokens[a:z].tobytes() for a, z in zip(first[some].tolist(), (first + n)[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(t, pa.binary())], names=["h", "t"])

    return rows.select("text").mapInArrow(run, "h long, t binary")


def _founders(t: np.ndarray) -> np.ndarray:
    """For each row of ``t`` (forms of one leaf, in order) the row that founds its template."""
    allowed, out = allowance(t.shape[1]), np.full(len(t), -1)
    left = np.arange(len(t))
    while len(left):
        near = (t[left] != t[left[0]]).sum(1) <= allowed
        out[left[near]] = left[0]
        left = left[~near]
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("t").to_pylist()), np.uint32).reshape(len(table), -1)


_FORM = "leaf long, h long, d long, r0 long, r1 long, n_lines long, t binary"
_ORDER = [("d", "ascending"), ("h", "ascending")]
_PLACED = "h long, to long, d long, r0 long, r1 long, n_lines long"


def _found(table: pa.Table) -> pa.Table:
    table = table.select([c.split()[0] for c in _FORM.split(", ")]).sort_by(_ORDER)
    return table.take(pa.array(np.unique(_founders(_matrix(table)))))


def _assign(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each form of a part with the first template of the leaf that it falls under (its founder's h), or null."""
    left, right = left.sort_by(_ORDER), right.sort_by(_ORDER)
    to = np.zeros(len(left), np.int64)
    ok = np.zeros(len(left), bool)
    if len(left) and len(right):
        x = _matrix(left)
        allowed = allowance(x.shape[1])
        for first, h in zip(_matrix(right), right.column("h").to_pylist(), strict=True):
            near = ~ok & ((x != first).sum(1) <= allowed)
            to[near], ok = h, ok | near
            if ok.all():
                break
    out = left.select(["h", "d", "r0", "r1", "n_lines"])
    return out.add_column(1, "to", pa.array(to, pa.int64(), mask=~ok))


_SETTLED = "h long, to long, d long, r0 long, r1 long, n_lines long"


def _settle(batches):
    """Forms sorted by (leaf, d, h), many leaves to a batch: each with its template, the last leaf of a batch with the next one."""
    rest = None
    for b in chain(batches, [None]):
        if b is not None:
            b = b.set_column(b.schema.get_field_index("t"), "t", b.column("t").cast(pa.large_binary()))
        table = pa.Table.from_batches([x for x in (rest, b) if x is not None]).combine_chunks() if rest is not None or b is not None else None
        if table is None or not len(table):
            continue
        whole = table.to_batches()[0]
        leaf = whole.column("leaf").to_numpy()
        starts = np.flatnonzero(np.diff(leaf, prepend=leaf[0] ^ 1))
        end = int(starts[-1]) if b is not None else len(leaf)
        rest, whole = whole.slice(end) if b is not None else None, whole.slice(0, end)
        if not end:
            continue
        t = whole.column("t")
        at = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
        data = np.frombuffer(t.buffers()[2], np.uint8)
        h = whole.column("h").to_numpy()
        to = h.copy()
        edges = np.append(starts[starts < end], end).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            m = data[at[lo] : at[hi]].view(np.uint32).reshape(hi - lo, -1)
            if hi - lo == 2:
                if (m[0] != m[1]).sum() <= allowance(m.shape[1]):
                    to[lo + 1] = h[lo]
            else:
                to[lo:hi] = h[lo + _founders(m)]
        out = [whole.column(c) for c in ("h", "d", "r0", "r1", "n_lines")]
        yield pa.RecordBatch.from_arrays([out[0], pa.array(to), *out[1:]], names=[c.split()[0] for c in _SETTLED.split(", ")])


def _merged(forms: DataFrame, rows: DataFrame) -> DataFrame | None:
    """h, to (its template), d, r0, r1, n_lines of the forms whose leaf has others."""
    some = forms.where(F.col("n") >= MIN_VARIABLE)
    sizes = some.groupBy("leaf").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1")
    pool = some.join(sizes, "leaf").select("leaf", "h", "d", "r0", "r1", "n_lines", "forms")
    pool = written(pool.hint("merge").join(_form_tokens(rows).groupBy("h").agg(F.first("t").alias("t")), "h"), "pool")
    n_pool, n_big = pool.agg(F.count(F.lit(1)), F.count_if(F.col("forms") > PART)).first()
    if not n_pool:
        return None
    small = pool.where(F.col("forms") <= PART).repartition("leaf").sortWithinPartitions("leaf", "d", "h")
    done = written(small.mapInArrow(_settle, _SETTLED), "settled")
    pool = pool.where(F.col("forms") > PART).drop("forms")
    # Larger leaves: a round settles all forms that are near a founder of this round.
    while n_big:
        sizes = pool.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PART))).alias("parts"))
        dealt = pool.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("h", F.lit(11)), F.col("parts"))).drop("parts")
        heads = dealt.groupBy("leaf", "part").applyInArrow(_found, _FORM)
        heads = written(heads.groupBy("leaf").applyInArrow(_found, _FORM), "heads")
        spread = heads.join(sizes, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        placed = dealt.groupBy("leaf", "part").cogroup(spread.groupBy("leaf", "part")).applyInArrow(_assign, _PLACED)
        placed = written(placed, "placed")
        done = done.unionByName(placed.where("to is not null"))
        n_big = placed.where("to is null").count()
        if n_big:
            pool = written(pool.join(placed.where("to is null").select("h"), "h", "left_semi"), "pool")
    return done


def recurring(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """h, template, td (least doc_id of the template), n_lines of forms whose template is found in different rows."""
    forms = lines.groupBy("h").agg(
        F.min("leaf").alias("leaf"), F.min("n").alias("n"), F.min("d").alias("d"), F.min("row").alias("r0"), F.max("row").alias("r1"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    forms = written(forms, "forms")
    merged = _merged(forms, rows)
    alone = forms.where("r0 <> r1")
    if merged is None:
        return alone.select("h", F.col("h").alias("template"), F.col("d").alias("td"), "n_lines")
    alone = alone.join(merged.select("h"), "h", "left_anti").select("h", F.col("h").alias("template"), F.col("d").alias("td"), "n_lines")
    groups = merged.groupBy("to").agg(F.min("d").alias("td"), F.min("r0").alias("a"), F.max("r1").alias("b")).where("a <> b")
    return alone.unionByName(merged.join(groups, "to").select("h", F.col("to").alias("template"), "td", "n_lines"))


def dropped_lines(rows: DataFrame) -> DataFrame:
    """row, drop (sorted positions) of the rows that lose lines."""
    lines = written(_lines(rows), "lines")
    found = written(recurring(lines, rows), "templates")
    # At most one in HOT_LINES of all lines is such a template's hash: spread over all tasks by salt.
    hot = found.where(F.col("n_lines") > HOT_LINES).select("h", F.lit(True).alias("hot"))
    n_hot = hot.count()
    lines = lines.select("h", "d", "body", "row", "line")
    if n_hot:
        salt = F.pmod(F.xxhash64("row", "line"), F.lit(SALTS))
        side = F.broadcast(hot) if n_hot < 100_000 else hot
        lines = lines.join(side, "h", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(F.lit(0).cast("long")))
        spread = F.when(F.col("n_lines") > HOT_LINES, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(
            F.array(F.lit(0).cast("long"))
        )
        pairs = lines.join(found.withColumn("salt", F.explode(spread)), ["h", "salt"])
    else:
        pairs = lines.join(found, "h")
    pairs = written(pairs.select("row", "line", "d", "body", "template", "td"), "pairs")
    # Rows of the least doc_id are few; among them the least text keeps the template.
    least = pairs.where("d = td")
    keepers = least.groupBy("template").agg(F.min(F.struct("body", "row")).alias("k")).select("template", F.col("k.row").alias("keeper"))
    lost = least.join(keepers, "template").where("row <> keeper").select("row", "line")
    lost = lost.unionByName(pairs.where("d <> td").select("row", "line"))
    return lost.groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("drop"))


def count_names(columns: list[str]) -> tuple[str, str]:
    """Names of the two counts that ``drop_templates`` adds, unlike all of ``columns``."""
    names = ["__n_lines", "__n_dropped"]
    while {n.lower() for n in names} & {c.lower() for c in columns}:
        names = [f"{n}_" for n in names]
    return names[0], names[1]


def drop_templates(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` without its dropped lines, and the counts of ``count_names``."""
    n_lines, n_dropped = count_names(docs.columns)
    columns = docs.columns
    small_batches(docs.sparkSession)
    # Rows are numbered once: copies of a row are told apart by it.
    rows = written(docs.select(F.struct("*").alias("r"), F.monotonically_increasing_id().alias("row")), "rows")
    text = F.col("r.`text`").cast("string")
    lost = written(dropped_lines(rows.select("row", F.col("r.`doc_id`").cast("long").alias("doc_id"), text.alias("text"))), "lost-lines")
    # The same join at every size; both sides are dealt by row once.
    joined = rows.hint("merge").join(lost, "row", "left").withColumn("ls", F.split(text, "\n"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(ls) - 1), drop), i -> get(ls, i)), '\n')")
    joined = joined.withColumn("new", F.when(F.col("drop").isNull(), text).otherwise(left))
    return joined.select(
        *(F.col("new" if c == "text" else f"r.`{c}`").alias(c) for c in columns),
        F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(n_dropped),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without recurring lines; those of which nothing but blanks is left go."""
    _, gone = count_names(docs.columns)
    out = drop_templates(docs).where((F.col(gone) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_query(spark, sf_dir: str) -> DataFrame:
    out = drop_templates(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
    )


def brute_force(docs: list[tuple]) -> dict:
    """Reference of the tests: doc_id -> kept text, for distinct doc_ids."""
    import re

    def tokens(line: str) -> list:
        line = line.translate({c: c + 32 for c in range(0x41, 0x5B)})
        if any("a" <= c <= "z" or c > "\x7f" for c in line):
            line = re.sub("[0-9]+", "0", line)
        return [w for w in re.split("[\t-\r ]+", line) if w]

    leaves: dict = {}
    firsts: dict = {}
    where: dict = {}
    for doc, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        for line in text.split("\n"):
            if t := tuple(tokens(line)):
                firsts.setdefault(t, doc)
                where.setdefault(t, set()).add(doc)
    for t in firsts:
        leaf = leaves.setdefault((len(t), t[:DEPTH]), [])
        for group in leaf:
            if sum(a != b for a, b in zip(group[0], t, strict=True)) <= allowance(len(t)):
                group.append(t)
                break
        else:
            leaf.append([t])
    keeper = {t: firsts[g[0]] for leaf in leaves.values() for g in leaf for t in g if len(set.union(*(where[x] for x in g))) > 1}
    gone = lambda line, doc: keeper.get(tuple(tokens(line)), doc) != doc
    return {d: None if t is None else "\n".join(x for x in t.split("\n") if not gone(x, d)) for d, t in docs}
