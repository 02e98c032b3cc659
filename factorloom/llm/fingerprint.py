"""Threshold-scaled document fingerprints, in DataFrame operations only.

A sketch holds every distinct shingle hash (five words; 32 bits) below a fixed
fraction of the hash space.  Sketches of parts merge by union, and the share of the
smaller sketch found in the other estimates containment however unequal the
documents are.  A text none of whose hashes is below the fraction keeps its least
hash, so that only a text without words has an empty sketch.

Defined results: a null text is an empty one, whose fingerprint is the empty string;
two empty fingerprints have likeness 1, an empty and another 0; rows with equal
doc_id are ordered by text; a null doc_id comes last; a table of one row is its own
next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import only, read_table

SHINGLE_WORDS = 5
#: One of this many hashes is retained.
SCALE = 8
#: Documents of one window block, on average.
BLOCK_ROWS = 1024
#: Block heads that may be broadcast; beyond, they are joined by shuffle.
BROADCAST_HEADS = 100_000


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """Adds ``out``: the sorted retained hashes of ``text`` as an array of longs."""
    words, all_, kept = f"__w_{out}", f"__a_{out}", f"__k_{out}"
    later = ", ".join(f"get({words}, i + {k})" for k in range(1, SHINGLE_WORDS))
    limit = (1 << 32) // scale
    return (
        df.withColumn(words, F.expr(f"transform(filter(split(lower({text}), '[\\\\x09-\\\\x0D ]+'), w -> w != ''), w -> xxhash64(w))"))
        .withColumn(
            all_,
            F.expr(
                f"slice(transform({words}, (w, i) -> xxhash64(w, {later}) & 4294967295L), 1, "
                f"greatest(size({words}) - {SHINGLE_WORDS - 1}, least(size({words}), 1)))"
            ),
        )
        .withColumn(kept, F.expr(f"filter({all_}, h -> h < {limit}L)"))
        .withColumn(
            out,
            F.expr(f"case when size({kept}) > 0 then array_sort(array_distinct({kept})) when size({all_}) > 0 then array(array_min({all_})) else cast(array() as array<bigint>) end"),
        )
        .drop(words, all_, kept)
    )


def fingerprint_string(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, h -> lpad(lower(hex(h)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Containment of the smaller sketch in the larger."""
    return F.expr(
        f"case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D "
        f"else size(array_intersect({a}, {b})) / cast(least(size({a}), size({b})) as double) end"
    )


def _followers(heads: DataFrame) -> DataFrame:
    """__hb, __head, __guest: for each block the one before it in descending order; the lowest comes before the topmost.

    Blocks are ordered within groups of about a thousand, then the groups, so that the last window has a
    millionth of the documents.
    """
    groups = F.shiftright("__block", 10)
    heads = heads.withColumn("__group", groups)
    inner = Window.partitionBy("__group").orderBy(F.col("__block").desc())
    heads = heads.withColumn("__before", F.lag("__block").over(inner))
    ends = heads.groupBy("__group").agg(F.max("__block").alias("__top"), F.min("__block").alias("__bottom"))
    order = Window.orderBy(F.col("__top").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("__top").alias("__hb"), F.coalesce(F.lag("__bottom").over(order), F.min("__bottom").over(whole)).alias("__across"))
    heads = heads.select("__head", F.col("__block").alias("__hb"), "__before").join(ends, "__hb", "left")
    return heads.select("__hb", "__head", F.coalesce("__before", "__across").alias("__guest"))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``next_<c>`` of the next document by descending doc_id, wrapping at the end.

    Ids are cut into blocks by their leading bits, as many bits as give blocks of about BLOCK_ROWS rows
    wherever the ids are.  The first row of each block is also sent to the block before it, as
    the row that follows that block's last; so one shuffle by block suffices and no task sees more
    than a block at a time (rows of one doc_id are in one block).
    """
    shifts = range(1, 63, 2)
    sizes = docs.agg(F.count(F.lit(1)), *(F.approx_count_distinct(F.shiftright("doc_id", k)) for k in shifts)).first()
    n, blocks = sizes[0], dict(zip(shifts, sizes[1:], strict=True))
    shift = max((k for k in shifts if blocks[k] * BLOCK_ROWS >= n), default=1)
    # The lowest long is no shifted id: rows without an id are a block of their own, the last one.
    block = F.coalesce(F.shiftright("doc_id", shift), F.lit(-(1 << 63)))
    rows = docs.withColumn("__block", block)
    heads = _followers(rows.groupBy("__block").agg(F.max("doc_id").alias("__head")))
    heads = F.broadcast(heads) if blocks[shift] <= BROADCAST_HEADS else heads
    same = rows["__block"].eqNullSafe(heads["__hb"]) & rows["doc_id"].eqNullSafe(heads["__head"])
    dealt = rows.join(heads, same, "left").withColumn(
        "__at",
        F.explode(
            F.expr(
                "case when __guest is null then array(struct(__block as b, 0 as g)) "
                "else array(struct(__block as b, 0 as g), struct(__guest as b, 1 as g)) end"
            )
        ),
    )
    w = Window.partitionBy("__b").orderBy("__g", F.col("doc_id").desc_nulls_last(), "text")
    dealt = dealt.select(*docs.columns, F.col("__at.b").alias("__b"), F.col("__at.g").alias("__g"))
    return dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).where("__g = 0").drop("__b", "__g")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, text and its sketch (array of longs) for every document."""
    src = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return with_sketch(src, "text", "sketch", scale)


def op10_query(spark, sf_dir: str) -> DataFrame:
    base = fingerprints(read_table(spark, sf_dir, "documents"))
    rows = with_next(base, ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn(
        "edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")
    )
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_string("sketch").alias("fingerprint"),
        fingerprint_string("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
