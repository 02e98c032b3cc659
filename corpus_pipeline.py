"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage works on all that the one before it kept, written as Parquet in the shared
folder (``spark.checkpoint.dir``) and reread; then the tables that the stage made on its
way, and the stage before's result, are dropped.  All but the last return the columns of
``documents``, whatever other columns they carry.

Defined results: null and empty texts pass every stage as empty documents, and each is packed as
its end token; rows equal in doc_id and text are copies, of which one stays; rows of one doc_id
with different texts, and rows without a doc_id, are judged each by its own text; a document
whose lines are all dropped goes with them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import decontam, jaccard, packing, templates, toxicity
from factorloom.llm.common import n_made, read_table, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: No stage but the third is within SQL's reach; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = read_table(spark, sf_dir, "documents"), n_made()
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}", since)
    return docs
