"""Documents to training shards: a chain of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``docs``.  Stages that decide on single documents leave them where they are; near
duplicates and the mix join their decisions back to the documents by id.

Cases, besides those of the operators: rows that share an id queue up one after the other in
the mix; the near-duplicate stage tells rows apart by their place, so it
keeps one row of each component whether ids are null, repeated or unique; columns that
``docs`` has besides ``doc_id``, ``text`` and ``source`` come through, whatever their names (but
``_row``); the last stage adds size, shard and slot, and columns of the documents
that have one of these names come out of it as in_size, in_shard and in_slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.llm import decontaminate, mix, shard, similar, toxicity
from stepline.llm.common import cut, fresh_path, table
from stepline.llm.queries import CATEGORIES, SHARDS, toxicity_chain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain holds to be toxic go."""
    return toxicity.drop_toxic(docs, toxicity_chain(spark, sf_dir), CATEGORIES.index("toxic"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts of shingle similarity 0.8 or more, a row of the document with the smallest id stays."""
    # docs are files, whose rows have the same numbers each time they are read
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    found = similar.near_copies(numbered.select("_row", "text"), id_col="_row").select(F.col("id").alias("_row"), "component")
    choice = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = found.join(numbered.select("_row", "doc_id"), "_row").groupBy("component").agg(F.min(choice)["_row"].alias("_row"))
    return numbered.join(cut(first.select("_row")), "_row", "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, within its error budget, go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mix.training_order(mix.mix(docs, keep=docs.columns), docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near equal bytes, in the order of the rows in their files (of ids, if they come from no files)."""
    order = ["doc_id"]
    if docs.inputFiles():
        order = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return shard.assign_shards(docs, shard.text_bytes(F.col("text")), order, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", one_of_near_copies),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: Shingle similarities, edit distances and a fitted chain are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
