"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes what the stage before it kept.  ``run`` writes every stage's result to the shared
folder and reads it back, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglean.llm import jaccard, mixing, packing, secrets, toxicity
from lakeglean.llm.scratch import Scratch


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """``docs``, written, with a number ``__row`` and a hash ``__hash`` of each row: ids may be null or shared."""
    return Scratch(spark, name).cut(docs.withColumns({"__row": F.monotonically_increasing_id(), "__hash": F.xxhash64(*docs.columns)}), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model is fitted on labelled ones."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id (null: the last).

    Groups are of rows, so texts that share an id but aren't linked all stay.  Of rows without words
    one of each id stays, and every one without id.
    """
    rows = _numbered(spark, docs, "near-duplicates")
    classes = jaccard.shingle_classes(rows.select(F.col("__row").alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias("__row"), "component_id", "n_shingles")
    wordless = F.col("n_shingles") == 0
    # rows of the component, or of the id if there are no words
    group = F.struct(wordless.alias("wordless"), F.when(wordless & F.col("doc_id").isNotNull(), F.col("doc_id").cast("string")).alias("id"), F.when(~wordless | F.col("doc_id").isNull(), F.col("component_id")).alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__hash", "__row"))
    keep = rows.select("__row", "__hash", "doc_id").join(classes, "__row").groupBy(group.alias("group")).agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(keep, "__row", "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that the scan finds is replaced by a mark."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it."""
    rows = _numbered(spark, docs, "mix")
    taken = mixing.mixed(rows, mixing.word_count(F.col("text")), keys=("__hash", "__row")).where("taken > 0").select("__row", (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    repeated = rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.packed(docs, mixing.word_count(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the toxicity model and best-fit packing; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
