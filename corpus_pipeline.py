"""A corpus pipeline: five operators, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, line_dedup, mixing, near_dedup
from millrace.llm import toxicity as toxic
from millrace.llm.common import crc_mod, row_key, written

#: The columns of documents; others are left out.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.5 or more. Labels of the held-out fold train nothing here either.

    Null and empty texts have the score of no feature; repeated rows go or stay together, and ties at 0.5 go. Texts of
    any length are scored whole. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxic.train(docs, labels)
    scored = toxic.score(docs, model, carry=COLUMNS, name="__score")
    return scored.filter("__score < 0.5").drop("__score")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in ten documents or more only the first stays; a document that loses all its words goes.

    First is the line of the least doc_id, a null id before all others, at the least place; repeated rows are one
    document and keep the same lines. Texts without a word stay as they are if they lose nothing; null text that stays
    becomes empty. Texts of any length are read whole. An empty table stays empty.
    """
    rest = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    kept = line_dedup.dedup_lines(docs, carry=(*rest, "n_chars"), least_docs=10, keep="first")
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new_size = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return kept.withColumn("n_chars", new_size).withColumnRenamed("kept_text", "text").select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id, of repeated rows one.

    A null id comes last. Texts without a word are no duplicates of each other, and repeated rows of them all stay.
    Texts of any length are compared whole. An empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs)
    own = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("doc"), F.col("row"))
    stay = found.filter(own == F.col("keeper")).groupBy("row").agg(F.count(F.lit(1)).alias("__rows"), F.max("n_shingles").alias("__n"))
    keyed = docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("row")).join(stay, "row")
    keyed = written(keyed, "near-kept")
    repeated = (F.col("__rows") > 1) & (F.col("__n") > 0)
    return keyed.filter(~repeated).unionByName(keyed.filter(repeated).dropDuplicates(["row"])).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item.

    Null and empty texts stay; repeated rows go or stay together. Texts of any length are searched whole. An empty table
    stays empty, and without benchmark items all documents stay.
    """
    found = decontamination.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keyed = docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("row"))
    return keyed.join(found.select("row").distinct(), "row", "left_anti").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left, repeated rows and texts without words included.

    Ties in rank go by id, size and text. Texts of any length count whole, and a source is met as nearly as its last
    document allows. An empty table gives no rows.
    """
    return mixing.pareto_mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]

#: A trained classifier and a hashed sample have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
