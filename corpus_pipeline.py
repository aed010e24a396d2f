"""The corpus pipeline: from documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`. Rows
keep their columns; a text that loses lines gets a new `n_chars`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optabula.cluster import shared_path
from optabula.llm.common import fresh, table, written
from optabula.llm.decontaminate import contaminated
from optabula.llm.line_runs import LAST_ID, dedup_lines
from optabula.llm.ordinal import classify
from optabula.llm.packing import pack
from optabula.llm.simhash import simhash_groups


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts count as empty, null doc_ids are scored, repeated rows are judged each; without
    ratings, or without documents, none goes.
    """
    rated = classify(docs, table(spark, sf_dir, "labels"))
    return rated.where(F.col(rated.columns[-1]).kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go.

    Null texts have none; null doc_ids come last; rows that repeat doc_id and text are one document
    and stay each; empty tables stay empty.
    """
    cut = dedup_lines(docs)
    info = F.col(cut.columns[-1])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(
            info.n_removed > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first by doc_id, then text.

    Nulls come last, and of rows that repeat both doc_id and text one stays.
    """
    doc_id, key = fresh(docs, "__id", "__text_key")
    groups = simhash_groups(docs, shingle=4, distance=4).withColumn(
        "place", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    first = written(groups.groupBy("root").agg(F.min("place").alias("p")).select(
        F.coalesce("p.doc_id", F.lit(LAST_ID)).alias(doc_id), F.col("p.text_key").alias(key)),
        "first")
    keyed = docs.withColumns({
        doc_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)),
        key: F.xxhash64(F.coalesce("text", F.lit("")))})
    once = keyed.join(first, [doc_id, key], "left_semi")
    return once.dropDuplicates([doc_id, key]).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null and empty texts stay, repeated rows go or stay together, null doc_ids are compared as such;
    without benchmark items all stay.
    """
    doc_id, key = fresh(docs, "__id", "__text_key")
    found = written(contaminated(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").alias(doc_id), F.col("text_key").alias(key)).distinct(), "contaminated")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(found, (keyed[key] == found[key]) & keyed.doc_id.eqNullSafe(
        found[doc_id]), "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids; a null or empty text is its end id alone.

    Repeated rows are packed each; no documents give no sequences.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

# SQL can express neither the trained classifier nor the tokenizer's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next.

    Columns beside doc_id and text, whatever their names, pass through all stages but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
