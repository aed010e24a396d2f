"""Columns and tables that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optabula.cluster import shared_path

# The white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` alone, null text as empty: other columns cannot clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key() -> Column:
    """64 bits of the text; with `doc_id` it tells rows apart that repeat a `doc_id`."""
    return F.xxhash64("text").alias("text_key")


def words(text: str = "text") -> Column:
    """The words of a text, unchanged and in order."""
    return F.filter(F.split(text, f"{WHITE_CLASS}+"), lambda w: w != "")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that `docs` has a column of."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
