"""Tables of a directory, and the retrieval domain seen in them: a document is a note, its source the tenant, its language the category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.col("lang").alias("category"), F.col("text").alias("content"))


def tagged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with tags from the labels; unlabelled notes have none."""
    tags = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.filter(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")), lambda t: t.isNotNull()).alias("tags"))
    return notes(spark, sf_dir).join(tags, "id", "left")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: content hash and file name (that of the language), in order of id."""
    name = F.concat(F.coalesce("category", F.lit("none")), F.lit(".txt"))
    return notes(spark, sf_dir).select("id", "user_id", F.md5("content").alias("md5"), name.alias("filename"), F.col("id").alias("ord"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions of seven users; one of more than two messages has been updated."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = lambda m: F.timestamp_add("MINUTE", m.cast("int"), start)
    last = messages(spark, sf_dir).groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("last"))
    updated = F.when(F.col("last") > 1, at(F.col("session_id") + 40 * F.col("last")))
    return last.select("session_id", F.concat(F.lit("u"), F.col("session_id") % 7).alias("user_id"), at(F.col("session_id")).alias("created_at"), updated.alias("updated_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users."""
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@mail"))
    nation = F.col("c_nationkey")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), email.alias("email"), (nation % 4).cast("int").alias("gender"), (nation % 3).cast("int").alias("status"), F.col("c_mktsegment").alias("bio"))
