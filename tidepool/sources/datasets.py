"""The driver's tables as the domain's: notes, history, files, tasks, links, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes: the project is the source, a toxic label stands for a deleted note."""
    labels = read(spark, d, "labels").select("doc_id", "quality", "toxic")
    rows = read(spark, d, "documents").join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), F.col("source").alias("project"), F.col("lang").alias("title"), F.col("text").alias("body"), "n_chars",
        (F.coalesce("quality", F.lit(0)) == 1).alias("pinned"), (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
    )


def history(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as history: an id, the chat, the order in it, who spoke, what."""
    return read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat"), F.col("turn").alias("seq"), F.lit("conversation").alias("entry_type"), F.col("role").alias("actor"), F.col("text").alias("payload"))


def files(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return read(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("path"), F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1).alias("root"),
        F.regexp_extract(html, r'<html lang="([a-z]+)"', 1).alias("language"), F.octet_length(html).cast("bigint").alias("size"), F.sha2(html, 256).alias("hash"), html.alias("text"),
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for x in ("O", "open", "F", "done", "P", "in_progress")])
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.concat_ws(":", F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("external_key"),
        F.try_element_at(status, F.col("o_orderstatus")).alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("due_at"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("weight"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    part = lines.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("uses_part").alias("kind"))
    return part.unionByName(lines.select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.lit("from_supplier").alias("kind")))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as facts; their evidence is the conversation."""
    return read(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("evidence"), F.col("role").alias("fact_type"), F.trim("text").alias("content"), F.col("turn").alias("turn"),
        F.element_at(F.array(F.lit("global"), F.lit("project"), F.lit("chat")), (F.col("turn") % 3 + 1).cast("int")).alias("scope"),
        F.element_at(F.array(F.lit("active"), F.lit("candidate"), F.lit("conflicted"), F.lit("deleted")), (F.col("conv_id") % 4 + 1).cast("int")).alias("status"),
        (F.col("conv_id") % 7).alias("project"), (F.col("turn") % 10 / 10.0).alias("confidence"),
    )
