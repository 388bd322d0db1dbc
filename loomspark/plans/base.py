"""Registry of queries and the bindings of the reference tables to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runs import numbered_within

QUERIES: dict = {}
SQL: dict = {}


def query(key: str, sql: str | None = None):
    def add(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir: str) -> DataFrame:
    """The catalog table, from documents; about a seventh has no synopsis yet."""
    d = read(spark, sf_dir, "documents")
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return d.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("site_key"), F.col("source").alias("author"), F.substring("text", 1, 40).alias("title"),
        F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("synopsis"), F.when(F.col("doc_id") % 11 != 0, count).cast("bigint").alias("chapter_count"),
        F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))).alias("status"),
        F.element_at(F.array(F.lit(None), F.lit("auto"), F.lit("ambiguous"), F.lit("no_candidates")), (F.col("doc_id") % 4 + 1).cast("int")).alias("resolution"),
        (F.col("doc_id") % 3 == 0).alias("unsampled"),
    )


ITEMS = """items AS (SELECT doc_id AS id, lang AS site_key, source AS author, substr(text, 1, 40) AS title,
  CASE WHEN doc_id % 7 <> 0 THEN text END AS synopsis,
  CASE WHEN doc_id % 11 <> 0 THEN (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT END AS chapter_count,
  CASE WHEN doc_id % 13 <> 0 THEN 's' || (doc_id % 4)::VARCHAR END AS status,
  CASE doc_id % 4 WHEN 1 THEN 'auto' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'no_candidates' END AS resolution,
  doc_id % 3 = 0 AS unsampled FROM documents)"""


def tiers(spark, sf_dir: str) -> DataFrame:
    """Labels with a tier and a source."""
    tier = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.when(F.col("doc_id") % 2 == 0, "love").otherwise("like"))
        .when(F.col("quality") == 1, "meh").when(F.col("toxic") == 0, "drop").otherwise("skip")
    )
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), tier.alias("label"), F.when(F.col("doc_id") % 5 == 0, "read").otherwise("cold").alias("label_source"))


TIERS = """tiers AS (SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'love' ELSE 'like' END
  WHEN quality = 1 THEN 'meh' WHEN toxic = 0 THEN 'drop' ELSE 'skip' END AS label,
  CASE WHEN doc_id % 5 = 0 THEN 'read' ELSE 'cold' END AS label_source FROM labels)"""


def chapters(spark, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    body = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0), F.lit("")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("item_id"), (F.col("turn") + 1).alias("n"), F.col("role").alias("title"), body.alias("body"))


CHAPTERS = """chapters AS (SELECT conv_id AS item_id, turn + 1 AS n, role AS title,
  CASE WHEN conv_id % 9 = 0 AND turn = 0 THEN '' ELSE text END AS body FROM conversations)"""


def attempts(spark, sf_dir: str) -> DataFrame:
    """Fetch outcomes in order per key, from events."""
    e = read(spark, sf_dir, "events")
    n = numbered_within(e, "user_id", ["ts", "event_id"])
    return n.select(F.col("user_id").alias("key"), "n", (F.col("event_type") != "error").alias("ok"), "value")


ATTEMPTS = """attempts AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  event_type <> 'error' AS ok, value FROM events)"""
