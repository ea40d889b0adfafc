"""The driver's tables as the engine's: documents, chunks, questions, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as table rows: one document per size, sections by type."""
    p = table(spark, sf_dir, "part")
    content = F.concat(F.lit("name: "), "p_name", F.lit("\nbrand: "), "p_brand", F.lit("\ntype: "), "p_type", F.lit("\nsize: "), F.col("p_size").cast("string"), F.lit(" mm"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("document_id"), F.col("p_partkey").cast("int").alias("ordinal"), F.lit("table_row").alias("kind"), content.alias("content"), F.col("p_type").alias("section_path"), F.array("p_brand").alias("products"), "p_retailprice")


PART_CHUNKS = """part_chunks AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS document_id, CAST(p_partkey AS INT) AS ordinal, p_type AS section_path, p_brand AS product, p_retailprice,
  'name: ' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || 'type: ' || p_type || chr(10) || 'size: ' || CAST(p_size AS VARCHAR) || ' mm' AS content FROM part)"""


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prose chunks, with the vector of the same number if any."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "embedding", "lang", F.col("source").alias("section_path"), F.md5("text").alias("content_hash"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as prose blocks: a source is a document whose pages
    are the table's documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


LINES = "lines AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS text FROM documents)"


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log: errors are unanswered, views of unknown grounding."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("asked_at"), F.col("user_id").cast("string").alias("principal"), (kind != "error").alias("answered"),
        F.when(kind != "view", kind != "signup").alias("grounded"), F.when(kind == "purchase", 1).when(kind == "click", F.when(F.col("value") < 5, -1)).alias("rating"),
        F.create_map(F.lit("total"), F.col("value")).alias("latency_ms"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("props").alias("answer"), kind.alias("kind"),
    )


QUERY_LOG = """query_log AS (SELECT CAST(event_id AS VARCHAR) AS id, ts AS asked_at, CAST(user_id AS VARCHAR) AS principal, event_type <> 'error' AS answered,
  CASE WHEN event_type <> 'view' THEN event_type <> 'signup' END AS grounded,
  CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' AND value < 5 THEN -1 END AS rating, value AS ms, props AS answer, event_type AS kind FROM events)"""
