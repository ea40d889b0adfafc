"""Incremental sync: what to do with the files of a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds by which a file's time may differ from the recorded one.
MTIME_TOLERANCE = 2


def quick_unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` (path, size, mtime) with ``same``: indexed, of the same size and
    time, so that its content need not be read."""
    docs = known.where("status = 'indexed'").groupBy(F.col("source_path").alias("path")).agg(F.max_by(F.struct("byte_size", "source_mtime"), "id").alias("k"))
    same = (F.col("k.byte_size") == F.col("size")) & (F.abs(F.col("k.source_mtime").cast("double") - F.col("mtime").cast("double")) <= MTIME_TOLERANCE)
    return files.join(docs, "path", "left").withColumn("same", F.coalesce(same, F.lit(False))).drop("k")


def plan(files: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """(path, action, document_id): action is unchanged, moved, changed, new or
    missing.  ``files``: (path, size, mtime, sha256), sha256 only needed where
    size or time differ; ``known``: DOCUMENTS.  Of rows that repeat a path or a
    hash the one with the largest id counts."""
    by_path = known.groupBy(F.col("source_path").alias("path")).agg(F.max_by(F.struct("id", "status", "byte_size", "source_mtime"), "id").alias("p"))
    by_hash = known.groupBy("sha256").agg(F.max_by(F.struct("id", "status", "source_path"), "id").alias("h"))
    seen = files.join(by_path, "path", "left").join(by_hash, "sha256", "left")
    indexed = F.col("p.status") == "indexed"
    quick = indexed & (F.col("p.byte_size") == F.col("size")) & (F.abs(F.col("p.source_mtime").cast("double") - F.col("mtime").cast("double")) <= MTIME_TOLERANCE)
    same_hash = F.col("h.status") == "indexed"
    action = (
        F.when(quick, "unchanged")
        .when(same_hash & (F.col("h.source_path") == F.col("path")), "unchanged")
        .when(same_hash, "moved")
        .when(F.col("p").isNotNull() | F.col("h").isNotNull(), "changed")
        .otherwise("new")
    )
    document = F.when(quick, F.col("p.id")).when(same_hash, F.col("h.id")).otherwise(F.coalesce("p.id", "h.id"))
    acted = seen.select("path", action.alias("action"), document.alias("document_id"))
    moved = acted.where("action = 'moved'").select(F.col("document_id").alias("__m"))
    gone = known.where((F.col("status") == "indexed") & F.col("source_path").startswith(root)).join(files.select(F.col("path").alias("__p")), F.col("source_path") == F.col("__p"), "left_anti")
    gone = gone.join(moved, F.col("id") == F.col("__m"), "left_anti").select(F.col("source_path").alias("path"), F.lit("missing").alias("action"), F.col("id").alias("document_id"))
    return acted.unionByName(gone)


def latest_versions(docs: DataFrame, path: str, version: Column) -> DataFrame:
    """The one row of each path with the largest version: what supersedes."""
    w = Window.partitionBy(path).orderBy(version.desc())
    return docs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def skip_known(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not indexed yet."""
    return files.join(known.where("status = 'indexed'").select("sha256"), "sha256", "left_anti")


def upsert_documents(stored: DataFrame, fresh: DataFrame, keep: tuple[str, ...] = ("id", "title", "products", "page_count", "ingested_at")) -> DataFrame:
    """``stored`` with ``fresh`` rows merged by sha256; on conflict the columns
    ``keep`` stay as stored and all others are taken over."""
    old = stored.select("sha256", F.struct("*").alias("o"))
    merged = fresh.join(old, "sha256", "left")
    columns = [F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in stored.columns]
    return stored.join(fresh.select("sha256"), "sha256", "left_anti").select(*stored.columns).unionByName(merged.select(*columns))


def rollup(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the number and tokens of their chunks, by title."""
    sums = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    joined = documents.join(sums, F.col("id") == F.col("document_id"), "left").drop("document_id")
    return joined.withColumns({"chunks": F.coalesce("chunks", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))}).orderBy("title", "id")
