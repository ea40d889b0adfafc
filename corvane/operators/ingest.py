"""Files into the store: parse, chunk, embed, and replace atomically."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.embedding import Embedder, embedded
from corvane.operators import blocks as B
from corvane.operators import sync
from corvane.operators.chunking import chunk
from corvane.settings import Settings
from corvane.sources import files as sources
from corvane.sources.store import Store


def document_rows(files: DataFrame, parsed: DataFrame, acl: list[str], settings: Settings, embedder: Embedder) -> DataFrame:
    """DOCUMENTS for parsed files; ids come from the content."""
    review = B.scanned(parsed.select("path", "page_count", F.coalesce("text", F.array_join("pairs.v", " ")).alias("text")), "path", least=settings.min_chars_per_page)
    heads = parsed.groupBy("path").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("title", "products", "page_count", "error")])
    now = F.current_timestamp()
    rows = files.select("path", "size", "mtime", "sha256").join(heads, "path").join(review, "path", "left")
    look = F.coalesce("needs_review", F.lit(False)) & (F.col("page_count") > 0)
    meta = F.struct(
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"), F.lit(embedder.name).alias("provider"), F.lit(embedder.name).alias("model"), F.lit(settings.chunk_target_chars).alias("chunk_chars"),
        F.when(look, F.array(F.lit("few characters a page: it may be scanned"))).otherwise(F.array().cast("array<string>")).alias("warnings"), look.alias("needs_review"),
    )
    return rows.select(
        F.xxhash64("sha256").alias("id"), F.col("path").alias("source_path"), "title", "products", "sha256", "page_count", F.when(F.col("error").isNull(), "indexed").otherwise("failed").alias("status"), "error", meta.alias("meta"),
        F.array(*map(F.lit, acl)).cast("array<string>").alias("acl_groups"), F.lit("file").alias("source_kind"), F.col("size").alias("byte_size"), F.col("mtime").alias("source_mtime"), now.alias("ingested_at"), now.alias("updated_at"),
    )


def ingest(store: Store, root: str, embedder: Embedder, settings: Settings | None = None, acl: list[str] | None = None, force: bool = False, supersede: bool = False) -> DataFrame:
    """Index the files of a directory; returns (path, status, chunks, error).

    Content that is indexed already is skipped unless forced.  A file that
    fails keeps what was indexed of it; if nothing was, it is recorded as
    failed.  Chunks are replaced only when all their vectors exist."""
    s, spark = settings or Settings(), store.spark
    known = store.read("documents", schemas.DOCUMENTS)
    # Of files with the same content the one with the least path counts; only names and hashes are shuffled.
    names = sources.scan(spark, root).drop("content")
    store.replace("staged_files", names.join(names.groupBy("sha256").agg(F.min("path").alias("path")), ["sha256", "path"], "left_semi"))
    files = store.read("staged_files", "path string, size long, mtime timestamp, sha256 string")
    fresh = files if force else sync.skip_known(files, known)
    chosen = sources.scan(spark, root).join(fresh.select("path", "sha256"), ["path", "sha256"], "left_semi")
    # Every file is parsed once; what follows reads the blocks.
    store.replace("staged_blocks", sources.parse(chosen))
    parsed = store.read("staged_blocks", sources.PARSED)
    prose = B.drop_boilerplate(B.clean_prose(parsed.where("kind = 'prose'")), "path")
    rows = parsed.where("kind = 'table_row'").drop("unit").join(B.unit_notes(prose, ["path", "page"]), ["path", "page"], "left").withColumn("unit", F.coalesce("unit", F.lit("")))
    docs = document_rows(fresh, parsed, acl or [], s, embedder)
    named = lambda df: df.join(docs.where("status = 'indexed'").select("id", F.col("source_path").alias("path")), "path").withColumnRenamed("id", "doc")
    chunks = chunk(named(prose.unionByName(rows)), docs.select(F.col("id").alias("doc"), "title", "products"), s)
    chunks = chunks.withColumn("embedding", embedded(F.col("content"), embedder, s.embed_batch_size, strict=False))
    store.replace_all({"staged_documents": docs, "staged_chunks": chunks})
    chunks = store.read("staged_chunks", schemas.CHUNKS)
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.count("embedding").alias("vectors"))
    docs = store.read("staged_documents", schemas.DOCUMENTS).join(counts, "id", "left")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("chunks").isNull(), "no chunks").when(F.col("vectors") < F.col("chunks"), "embedding failed")
    docs = docs.withColumn("error", error).withColumn("status", F.when(error.isNull(), "indexed").otherwise("failed"))
    good = docs.where("status = 'indexed'")
    # A document that was indexed stays so, with its chunks and the new error.
    before = known.where("status = 'indexed'").select(F.col("sha256").alias("__b"))
    record = docs.join(before, F.col("sha256") == F.col("__b"), "left").withColumn("status", F.when(F.col("__b").isNotNull(), "indexed").otherwise(F.col("status")))
    merged = sync.upsert_documents(known, record.select(*known.columns))
    if supersede:
        newer = good.select(F.col("source_path").alias("__p"), F.col("sha256").alias("__s"))
        merged = merged.join(newer, (F.col("source_path") == F.col("__p")) & (F.col("sha256") != F.col("__s")), "left_anti")
    old, ids = store.read("chunks", schemas.CHUNKS), good.select(F.col("id").alias("document_id"))
    kept = old.join(ids, "document_id", "left_anti").select(*old.columns).unionByName(chunks.join(ids, "document_id", "left_semi").select(*old.columns))
    store.replace_all({"chunks": kept.join(merged.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*old.columns), "documents": merged})
    return docs.select(F.col("source_path").alias("path"), "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), "error")


def delete_document(store: Store, document_id: int) -> bool:
    """Delete a document with its chunks; whether it was there."""
    docs = store.read("documents", schemas.DOCUMENTS)
    if docs.where(F.col("id") == document_id).limit(1).count() == 0:
        return False
    chunks = store.read("chunks", schemas.CHUNKS)
    store.replace_all({"chunks": chunks.where(F.col("document_id") != document_id), "documents": docs.where(F.col("id") != document_id)})
    return True


class Jobs:
    """Job rows in the store: queued, running, then done or failed."""

    def __init__(self, store: Store):
        self.store = store

    def _put(self, **row) -> None:
        self.store.append("jobs", self.store.spark.createDataFrame([row], schemas.JOBS))

    def run(self, kind: str, work: Callable[[], dict[str, int]]) -> str:
        """Run ``work`` and record each state; errors are cut to 2000 characters."""
        import datetime as dt

        job, now = uuid.uuid4().hex, lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)
        row = {"id": job, "kind": kind, "status": "queued", "detail": None, "stats": None, "created_at": now(), "started_at": None, "finished_at": None}
        self._put(**row)
        row |= {"status": "running", "started_at": now()}
        self._put(**row)
        try:
            row |= {"stats": work(), "status": "done"}
        except Exception as e:
            row |= {"status": "failed", "detail": str(e)[:2000]}
        self._put(**row | {"finished_at": now()})
        return job

    def list(self, n: int = 50) -> DataFrame:
        """The latest state of the latest jobs."""
        order = F.when(F.col("status") == "queued", 0).when(F.col("status") == "running", 1).otherwise(2)
        w = Window.partitionBy("id").orderBy(order.desc())
        return self.store.read("jobs", schemas.JOBS).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy(F.desc("created_at"), "id").limit(n)
