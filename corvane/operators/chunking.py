"""Chunks of parsed documents: every table row alone, prose accumulated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.tables import rendered
from corvane.settings import Settings


def split_long(blocks: DataFrame, target: int, overlap: int, text: str = "text") -> DataFrame:
    """Prose longer than ``target`` in windows of it, each starting ``target -
    overlap`` after the one before, until the end is covered; ``part`` numbers
    the windows from 0.  Native: a sequence, exploded."""
    n, stride = F.length(text), target - overlap
    starts = F.when(n > target, F.sequence(F.lit(0), F.ceil((n - target) / stride).cast("int") * stride, F.lit(stride))).otherwise(F.array(F.lit(0)))
    cut = F.when(F.length(text) > target, F.substr(F.col(text), F.col("__at") + 1, F.lit(target))).otherwise(F.col(text))
    return blocks.select("*", F.posexplode(starts).alias("part", "__at")).withColumn(text, cut).drop("__at")


def accumulate(blocks: Iterator[tuple], target: int, overlap: int) -> Iterator[tuple]:
    """(kind, body, section, page_from, page_to) of one document's chunks from
    its blocks (kind, text, section, page) in order.

    Prose gathers until its length reaches ``target`` or the section changes; a
    last block of at most ``overlap`` characters is carried into the next
    chunk, and comes again by itself if nothing follows it.
    """
    held: list[tuple] = []

    def flush():
        if held:
            yield "prose", "\n".join(b[1] for b in held), held[0][2], held[0][3], held[-1][3]

    for block in blocks:
        if block[0] == "table_row":
            yield from flush()
            held = []
            yield "table_row", block[1], block[2], block[3], block[3]
            continue
        if held and block[2] != held[-1][2]:
            yield from flush()
            held = []
        held.append(block)
        if sum(len(b[1]) for b in held) >= target:
            yield from flush()
            held = held[-1:] if len(held[-1][1]) <= overlap else []
    yield from flush()


BODY = "doc long, ordinal int, kind string, body string, section_path string, page_from int, page_to int"


def chunk(blocks: DataFrame, docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """CHUNKS without embeddings, from blocks (doc, pos, kind, text, pairs, grp,
    unit, page, section_path) and documents (doc, title, products).

    A document's blocks stream through a task in order and only the prose being
    gathered is held.  Null texts are empty; documents without blocks have no
    chunks; other columns are left out.
    """
    s = settings or Settings()
    if s.chunk_target_chars <= 0 or not 0 <= s.chunk_overlap_chars < s.chunk_target_chars:
        raise ValueError("chunk_overlap_chars must be at least 0 and below chunk_target_chars")
    target, overlap = s.chunk_target_chars, s.chunk_overlap_chars
    is_row = F.col("kind") == "table_row"
    body = F.when(is_row, rendered(F.col("grp"), F.col("pairs"), F.col("unit"))).otherwise(F.coalesce("text", F.lit("")))
    flat = blocks.select("doc", "pos", "kind", body.alias("text"), F.coalesce("section_path", F.lit("")).alias("section_path"), F.coalesce("page", F.lit(0)).cast("int").alias("page"))
    prose = split_long(flat.where(~is_row), target, overlap)
    rows = prose.unionByName(flat.where(is_row).withColumn("part", F.lit(0)))
    rows = rows.repartition("doc").sortWithinPartitions("doc", "pos", "part", "text").select("doc", "kind", "text", "section_path", "page")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import itertools

        stream = (r for b in batches for r in b.itertuples(index=False))
        names = ["doc", "ordinal", "kind", "body", "section_path", "page_from", "page_to"]
        out: list = []
        for doc, own in itertools.groupby(stream, key=lambda r: r.doc):
            for i, c in enumerate(accumulate(((r.kind, r.text, r.section_path, r.page) for r in own), target, overlap)):
                out.append((doc, i, *c))
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    made = rows.mapInPandas(run, BODY).join(docs.select("doc", "title", F.col("products").alias("__all")), "doc")
    made = made.withColumn("products", T.narrow_products(F.col("body"), F.col("__all")))
    content = T.with_header(F.col("products"), F.col("section_path"), F.col("title"), F.col("body"))
    made = made.withColumn("content", content)
    return made.select(
        F.xxhash64("doc", "ordinal").alias("id"), F.col("doc").alias("document_id"), "ordinal", "kind", "content", "section_path", "page_from", "page_to", "products",
        F.lit(None).cast("array<float>").alias("embedding"), T.token_estimate(F.col("content")).alias("token_count"), T.content_hash(F.col("products"), F.col("body")).alias("content_hash"),
    )
