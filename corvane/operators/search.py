"""The four retrieval paths, their filters, and fusion.

All of it works on a batch of questions: ``questions`` has a query_id, and each
path gives (query_id, chunk_id, score, rank).  A single question is a batch of
one.  Access and product filters come before the cut to the best, never after.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.embedding import cosine
from corvane.functions.trigrams import word_similarity
from corvane.operators import blockwise
from corvane.settings import Settings

PATHS = ("dense", "sparse", "exact", "trigram")
#: Questions whose side is too large to be sent to all tasks are dealt by hash
#: into blocks of about so many, which the chunks meet in turn.
BLOCK_QUESTIONS = 20_000


@dataclass(frozen=True)
class Filters:
    """``None`` switches a filter off.  Empty products or ids are off as well;
    empty ``groups`` mean public documents only."""

    products: Sequence[str] | None = None
    groups: Sequence[str] | None = None
    document_ids: Sequence[int] | None = None

    def predicate(self, status: str = "status", products: str = "products", acl: str = "acl_groups", document_id: str = "document_id") -> Column:
        out = F.col(status) == "indexed"
        if self.products:
            out = out & F.arrays_overlap(F.col(products), F.array(*map(F.lit, self.products)))
        if self.groups is not None:
            out = out & acl_predicate(F.col(acl), self.groups)
        if self.document_ids:
            out = out & F.col(document_id).isin(list(self.document_ids))
        return out


def acl_predicate(acl: Column, groups: Sequence[str] | None) -> Column:
    """Public, or shared with one of the groups; ``None`` sees everything."""
    if groups is None:
        return F.lit(True)
    public = F.size(F.coalesce(acl, F.array().cast("array<string>"))) == 0
    return public | F.arrays_overlap(acl, F.array(*map(F.lit, groups))) if groups else public


def visible(chunks: DataFrame, documents: DataFrame, filters: Filters) -> DataFrame:
    """Chunks with their documents' title, path, status and access groups, as
    far as the filters let them through."""
    docs = documents.select(F.col("id").alias("__doc"), "title", "source_path", "status", "acl_groups")
    return chunks.join(docs, F.col("document_id") == F.col("__doc")).drop("__doc").where(filters.predicate())


def selected(paths: Sequence[str] | None) -> tuple[str, ...]:
    unknown = [p for p in paths or () if p not in PATHS]
    if unknown:
        raise ValueError(f"unknown search path {unknown[0]!r}")
    return tuple(p for p in PATHS if p in paths) if paths else PATHS


def top(scored: DataFrame, n: int, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The best ``n`` of each query, ranked from 1.  The cut is also applied
    within each task before rows are shuffled."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= n)


def asked_terms(questions: DataFrame, column: str = "terms") -> DataFrame:
    """(query_id, term): the distinct words of an array column."""
    return questions.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(column, T.tokens)))).alias("term"))


def postings(chunks: DataFrame, chunk_id: str = "id", content: str = "content", only: DataFrame | None = None, positions: bool = True) -> DataFrame:
    """(term, chunk_id, tf, positions, length): the inverted index, or the part
    of it for the terms of ``only`` (term), which are picked before words are
    aggregated; without positions if nothing asks for them."""
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), T.tokens(F.col(content)).alias("w"))
    rows = words.select("chunk_id", F.size("w").alias("length"), F.posexplode("w").alias("pos", "term"))
    rows = rows if only is None else rows.join(only.select("term").distinct(), "term", "left_semi")
    where = [F.array_sort(F.collect_list("pos")).alias("positions")] if positions else []
    return rows.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), *where, F.max("length").alias("length"))


def within(scored: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``scored`` (query_id, chunk_id, score) without chunks that have none of
    the products that the question's ``only`` limits it to, if it does."""
    if "only" not in questions.columns or "products" not in chunks.columns:
        return scored
    limit = questions.select("query_id", F.col("only").alias("__only"))
    own = scored.join(limit, "query_id").join(chunks.select(F.col("id").alias("chunk_id"), F.col("products").alias("__p")).hint("merge"), "chunk_id")
    free = F.coalesce(F.size("__only"), F.lit(0)) <= 0
    return own.where(free | F.arrays_overlap("__only", "__p")).select(*scored.columns)


def dense(questions: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Nearest by cosine, ties by chunk id; chunks without a vector are out.
    ``questions``: (query_id, vector), and ``only``, if some are limited to
    products of the chunks."""
    small = blockwise.numbered(questions, "vector", 16)
    if small is not None:
        scored = blockwise.cosines(*small, chunks, n) if small[0].ids else _none(questions, chunks)
    else:
        left = chunks.where(F.col("embedding").isNotNull()).select(F.col("id").alias("chunk_id"), "embedding")
        blocks = -(-questions.count() // BLOCK_QUESTIONS)
        dealt = questions.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
        met = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "block")
        scored = met.select("query_id", "chunk_id", F.round(cosine(F.col("embedding"), F.col("vector")), 9).alias("score")).where(F.col("score").isNotNull())
        scored = within(scored, questions, chunks)
    return top(scored, n, F.desc("score"), F.asc("chunk_id"))


def sparse(questions: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Chunks with any of the ``terms``; 0.1 for every occurrence over 1 + ln of
    the chunk's length.  ``questions``: (query_id, terms array), and ``only`` as
    in ``dense``.  A term of several words counts by its words."""
    small = blockwise.numbered(questions, "terms", 64)
    scored = None if small is None else blockwise.occurrences(*small, chunks, n) if small[0].ids else _none(questions, chunks)
    if scored is None:
        asked = asked_terms(questions)
        hits = postings(chunks, only=asked, positions=False).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
        scored = hits.select("query_id", "chunk_id", F.round(F.lit(0.1) * F.col("tf") / (1 + F.log("length")), 9).alias("score"))
        scored = within(scored, questions, chunks)
    return top(scored, n, F.desc("score"), F.asc("chunk_id"))


def _none(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    return questions.select("query_id").limit(0).crossJoin(chunks.select(F.col("id").alias("chunk_id")).limit(0)).withColumn("score", F.lit(0.0))


def cover_density(lists: list[list[int]]) -> float:
    """Sum over minimal covers of 0.1 over the words between, for positions of
    terms that must all occur."""
    import heapq

    if any(not x for x in lists):
        return 0.0
    marks = heapq.merge(*[[(p, k) for p in x] for k, x in enumerate(lists)])
    last: dict[int, int] = {}
    score, begun = 0.0, -1
    for p, k in marks:
        last[k] = p
        if len(last) == len(lists) and (start := min(last.values())) > begun:
            score += 0.1 / max(1, p - start - len(lists) + 2)
            begun = start
    return score


def exact(questions: DataFrame, index: DataFrame, n: int, chunks: DataFrame | None = None) -> DataFrame:
    """Chunks with all words of all ``identifiers``, by cover density.
    Questions without identifiers have no rows; those with ``only`` products
    have chunks with such, by ``chunks``."""
    asked = asked_terms(questions, "identifiers")
    need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    hits = index.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("got"), F.collect_list("positions").alias("lists"))
    full = hits.join(need, "query_id").where(F.col("got") == F.col("need"))

    @F.pandas_udf("double")
    def density(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([cover_density([list(x) for x in lists]) for lists in batch], dtype=float)

    scored = full.select("query_id", "chunk_id", F.round(density("lists"), 9).alias("score"))
    return top(scored if chunks is None else within(scored, questions, chunks), n, F.desc("score"), F.asc("chunk_id"))


def gram_index(chunks: DataFrame, chunk_id: str = "id", content: str = "content") -> DataFrame:
    """(gram, chunk_id): trigrams of each chunk's words, padded as ``  word ``."""
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(r"(?U)\w+"), F.lit(0)))).alias("w"))
    return words.select("chunk_id", F.explode(grams_of(F.col("w"))).alias("gram")).distinct()


def grams_of(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram(questions: DataFrame, chunks: DataFrame, n: int, threshold: float = 0.6) -> DataFrame:
    """Chunks whose word similarity to ``trigram_text`` reaches the threshold.
    A chunk must share that part of the question's trigrams to get there, so an
    inverted index finds the candidates: of the questions' trigrams in each task,
    or of the chunks' if the questions are too large to be sent."""
    small = blockwise.numbered(questions, "trigram_text", 200, F.length)
    if small is not None:
        scored = blockwise.similarities(*small, chunks, n, threshold) if small[0].ids else _none(questions, chunks)
    else:
        scored = _trigram_joins(questions, chunks, threshold)
    return top(scored.where(F.col("score") >= threshold), n, F.desc("score"), F.asc("chunk_id"))


def _trigram_joins(questions: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """Both sides may be large while their files are small, from which Spark would
    take them for small enough to go through the driver: so all joins are merges."""
    asked = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("trigram_text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("w"))
    grams = asked.select("query_id", F.explode(grams_of(F.col("w"))).alias("gram")).distinct()
    need = grams.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    shared = gram_index(chunks).join(grams.hint("merge"), "gram").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("got"))
    likely = shared.join(need.hint("merge"), "query_id").where(F.col("got") >= F.col("n") * threshold).select("query_id", "chunk_id")
    pairs = likely.join(chunks.select(F.col("id").alias("chunk_id"), "content").hint("merge"), "chunk_id").join(questions.select("query_id", "trigram_text").hint("merge"), "query_id")

    @F.pandas_udf("double")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series([word_similarity(a or "", b or "") for a, b in zip(q, t, strict=True)], dtype=float)

    scored = pairs.select("query_id", "chunk_id", F.round(similar("trigram_text", "content"), 9).alias("score")).where(F.col("score") >= threshold)
    return within(scored, questions, chunks)


def fuse(paths: dict[str, DataFrame], weights: dict[str, float], k: int = 60, n: int = 50) -> DataFrame:
    """(query_id, chunk_id, score, paths, rank): weighted reciprocal ranks; ties
    by chunk id.  ``paths`` maps the path to the rank it gave."""
    named = [df.select("query_id", "chunk_id", F.col("rank").cast("int").alias("r"), F.lit(name).alias("path"), F.lit(float(weights.get(name, 1.0))).alias("w")) for name, df in paths.items()]
    rows = named[0]
    for df in named[1:]:
        rows = rows.unionByName(df)
    sums = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("w") / (k + F.col("r"))), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "r")))).alias("paths")
    )
    return top(sums, n, F.desc("score"), F.asc("chunk_id"))


def dedupe(ranked: DataFrame, key: Column) -> DataFrame:
    """The best-ranked row of each key and query, ranked anew."""
    first = Window.partitionBy("query_id", key).orderBy("rank")
    kept = ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def interleave(ranked: DataFrame, n: int) -> DataFrame:
    """Round robin over the products of a comparison: (query_id, product_no,
    chunk_id, rank) to the first ``n`` distinct chunks of each query."""
    turn = ranked.select("query_id", "chunk_id", F.struct("rank", "product_no").alias("at"))
    first = turn.groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    return top(first, n, F.col("at.rank").asc(), F.col("at.product_no").asc()).select("query_id", "chunk_id", "rank")


def per_product(top_k: int, products: int) -> int:
    return max(3, top_k // products + 1)


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """``hits`` (query_id, chunk_id, document_id, ordinal, kind) with
    ``neighbours``: the last lines, of at most 200 characters, of the table rows
    around a table row, in order."""
    asked = hits.where("kind = 'table_row'").select("query_id", "chunk_id", "document_id", F.col("ordinal").alias("at"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("delta")).where("delta <> 0").withColumn("ordinal", F.col("at") + F.col("delta"))
    lines = F.split(F.trim("content"), r"\R")
    rows = chunks.where("kind = 'table_row'").select("document_id", "ordinal", F.substring(F.element_at(lines, -1), 1, 200).alias("line"))
    found = asked.join(rows, ["document_id", "ordinal"]).groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("delta", "line"))).alias("x"))
    out = hits.join(found.select("query_id", "chunk_id", F.col("x.line").alias("neighbours")), ["query_id", "chunk_id"], "left")
    return out.withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def within_budget(ranked: DataFrame, size: Column, budget: int) -> DataFrame:
    """The first hits whose sizes fit; the first always does."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("__used", F.sum(size).over(upto)).where((F.col("rank") == 1) | (F.col("__used") <= budget)).drop("__used")


def hybrid(questions: DataFrame, chunks: DataFrame, documents: DataFrame, filters: Filters, settings: Settings | None = None, paths: Sequence[str] | None = None) -> DataFrame:
    """The fused and deduplicated candidates with their chunks' columns.

    ``questions``: (query_id, vector, terms, identifiers, trigram_text), any of
    which may be missing if its path is not selected, and ``only``, products
    that a question is limited to."""
    s = settings or Settings()
    use = selected(paths)
    shown = visible(chunks, documents, filters)
    make = {
        "dense": lambda: dense(questions, shown, s.search_candidates),
        "sparse": lambda: sparse(questions, shown, s.search_candidates),
        "exact": lambda: exact(questions, postings(shown, only=asked_terms(questions, "identifiers")), s.search_candidates, shown),
        "trigram": lambda: trigram(questions, shown, s.search_candidates, s.trigram_threshold),
    }
    fused = fuse({p: make[p]() for p in use}, s.path_weights, s.rrf_k, s.search_candidates)
    columns = ["content", "section_path", "page_from", "page_to", "products", "title", "source_path", "kind", "document_id", "ordinal", "content_hash"]
    joined = fused.join(shown.select(F.col("id").alias("chunk_id"), *columns), "chunk_id")
    return dedupe(joined, F.coalesce(F.col("content_hash"), F.trim("content")))
