"""From ranked hits to checked answers, for batches and for one question."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.analyze import DEFAULT_GLOSSARY, Glossary, analyze, analyzed, beside_model, sparse_terms, trigram_text
from corvane.functions.embedding import Embedder, Generator, embedded
from corvane.operators import ranking, search
from corvane.settings import Settings

ANSWER_RULES = "Answer from the numbered passages only and cite them as [n]. Keep values as written. If they hold no answer, say exactly: " + T.NOT_FOUND
COMPARE_RULES = ANSWER_RULES + " Compare the products one by one and say which passage each value is from."
PLAIN_RULES = "Answer the question."


def context(hits: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, context, evidence, n): numbered blocks of the hits that fit."""
    block = T.context_block(F.col("content"), F.col("neighbours"))
    fit = search.within_budget(hits.withColumn("__block", block), F.length("__block") + 60, settings.context_chars)
    where = T.citation(F.col("title"), F.col("source_path"), F.col("page_from"), F.col("page_to"), F.col("section_path"))
    rows = fit.select("query_id", F.struct("rank", F.concat(F.lit("["), F.col("rank"), F.lit("] 출처: "), where, F.lit("\n"), F.col("__block")).alias("b"), F.col("__block").alias("e")).alias("x"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("query_id", F.array_join("x.b", "\n\n").alias("context"), F.col("x.e").alias("evidence"), F.size("x").alias("n"))


def sources(hits: DataFrame) -> DataFrame:
    """What an answer shows of each hit."""
    where = T.citation(F.col("title"), F.col("source_path"), F.col("page_from"), F.col("page_to"), F.col("section_path"))
    return hits.select("query_id", F.col("rank").alias("index"), where.alias("citation"), "section_path", "products", T.excerpt(F.col("content")).alias("excerpt"), "chunk_id", F.bround("score", 4).alias("score"), "paths")


def judged(answers: DataFrame, mode: str) -> DataFrame:
    """``answers`` (query_id, generated, evidence, n) with answer, cited,
    grounded, unsupported and answered.

    No hits, no or wrong citations, and the not-found sentence all give the
    not-found answer.  ``strict`` gives it for unsupported values as well,
    ``warn`` only marks them, ``off`` does not look."""
    cited = T.cited(F.col("generated"), F.col("n"))
    good = F.coalesce((F.col("n") > 0) & cited.isNotNull() & ~T.is_not_found(F.col("generated")), F.lit(False))
    shown = F.transform(F.col("__cited"), lambda i: F.element_at("evidence", i.cast("int")))
    rows = answers.withColumns({"__cited": cited, "answered": good})
    bad = T.unsupported(F.col("generated"), shown) if mode != "off" else F.array().cast("array<string>")
    rows = rows.withColumn("unsupported", F.when(F.col("answered"), bad).otherwise(F.array().cast("array<string>")))
    grounded = F.when(F.col("answered") & F.lit(mode != "off"), F.size("unsupported") == 0)
    rows = rows.withColumn("grounded", grounded)
    if mode == "strict":
        rows = rows.withColumn("answered", F.col("answered") & F.col("grounded"))
    return rows.withColumns({
        "answer": F.when(F.col("answered"), F.col("generated")).otherwise(F.lit(T.NOT_FOUND)),
        "cited": F.when(F.col("answered"), F.col("__cited")).otherwise(F.array().cast("array<long>")),
    }).drop("__cited")


def generated(provider: Generator, system: Column, prompt: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, p in batches:
            yield pd.Series([provider.generate(a, b) for a, b in zip(s, p, strict=True)], dtype=object)

    return run(system, prompt)


def prepared(questions: DataFrame, embedder: Embedder, filters: search.Filters, settings: Settings, glossary: Glossary) -> DataFrame:
    """``questions`` (query_id, question) analysed, with what each path looks
    for and ``limits``: the filters' products or, without any, those that the
    question names."""
    a = questions.select("query_id", "question", analyzed(F.col("question"), glossary, settings.query_expansion).alias("a"))
    limits = F.col("a.products") if filters.products is None else F.array(*map(F.lit, filters.products)).cast("array<string>")
    return a.select(
        "query_id", "question", "a.products", "a.intent", "a.terms", "a.identifiers", limits.alias("limits"),
        embedded(F.col("question"), embedder, settings.embed_batch_size, strict=False).alias("vector"),
        sparse_terms(F.col("a.terms"), F.col("a.products"), F.size(limits) > 0).alias("sparse_terms"),
        beside_model(F.col("a.identifiers"), F.col("a.products")).alias("exact_identifiers"),
        trigram_text(F.coalesce("question", F.lit("")), F.col("a.terms")).alias("trigram_text"),
    )


def candidates(asked: DataFrame, chunks: DataFrame, documents: DataFrame, filters: search.Filters, settings: Settings, paths=None, n: int = 30) -> DataFrame:
    """The ``n`` fused candidates of each ``prepared`` question.  One about
    several products is searched for each of them, so that none takes all
    places, and what is found takes turns."""
    many = F.size("limits") > 1
    each = F.transform("limits", lambda p, i: F.struct(i.cast("int").alias("no"), F.array(p).alias("only")))
    parts = F.when(many, each).otherwise(F.array(F.struct(F.lit(0).alias("no"), F.col("limits").alias("only"))))
    turns = asked.select("*", F.explode(parts).alias("part"))
    # A product's question has an id of its own, and how many of its hits count.
    share = F.when(many, F.greatest(F.lit(3), F.floor(F.lit(n) / F.size("limits")).cast("int") + 1)).otherwise(F.lit(n))
    turns = turns.select(F.struct("query_id", F.col("part.no").alias("no"), share.alias("share")).alias("query_id"), F.col("part.only").alias("only"), "vector", F.col("sparse_terms").alias("terms"), F.col("exact_identifiers").alias("identifiers"), "trigram_text")
    open_ = search.Filters(None, filters.groups, filters.document_ids)
    found = search.hybrid(turns, chunks, documents, open_, settings, paths).where(F.col("rank") <= F.col("query_id.share"))
    found = found.withColumn("__no", F.col("query_id.no")).withColumn("query_id", F.col("query_id.query_id"))
    once = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "__no")
    turn = Window.partitionBy("query_id").orderBy("rank", "__no")
    first = found.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return first.withColumn("__r", F.row_number().over(turn)).where(F.col("__r") <= n).withColumn("rank", F.col("__r")).drop("__r", "__no")


def retrieve(questions: DataFrame, chunks: DataFrame, documents: DataFrame, embedder: Embedder, filters: search.Filters | None = None, settings: Settings | None = None, glossary: Glossary = DEFAULT_GLOSSARY, paths=None, top_k: int | None = None, provider: Generator | None = None) -> DataFrame:
    """The ranked hits of each question (query_id, question).

    The products that a question names limit it, unless ``filters`` has
    products: an empty list lifts the limit.  Search widens to the rerank list,
    rules or, by setting, the ``provider`` rerank all of it, then the list is
    diversified to ``top_k``; table rows get their neighbours."""
    s, given = settings or Settings(), filters or search.Filters()
    k = top_k or s.search_top_k
    wide = max(k, s.rerank_candidates)
    asked = prepared(questions, embedder, given, s, glossary)
    found = candidates(asked, chunks, documents, given, s, paths, wide)
    ranked = ranking.reranker(s.rerank_provider, provider)(asked, found, wide)
    final = ranking.diversify(ranked, k, s.near_dup_similarity, s.section_cap)
    return search.neighbours(final, chunks, s.neighbor_window)


def answer_batch(questions: DataFrame, hits: DataFrame, provider: Generator, settings: Settings | None = None) -> DataFrame:
    """One judged answer for each question; those without hits are not found.
    Questions that compare are answered by rules of their own."""
    s = settings or Settings()
    rows = questions.join(context(hits, s), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prompt = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n"), F.col("question"))
    said = F.coalesce("question", F.lit(""))
    rules = F.when(T.intent(said, T.products_in(said)) == "comparison", COMPARE_RULES).otherwise(ANSWER_RULES)
    rows = rows.withColumn("generated", generated(provider, rules, prompt))
    return judged(rows.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))), s.grounding_mode)


def answer_plain(question: str, provider: Generator) -> dict:
    """Without retrieval: no sources, grounding unknown."""
    return {"answer": provider.generate(PLAIN_RULES, question), "sources": [], "grounded": None}


@dataclass
class Reply:
    answer: str
    answered: bool
    sources: list[dict] = field(default_factory=list)
    grounded: bool | None = None
    unsupported: list[str] = field(default_factory=list)
    warning: str = ""
    latency_ms: dict[str, float] = field(default_factory=dict)


def stream_answer(question: str, hits: list[dict], provider: Generator) -> Iterator[dict]:
    """Events of one answer: sources, tokens, then done.  An honest refusal has
    no warning, an answer without usable citations has one."""
    began = time.monotonic()
    if not hits:
        yield {"type": "done", "answer": T.NOT_FOUND, "sources": [], "grounded": None, "warning": ""}
        return
    yield {"type": "sources", "sources": hits}
    listed = "\n\n".join(f"[{i}] {h['content']}" for i, h in enumerate(hits, 1))
    rules = COMPARE_RULES if analyze(question).intent == "comparison" else ANSWER_RULES
    said = provider.generate(rules, f"{listed}\n\n{question}")
    for part in re.findall(r"\S+\s*", said):
        yield {"type": "token", "text": part}
    cited = {int(n) for n in re.findall(T.CITATION, said)}
    refused = T.NOT_FOUND.rstrip(".") in said
    good = bool(cited) and cited <= set(range(1, len(hits) + 1)) and not refused
    yield {
        "type": "done", "answer": said if good else T.NOT_FOUND, "sources": [h for i, h in enumerate(hits, 1) if i in cited] if good else [], "grounded": None,
        "warning": "" if good or refused else "the answer had no valid citation", "ms": (time.monotonic() - began) * 1000,
    }
