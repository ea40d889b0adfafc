"""Reranking by rules, listwise reranking by a model, and diversification."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

# ---- Fixed values: feature weights. ----
WEIGHTS = {"ident": 3.0, "product": 1.5, "terms": 1.5, "key": 1.6, "section": 1.0, "kind": 0.8, "agree": 0.6, "retrieval": 2.0}
# ---- End of fixed values. ----

ORDER_RULES = "Order the numbered excerpts by how well they answer the question: direct answers first, other products last, asked values before texts without them. Reply with all numbers, each once, separated by commas, and nothing else."


def discriminating(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, idents, terms): lower-cased and only those that occur in any
    of the query's candidates, or all where none does; terms without idents."""
    low = questions.select("query_id", F.transform("identifiers", F.lower).alias("i"), F.transform("terms", F.lower).alias("t"))
    low = low.withColumn("t", F.filter("t", lambda x: ~F.array_contains("i", x)))
    asked = low.select("query_id", F.posexplode(F.array_distinct(F.concat("i", "t"))).alias("no", "w"))
    found = hits.select("query_id", F.lower("content").alias("c")).join(asked, "query_id").where(F.contains("c", "w")).select("query_id", "w").distinct()
    seen = found.groupBy("query_id").agg(F.collect_set("w").alias("seen"))
    joined = low.join(seen, "query_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    keep = lambda c: F.filter(c, lambda x: F.array_contains("seen", x))
    return joined.select("query_id", F.when(F.size(keep("i")) > 0, keep("i")).otherwise(F.col("i")).alias("idents"), F.when(F.size(keep("t")) > 0, keep("t")).otherwise(F.col("t")).alias("terms"))


def _cover(words: Column, text: Column) -> Column:
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words)).otherwise(0.0)


def features(wanted: Column, intent: Column, idents: Column, terms: Column) -> dict[str, Column]:
    content, keys = F.lower("content"), T.key_text(F.col("content"))
    overlap = F.size(F.array_intersect("products", wanted)) > 0
    only = F.size(F.array_except("products", wanted)) == 0
    return {
        "ident": _cover(idents, content),
        "product": F.when(overlap & only, 1.0).when(overlap, 0.6).otherwise(0.0),
        "terms": _cover(terms, content),
        "key": F.when(keys != "", _cover(terms, keys)).otherwise(0.0),
        "section": _cover(terms, F.lower(F.coalesce("section_path", F.lit("")))),
        "kind": F.when((intent == "spec") & (F.col("kind") == "table_row"), 1.0).when((intent == "procedure") & (F.col("kind") == "prose"), 1.0).when((intent == "spec") & F.col("content").rlike(r"\d"), 0.4).otherwise(0.0),
        "agree": F.least(F.size("paths"), F.lit(3)) / F.lit(3.0),
    }


def rules(questions: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
    """``hits`` reranked by weighted features; ties keep the rank they came with.
    A query whose best retrieval score is 0 counts it as 1."""
    telling = discriminating(questions, hits)
    asked = questions.select("query_id", F.col("products").alias("__wanted"), F.col("intent").alias("__intent")).join(telling.withColumnsRenamed({"idents": "__idents", "terms": "__terms"}), "query_id")
    joined = hits.join(asked, "query_id")
    best = F.max("score").over(Window.partitionBy("query_id"))
    total = F.lit(WEIGHTS["retrieval"]) * F.col("score") / F.when(best == 0, 1.0).otherwise(best)
    for name, value in features(F.col("__wanted"), F.col("__intent"), F.col("__idents"), F.col("__terms")).items():
        total = total + F.lit(WEIGHTS[name]) * value
    ranked = joined.withColumn("score", F.round(total, 9)).withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))
    return ranked.where(F.col("__r") <= top_k).withColumn("rank", F.col("__r")).drop("__r", "__wanted", "__intent", "__idents", "__terms")


def parse_order(reply: str, n: int) -> list[int]:
    """Places from 0 in the order a model's reply names them, each once, the
    others after; the old order if it names none."""
    named = list(dict.fromkeys(i - 1 for i in map(int, re.findall(r"\d+", reply or "")) if 1 <= i <= n))
    return named + [i for i in range(n) if i not in named]


def listwise(hits: DataFrame, question: str, generate: Callable[[str], str], top_k: int) -> DataFrame:
    """Reranked by a model that sees 300 characters of each of a query's few
    candidates; any failure keeps the order.  ``question`` names a column."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        try:
            listed = "\n".join(f"[{i}] {c[:300]}" for i, c in enumerate(frame["content"], 1))
            order = parse_order(generate(f"{frame[question].iloc[0]}\n\n{listed}"), len(frame))
        except Exception:
            order = list(range(len(frame)))
        frame = frame.iloc[order[:top_k]].copy()
        frame["rank"] = range(1, len(frame) + 1)
        return frame

    return hits.groupBy("query_id").applyInPandas(run, hits.schema)


def reranker(name: str, provider=None) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """By name; ``llm`` asks ``provider``, a Generator."""
    if name in ("none", "off", ""):
        return lambda questions, hits, top_k: hits.where(F.col("rank") <= top_k)
    if name == "rules":
        return rules
    if name == "llm" and provider is not None:

        def by_model(questions: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
            asked = hits.join(questions.select("query_id", F.col("question").alias("__question")), "query_id")
            return listwise(asked, "__question", lambda prompt: provider.generate(ORDER_RULES, prompt), top_k).drop("__question")

        return by_model
    raise ValueError(f"unknown reranker {name!r}")


def body_tokens(content: str) -> frozenset[str]:
    """The words of a hit without its first line, if there are more lines."""
    lines = content.splitlines()
    return frozenset(re.findall(T.WORDS, "\n".join(lines[1:] if len(lines) > 1 else lines).lower()))


def pick_diverse(rows: list[tuple], top_k: int, threshold: float, cap: int) -> list[int]:
    """Places of the picked rows (document, section, tokens), in order.

    In rank order a row is put off if its section has its share already or it
    is too close to one picked before; what is put off fills up in order.
    """
    if len(rows) <= 1 or (threshold >= 1 and cap <= 0):
        return list(range(min(top_k, len(rows))))
    picked, later, share = [], [], {}
    for i, (document, section, words) in enumerate(rows):
        close = threshold < 1 and any((u := len(words | rows[j][2])) and len(words & rows[j][2]) / u >= threshold for j in picked)
        if len(picked) >= top_k or (cap > 0 and share.get((document, section), 0) >= cap) or close:
            later.append(i)
            continue
        picked.append(i)
        share[document, section] = share.get((document, section), 0) + 1
    return (picked + later)[:top_k]


def diversify(hits: DataFrame, top_k: int, threshold: float = 0.9, cap: int = 3) -> DataFrame:
    """Greedy per query over its few candidates (a rerank list of at most some
    dozens), ranked anew."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        rows = [(d, s, body_tokens(c)) for d, s, c in zip(frame["document_id"], frame["section_path"], frame["content"], strict=True)]
        frame = frame.iloc[pick_diverse(rows, top_k, threshold, cap)].copy()
        frame["rank"] = range(1, len(frame) + 1)
        return frame

    return hits.groupBy("query_id").applyInPandas(run, hits.schema)


def cap_sections(hits: DataFrame, top_k: int, cap: int = 3) -> DataFrame:
    """Diversification by the section cap alone, in window functions."""
    own = Window.partitionBy("query_id", "document_id", "section_path").orderBy("rank")
    late = (F.row_number().over(own) > cap).cast("int")
    order = Window.partitionBy("query_id").orderBy("__late", "rank")
    return hits.withColumn("__late", late).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top_k).withColumn("rank", F.col("__r")).drop("__late", "__r")
