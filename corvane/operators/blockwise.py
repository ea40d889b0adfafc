"""Dense, sparse and trigram scores of chunks against a batch of questions, block by
block: matrix products, or an index of the questions' trigrams, over Arrow
batches instead of rows for every pair.

The questions' side is sent to all tasks, so it is measured first; a batch that
is too large for that has no ``Asked``, and the callers in ``search`` take the
joins.  Each task only gives a question's chunks that may be among its best.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from corvane.functions.text import WORDS
from corvane.functions.trigrams import among, trigram_set

#: Bytes of the questions' side that are sent, and elements of a block's scores.
SENT_BYTES, ELEMENTS = 32 << 20, 4 << 20
#: Scores are rounded to nine digits later, so this much below the last of the best may tie with it.
CLOSE = 2e-9


@dataclass(frozen=True)
class Asked:
    """The questions of a batch: ids by number, and what each is limited to."""

    ids: list
    only: list
    kind: DataType


def numbered(questions: DataFrame, value: str, size: int, many: Callable = F.size) -> tuple[Asked, list] | None:
    """The batch with the column ``value``, or None if it takes more than
    SENT_BYTES; ``size`` is about what an element of the value takes, of which
    there are ``many``."""
    rows = questions.select("query_id", F.col(value).alias("v"), (F.col("only") if "only" in questions.columns else F.lit(None).cast("array<string>")).alias("only")).where(many(value) > 0)
    measured = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(many("v").cast("long")).alias("v")).first()
    if 200 * measured.n + size * (measured.v or 0) > SENT_BYTES:
        return None
    got = rows.collect()
    return Asked([r.query_id for r in got], [frozenset(r.only or ()) for r in got], rows.schema["query_id"].dataType), [r.v for r in got]


class Best:
    """What may be among the ``n`` best of each question, block after block."""

    def __init__(self, questions: int, n: int):
        self.n, self.floor = n, np.full(questions, -np.inf)

    def of(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, question) of a block's scores, rows by questions, -inf where none."""
        if len(scores) >= self.n:
            self.floor = np.maximum(self.floor, np.partition(scores, len(scores) - self.n, 0)[len(scores) - self.n])
        return np.nonzero((scores >= self.floor - CLOSE) & (scores > -np.inf))


def allowed(only: list, products: pd.Series | None) -> np.ndarray | None:
    """Rows by questions: whether a chunk has a product its question is limited to."""
    if products is None or not any(only):
        return None
    own = [frozenset(p if p is not None else ()) for p in products]
    columns = {limit: np.array([bool(limit & p) for p in own]) for limit in set(only) if limit}
    return np.stack([columns.get(limit, np.ones(len(own), bool)) for limit in only], 1)


def _scored(chunks: DataFrame, asked: Asked, column: str, n: int, block) -> DataFrame:
    """(query_id, chunk_id, score), where ``block`` turns a column of chunks
    into scores for some of its rows, (begin, scores) at a time."""
    spark, kind = chunks.sparkSession, chunks.schema["id"].dataType.simpleString()
    limited = any(asked.only) and "products" in chunks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(asked.ids), n)
        for batch in batches:
            for begin, scores in block(batch["x"]):
                may = allowed(asked.only, batch["products"].iloc[begin : begin + len(scores)]) if limited else None
                row, q = best.of(scores if may is None else np.where(may, scores, -np.inf))
                yield pd.DataFrame({"q": q.astype(np.int32), "chunk_id": batch["id"].to_numpy()[begin + row], "score": scores[row, q]})

    rows = chunks.select("id", F.col(column).alias("x"), *(["products"] if limited else [])).where(F.col("x").isNotNull())
    found = rows.mapInPandas(run, f"q int, chunk_id {kind}, score double")
    names = spark.createDataFrame(list(enumerate(asked.ids)), StructType([StructField("q", IntegerType()), StructField("query_id", asked.kind)]))
    return found.join(F.broadcast(names), "q").select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def cosines(asked: Asked, vectors: list, chunks: DataFrame, n: int) -> DataFrame | None:
    """Cosines of chunks' ``embedding``; none of a zero vector, or of another
    length than the question's."""
    dims = np.array([len(v) for v in vectors])
    by_dim = {}
    for d in set(dims.tolist()):
        at = np.flatnonzero(dims == d)
        q = np.array([vectors[i] for i in at], float)
        norm = np.sqrt((q * q).sum(1))
        by_dim[d] = (at[norm > 0], q[norm > 0].T, norm[norm > 0])
    step = max(1, ELEMENTS // max(1, len(dims)))

    def block(column: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
        for begin in range(0, len(column), step):
            rows = column.iloc[begin : begin + step].tolist()
            size = np.array([len(v) for v in rows])
            scores = np.full((len(rows), len(dims)), -np.inf)
            for d, (at, q, qn) in by_dim.items():
                own = np.flatnonzero(size == d)
                if len(own) and len(at):
                    x = np.array([rows[i] for i in own], float)
                    norm = np.sqrt((x * x).sum(1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        c = (x @ q) / (norm[:, None] * qn)
                    scores[np.ix_(own, at)] = np.where(norm[:, None] > 0, c, -np.inf)
            yield begin, scores

    return _scored(chunks, asked, "embedding", n, block)


def occurrences(asked: Asked, terms: list, chunks: DataFrame, n: int) -> DataFrame | None:
    """0.1 for every occurrence of a question's terms in a chunk's ``content``
    over 1 + ln of its words; None if the matrix of terms by questions is too
    large."""
    word = re.compile(WORDS)
    own = [sorted({w for t in ts if t for w in word.findall(t.lower())}) for ts in terms]
    vocab = {w: i for i, w in enumerate(sorted({w for ts in own for w in ts}))}
    if len(vocab) * len(own) > ELEMENTS:
        return None
    wanted = np.zeros((len(vocab), len(own)))
    for q, ts in enumerate(own):
        wanted[[vocab[w] for w in ts], q] = 1
    step = max(1, ELEMENTS // max(1, len(own), len(vocab)))

    def block(column: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
        for begin in range(0, len(column), step):
            texts = column.iloc[begin : begin + step].tolist()
            counts, length = np.zeros((len(texts), len(vocab))), np.ones(len(texts))
            for i, t in enumerate(texts):
                found = word.findall(t.lower())
                hits = [vocab[w] for w in found if w in vocab]
                if hits:
                    counts[i] = np.bincount(hits, minlength=len(vocab))
                    length[i] = len(found)
            tf = counts @ wanted
            yield begin, np.where(tf > 0, 0.1 * tf / (1 + np.log(length))[:, None], -np.inf)

    return _scored(chunks, asked, "content", n, block)


def similarities(asked: Asked, texts: list, chunks: DataFrame, n: int, threshold: float) -> DataFrame:
    """Word similarities of texts to chunks' ``content`` that may reach the
    threshold, once they are rounded."""
    step, held = max(1, ELEMENTS // max(1, len(texts))), []

    def block(column: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
        if not held:  # once a task
            held.append(among([trigram_set(t) for t in texts], threshold))
        similar = held[0]
        for begin in range(0, len(column), step):
            rows = column.iloc[begin : begin + step].tolist()
            scores = np.full((len(rows), len(texts)), -np.inf)
            for i, t in enumerate(rows):
                for q, s in similar(t):
                    if s >= threshold - CLOSE:
                        scores[i, q] = s
            yield begin, scores

    return _scored(chunks, asked, "content", n, block)
