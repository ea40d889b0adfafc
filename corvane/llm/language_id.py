"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary n-gram classifier per bit learns
which half of the languages a text belongs to.  A text is decoded to the
codeword with the least loss, where each bit's loss is weighted by how well
its classifier did in training (loss-weighted decoding); a small margin
between the best and the second codeword flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import drop_stage, fold_of, kept_by_worker, small_batches, stage

#: Different labelled texts of a language that the model is fitted on at most
#: (the least by hash of the text), and of all languages together, if each has
#: one.  Prediction reads whole texts; fitting does too.
PER_LANGUAGE, ALL_LANGUAGES = 400, 16_384
RIDGE = 0.05
LOG_BUCKETS = 12
BUCKETS = 1 << LOG_BUCKETS
LETTER = regex.compile(r"\p{L}")
AMBIGUOUS = 0.6


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1 with large distances: all non-trivial splits for
    few languages, else random splits with one codeword apart from any other."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        rows = [[1 if i == 0 else (1 if (s >> (i - 1)) & 1 else -1) for s in range(2 ** (n - 1) - 1)] for i in range(n)]
        return np.array(rows, float)
    rng, bits = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(n))))
    apart = lambda m: (bits - m @ m.T + 2 * bits * np.eye(n)).min()  # noqa: E731  twice the least Hamming distance
    return max((rng.choice([-1.0, 1.0], (n, bits)) for _ in range(100)), key=apart)


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte 1-, 2-, 3- and 4-grams in hashed
    buckets, of the whole lower-cased text, with runs of other characters than
    letters as one space.  Long texts are counted in pieces: memory is bounded."""
    raw = (text or "").lower().encode("utf-8", "replace")
    counts = np.zeros(BUCKETS)
    for at in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[max(0, at - 3) : at + (1 << 20)], np.uint8)
        b = _FOLD[b]
        b = b[(b != 32) | np.concatenate([[True], b[:-1] != 32])].astype(np.uint32)
        g = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            g = g[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
            key = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            counts += np.bincount(key >> np.uint32(32 - LOG_BUCKETS), minlength=BUCKETS)
        counts += np.bincount(b, minlength=BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def ridge(x: np.ndarray, t: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The weights of ridge regression of ``t`` on the rows of ``x`` less
    ``mean``: solved over rows or over columns, whichever are fewer, so the
    system has at most as many equations as there are buckets."""
    if len(x) <= x.shape[1]:
        z = x - mean
        return z.T @ np.linalg.solve(z @ z.T + RIDGE * np.eye(len(z)), t) if len(z) else np.zeros((x.shape[1], t.shape[1]))
    gram, right = RIDGE * np.eye(x.shape[1]), np.zeros((x.shape[1], t.shape[1]))
    for at in range(0, len(x), 1024):
        z = x[at : at + 1024] - mean
        gram += z.T @ z
        right += z.T @ t[at : at + 1024]
    return np.linalg.solve(gram, right)


class Model:
    """Linear bit classifiers, their weights in decoding and the codewords."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages, self.codes = languages, code_matrix(len(languages))
        t = self.codes[y] if len(x) else np.zeros((0, self.codes.shape[1]))
        self.mean = x.mean(0, dtype=float) if len(x) else np.zeros(BUCKETS)
        self.b = t.mean(0) if len(x) else np.zeros(self.codes.shape[1])
        self.w = ridge(x, t - self.b, self.mean).astype(np.float32)
        wrong = np.zeros(len(self.b))
        for at in range(0, len(x), 1024):
            wrong += (np.sign((x[at : at + 1024] - self.mean) @ self.w + self.b) != t[at : at + 1024]).sum(0)
        err = (wrong + 1) / (len(t) + 2)
        self.weight = np.maximum(np.log((1 - err) / err), 1e-3)
        self.weight /= self.weight.sum()

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, whether it is ambiguous)."""
        bits = (x - self.mean) @ self.w + self.b
        loss = (np.log1p(np.exp(-4.0 * self.codes * bits)) * self.weight).sum(1)
        p = np.exp(-8.0 * (loss - loss.min()))
        best = int(np.argmin(loss))
        score = float(p[best] / p.sum())
        return self.languages[best], score, score < AMBIGUOUS


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, all_languages: int = ALL_LANGUAGES) -> Model:
    """Fit on at most ``per_language`` different texts of each language, the
    least by hash of the text, fewer if there are so many languages that they
    would be over ``all_languages``, but one of each at least.

    Every language with a text that is not null is learned, however often its
    texts repeat.  The sample is found by partial aggregation, so no language's
    rows meet in one task, and it does not depend on the order of rows; ids
    play no part.  Null texts and languages are left out, empty and very long
    texts are texts like others; other columns are not read.  The language
    names, few by nature, come to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull()).withColumn("h", F.xxhash64("t"))
    # How many different texts a language has, within a few per cent; a share by hash then keeps well over what is wanted, and all of small languages.
    total = stage(known.groupBy("l").agg(F.approx_count_distinct("h", 0.03).alias("n")), "language-texts")
    most = max(1, min(per_language, all_languages // max(1, total.count())))
    cut = total.select(F.col("l").alias("name"), F.least(F.lit(1.0), F.lit(2.0 * most + 100) / F.col("n")).alias("share"))
    part = known.join(F.broadcast(cut), F.col("l") == F.col("name")).where((F.col("share") >= 1) | (F.pmod("h", F.lit(1_000_000_007)) < F.col("share") * 1_000_000_007))
    by_hash = Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1_000_000_007)), "h")
    least = part.groupBy("l", "h").agg(F.first("t").alias("t")).withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= most)

    def vectors(batches):
        for b in batches:
            yield pd.DataFrame({"l": b["l"], "rank": b["rank"], "x": [features(t).astype(np.float32).tobytes() for t in b["t"]]})

    rows = stage(least.select("l", "rank", "t").mapInPandas(vectors, "l string, rank int, x binary"), "language-sample")
    names = sorted(r.l for r in total.select("l").collect())
    number = {n: i for i, n in enumerate(names)}
    x, y = np.zeros((rows.count(), BUCKETS), np.float32), []
    for r in rows.orderBy("l", "rank").toLocalIterator():
        x[len(y)] = np.frombuffer(r.x, np.float32)
        y.append(number[r.l])
    drop_stage(spark, rows)
    drop_stage(spark, total)
    return Model(names, x, np.array(y, int))


def predict(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column for ``docs``: struct of ``lang``, ``score`` and ``ambiguous``.

    Null texts, texts without a letter, and all texts if nothing was learned,
    are ``und`` with score 0.  Of languages that a text is equally near to the
    first by name is told.  Very long texts are counted whole, in pieces.  Each
    row is told by its text alone: rows that repeat have equal answers, an
    empty table has none, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept_by_worker("language", dict)  # frees what other operators left
        m = held.value
        for batch in batches:
            out = [m.decode(features(t)) if m.languages and t is not None and LETTER.search(t) else ("und", 0.0, True) for t in batch]
            yield pd.DataFrame(out, columns=["lang", "score", "ambiguous"])

    return tell(F.col(text))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``, learned from those whose
    fold is not 0; see ``train`` and ``predict``.  A null id counts as held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = fold_of(F.col("doc_id"), 5)
    model = train(docs.where(fold != 0))
    told = docs.select("doc_id", predict(model, docs).alias("told"))
    held_out = F.coalesce(fold == 0, F.lit(True))
    return told.select("doc_id", held_out.alias("held_out"), F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"), F.col("told.ambiguous").alias("ambiguous"))
