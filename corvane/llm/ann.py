"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword from each
of several residual codebooks.  Codebooks are fitted on a bounded sample, one
after another on what the ones before leave; vectors are encoded by beam
search over all codebooks, and the squared norm of the approximation is kept.
With it the distance to a query is, up to the query's own norm, the stored norm
minus twice a sum of looked-up inner products.  The best by that estimate, with
all that tie with the last of them, are reranked with the original vectors in
double precision; so is all that, for what its approximation is wrong by, may
be nearer than what they gave.  Copies of a vector have one code.  So large
groups of copies are ranked exactly, and of near copies as many are reranked as
their codes do not tell apart.

Queries and candidates are packed into blocks of bounded size; every query
block meets every candidate block once, and only the best few of each meeting
go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import small_batches, stage

CODEBOOKS, CODEWORDS, BEAM = 16, 256, 4
#: Vectors the codebooks are fitted on: those with the least hash of vec_id.
SAMPLE = 8192
ROUNDS = 5
#: Vectors of a candidate block and of a query block.
BLOCK, QUERY_BLOCK = 8192, 512
#: Per query and candidate block, as many go to exact reranking, besides ties and what codes cannot tell apart.
RERANK = 200
#: Standard deviations of a random cosine that an approximation's error may have with the way to a query.
CHANCE = 4.0
TOP = 10


def valid(embedding: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite
    component, not all zeros."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, seed: int = 3) -> np.ndarray:
    """(codebooks, codewords, dim): k-means on what the codebooks before leave,
    then each codebook once more on what all the others leave."""
    rng, rest = np.random.default_rng(seed), x.astype(np.float32).copy()
    k = max(1, min(codewords, len(x)))
    books, codes = np.zeros((codebooks, k, x.shape[1]), np.float32), np.zeros((codebooks, len(x)), np.intp)

    def assign(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1) - 2 * r @ c.T).argmin(1)

    def centre(r: np.ndarray, at: np.ndarray, old: np.ndarray) -> np.ndarray:
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(old)
        np.add.at(sums, at, r)
        return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old)

    for m in range(codebooks):
        books[m] = rest[rng.permutation(len(rest))[:k]] if m == 0 else np.concatenate([np.zeros((1, x.shape[1]), np.float32), rest[rng.permutation(len(rest))[: k - 1]]])
        for _ in range(ROUNDS):
            codes[m] = assign(rest, books[m])
            books[m] = centre(rest, codes[m], books[m])
        codes[m] = assign(rest, books[m])
        rest -= books[m][codes[m]]
    for m in range(codebooks):
        rest += books[m][codes[m]]
        books[m] = centre(rest, codes[m], books[m])
        codes[m] = assign(rest, books[m])
        rest -= books[m][codes[m]]
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes as uint8, squared norms of the approximations), by beam search."""
    x = x.astype(np.float32)
    n, k = len(x), books.shape[1]
    norms = (books * books).sum(2)
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for m in range(len(books)):
        b = rest.shape[1]
        # |r - c|^2 for every kept partial code and every codeword
        loss = (rest * rest).sum(2)[:, :, None] + norms[m] - 2 * rest @ books[m].T
        best = np.argpartition(loss.reshape(n, -1), min(beam, b * k) - 1, 1)[:, :beam]
        at, word = best // k, best % k
        rest = np.take_along_axis(rest, at[:, :, None], 1) - books[m][word]
        codes = np.concatenate([np.take_along_axis(codes, at[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    best = (rest * rest).sum(2).argmin(1)
    approx = x - np.take_along_axis(rest, best[:, None, None], 1)[:, 0]
    return np.take_along_axis(codes, best[:, None, None], 1)[:, 0], (approx * approx).sum(1)


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, scale: float, rerank: int, top: int) -> Iterator[tuple[int, int, float]]:
    """(query, vec_id, distance): each query's ``top`` best of one block.

    Codes, norms and codebooks are of vectors divided by ``scale``, in single
    precision; distances are of the vectors as they are, in double precision.
    """
    tables = np.einsum("qd,mkd->qmk", (q / scale).astype(np.float32), books)
    wrong = np.sqrt(((x / scale - sum(books[m][codes[:, m]] for m in range(len(books)))) ** 2).sum(1))
    measure = lambda at, one: np.sqrt(((x[at] - one) ** 2).sum(1))
    for i in range(len(q)):
        estimate = norms - 2 * tables[i][np.arange(len(books))[:, None], codes.T].sum(0)
        estimate[ids == q_ids[i]] = np.inf
        n = min(rerank, len(ids))
        # All that tie with the last are in: which of them come first is for the exact distance and vec_id to say.
        chosen = (estimate <= np.partition(estimate, n - 1)[n - 1]) & (ids != q_ids[i])
        at = np.flatnonzero(chosen)
        d = measure(at, q[i])
        if len(d) >= top:
            far, own = np.partition(d, top - 1)[top - 1] / scale, ((q[i] / scale) ** 2).sum()
            # What may still be nearer, with a margin for single precision: among vectors as near as their
            # approximations are wrong by the triangle inequality, else for cosines of the two within CHANCE.
            cosine = np.where(1.5 * wrong >= far, 1.0, min(1.0, CHANCE / np.sqrt(x.shape[1])))
            square = np.maximum(np.where(np.isfinite(estimate), estimate + own, 0), 0)
            slack = 1e-5 * (own + norms) + 1e-30
            may = square + wrong**2 - 2 * cosine * wrong * np.sqrt(square) <= far**2 + slack
            may |= (cosine == 1) & (square <= (far + wrong) ** 2 + slack)
            more = np.flatnonzero(may & ~chosen & (ids != q_ids[i]))
            at, d = np.concatenate([at, more]), np.concatenate([d, measure(more, q[i])])
        for j in np.lexsort((ids[at], d))[:top]:
            yield int(q_ids[i]), int(ids[at[j]]), float(d[j])


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def build_index(vectors: DataFrame, books: np.ndarray, scale: float, n_blocks: int) -> DataFrame:
    """(block, ids, x, codes, norms): all vectors, encoded, in blocks by hash of
    vec_id; the packed columns are little-endian arrays, x of doubles."""
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def pack(key, frame):
        frame = frame.sort_values("vec_id", kind="stable")
        x = stacked(frame["embedding"])
        # Copies are encoded once, so that their estimates are the same to the last bit.
        one, of = np.unique((x / scale).astype(np.float32), axis=0, return_inverse=True)
        codes, norms = zip(*(encode(one[i : i + 1024], held.value) for i in range(0, len(one), 1024)), strict=True)
        codes, norms = np.concatenate(codes)[of.ravel()], np.concatenate(norms)[of.ravel()]
        return pd.DataFrame([[key[0], frame["vec_id"].to_numpy("<i8").tobytes(), x.astype("<f8").tobytes(), codes.tobytes(), norms.astype("<f4").tobytes()]], columns=["block", "ids", "x", "codes", "norms"])

    rows = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    return rows.groupBy("block").applyInPandas(pack, "block int, ids binary, x binary, codes binary, norms binary")


def least_hashed(rows: DataFrame, n: int, sample: int) -> pd.DataFrame:
    """Of ``n`` rows the ``sample`` with the least hash of vec_id, all if fewer.
    Tasks only send rows below a hash that somewhat more than ``sample`` are
    expected to have, so what the driver gets does not grow with rows or tasks."""
    asked = 1.2 * sample + 10 * np.sqrt(sample)
    while True:
        below = rows.select("embedding", "vec_id", F.xxhash64("vec_id").alias("hash"))
        if asked < n:
            below = below.where(F.col("hash") < F.lit(int(asked / n * 2**64) - 2**63))
        got = below.toPandas()
        if len(got) >= min(sample, n) or asked >= n:
            return got.sort_values(["hash", "vec_id"]).head(sample)
        asked *= 2


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, rerank: int = RERANK, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found to each query by
    Euclidean distance, ties to the smaller vec_id; all candidates if fewer.

    Both tables have vec_id and embedding, of floats or doubles, which are
    measured as they are.  A query's own vec_id is no candidate.  Null ids and
    vectors that are not ``valid``, or not as long as most, take no part.  Of
    rows that repeat a vec_id the one with the least vector counts.  Empty
    tables give no rows.  Other columns are left out.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    clean = lambda df: df.select(*columns).where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = stage(clean(vectors), "ann-vectors")
    largest = F.max(F.array_max(F.transform("embedding", F.abs)))
    shape = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("count"), largest.alias("scale")).orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = shape.dim, shape["count"]
    asked = clean(queries).where(F.size("embedding") == dim)
    sought = asked.agg(F.count(F.lit(1)).alias("n"), largest.alias("scale")).first()
    scale, n_query_blocks = float(max(shape.scale, sought.scale or 0)), max(1, -(-sought.n // query_block))
    rows = rows.where(F.size("embedding") == dim)
    picked = least_hashed(rows, n, sample)
    books = fit(stacked(picked["embedding"]) / scale)
    n_blocks = -(-n // block)
    index = stage(build_index(rows, books, scale, n_blocks), "ann-index")

    def pack(key, frame):
        return pd.DataFrame([[frame["vec_id"].to_numpy("<i8").tobytes(), stacked(frame["embedding"]).astype("<f8").tobytes()]], columns=["q_ids", "q"])

    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).alias("qb")).applyInPandas(pack, "q_ids binary, q binary")
    sent = blocks.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    held = spark.sparkContext.broadcast(books)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.frombuffer(r.ids, "<i8")
                found = nearest(
                    np.frombuffer(r.q, "<f8").reshape(-1, dim), np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.x, "<f8").reshape(-1, dim), ids,
                    np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1), np.frombuffer(r.norms, "<f4"), held.value, scale, rerank, top,
                )
                yield pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"])

    # Neither side is sent through the driver, whatever Spark takes their sizes to be.
    met = sent.join(index.hint("merge"), F.col("__block") == F.col("block"))
    best = met.select("q_ids", "q", "ids", "x", "codes", "norms").mapInPandas(meet, "query_id long, vec_id long, score double")
    # The limit by rank is also applied before the shuffle, to each task's rows.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every hundredth row of ``embeddings``; see ``search``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
