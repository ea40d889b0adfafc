r"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ten consecutive words.  A document contains
a window only if it contains each of the window's shingles of five words, so
the rarest one is the whole prefix that has to be joined (containment of 1
needs a prefix of one).  Shingles are ordered by how many different texts hold
them, counted over all documents by a grouped aggregation.  A joined shingle
fixes where the window would start; the window must then fit in the document
(length bound) at that place (positional bound), and its words are compared
exactly with those that stand there.

The texts are read once: of their shingles those go on that a Bloom filter of
the benchmark's lets pass, which has a fixed greatest size, so the benchmark
may be of any size.  What passes in error finds no partner in the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import Staged, kept_by_worker, mix, small_batches, stage, words

WINDOW, SHINGLE = 10, 5
#: Bits of the Bloom filter for a shingle, and at most: 16 MB are broadcast.
BITS_PER_SHINGLE, MOST_BITS = 24, 1 << 27
PROBES = 3
#: Contaminated texts up to so many bytes of keys are broadcast.
BROADCAST_BYTES = 64 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)


def windows_of(found: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """An item's windows: one of all words if it has fewer than ``size``."""
    if len(found) <= size:
        return [tuple(found)] if found else []
    return [tuple(found[i : i + size]) for i in range(len(found) - size + 1)]


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Of every ``size`` consecutive words with hashes ``h``, in order."""
    if len(h) < size:
        return h[:0]
    s = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        s = mix(s * _SEED + h[k : len(h) - size + 1 + k])
    return s


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for a null text."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def item_windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, window, size, shingles): every window of every item once, its
    words as one string, and its shingles' hashes in order."""

    def cut(batches):
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"], strict=True):
                for w in dict.fromkeys(windows_of(words(t), size)):
                    rows.append((i, b" ".join(w).decode(), len(w), shingle_hashes(word_hashes(list(w)), min(SHINGLE, len(w))).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item", "window", "size", "shingles"])

    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    return rows.mapInPandas(cut, "item string, window string, size int, shingles array<long>")


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n): the places of each hash in a filter of a power of two bits."""
    return np.stack([mix(hashes + np.uint64(k + 1)) & np.uint64(bits - 1) for k in range(PROBES)])


def shingle_filter(shingles: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of the column ``h``, as bytes, for about ``n`` hashes:
    every task makes words of 64 bits, which are joined by a grouped ``or``."""
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, n) * BITS_PER_SHINGLE)), 10, np.log2(MOST_BITS)))

    def place(batches):
        for b in batches:
            at = bits_of(b["h"].to_numpy(np.int64).view(np.uint64), bits).ravel()
            yield pd.DataFrame({"w": (at >> np.uint64(6)).astype(np.int64), "m": np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)})

    made = shingles.select("h").mapInPandas(place, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(bits >> 6, np.uint64)
    for r in made.toLocalIterator():
        out[r.w] = np.int64(r.m).view(np.uint64)
    return out


def occurrences(docs: DataFrame, text: str, sizes: list[int], held: np.ndarray, window: int) -> DataFrame:
    """(a, b, n, at, h, since, near): where a text (with key a, b and n words)
    has a shingle that the filter ``held`` lets pass, and the words around it
    that a window could take up, from the word ``since`` on."""
    sent, bits = docs.sparkSession.sparkContext.broadcast(held), len(held) << 6

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker("decontamination", dict)  # frees what other operators left
        own = sent.value
        for batch in batches:
            rows = []
            for a, b, t in zip(batch["a"], batch["b"], batch["t"], strict=True):
                found = words(t)
                every = word_hashes(found)
                for size in sizes:
                    h = shingle_hashes(every, size)
                    at = np.arange(len(h), dtype=np.intp)
                    for k in range(PROBES):
                        place = mix(h[at] + np.uint64(k + 1)) & np.uint64(bits - 1)
                        at = at[(own[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0]
                    for p in at.tolist():
                        since = max(0, p + size - window)
                        rows.append((a, b, len(found), p, int(h[p : p + 1].view(np.int64)[0]), since, b" ".join(found[since : p + window]).decode()))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=["a", "b", "n", "at", "h", "since", "near"])
                            rows = []
            yield pd.DataFrame(rows, columns=["a", "b", "n", "at", "h", "since", "near"])

    rows = docs.select(text_key(F.col(f"`{text}`")).alias("id"), F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull()).select("id.a", "id.b", "t")
    return rows.mapInPandas(look, "a long, b long, n int, at int, h long, since int, near string")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, n_hit, items, spans) of every different text with an occurring
    window: its ``text_key``, its hit words, the items (ids as strings, sorted
    as such, null ids left out) and the start and end of each run of hit words.

    Null and empty texts have no words and no hits; so has every text if the
    benchmark is empty or has no words.  Items that repeat a passage, or an id,
    are all reported.  Texts that repeat have one row.  Very long texts are
    read whole.  Other columns of either table are not read.
    """
    spark, staged = docs.sparkSession, Staged()
    small_batches(spark)
    cut = staged(item_windows(benchmark, item, item_text, size), "windows")
    windows = cut.groupBy("window").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    shingles = staged(windows.select("window", "size", F.posexplode("shingles").alias("offset", "h")), "window-shingles")
    sizes = sorted(min(SHINGLE, r["size"]) for r in shingles.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct().collect())
    held = shingle_filter(shingles, shingles.select("h").distinct().count())
    met = staged(occurrences(docs, text, sizes, held, size).distinct(), "occurrences")
    rarity = met.groupBy("h").agg(F.count_distinct("a", "b").alias("texts"))
    order = F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "h", "offset")
    anchors = shingles.join(rarity, "h", "left").groupBy("window", "size").agg(F.min(order).alias("x")).select("window", "size", "x.h", "x.offset")
    start = F.col("at") - F.col("offset")
    there = F.array_join(F.slice(F.split("near", " "), start - F.col("since") + 1, F.col("size")), " ")
    # The prefix join: length and place first, then the words.
    placed = met.join(anchors, "h").where((start >= 0) & (start + F.col("size") <= F.col("n")))
    hits = staged(placed.where(there == F.col("window")).select("a", "b", start.alias("begin"), (start + F.col("size")).alias("end"), "window").distinct(), "hits")
    before = Window.partitionBy("a", "b").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = hits.select("a", "b", "begin", "end").distinct().withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(-1)))
    runs = runs.withColumn("run", F.sum((F.col("begin") > F.col("upto")).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("a", "b", "run").agg(F.min("begin").alias("s"), F.max("end").alias("e"))
    spans = runs.groupBy("a", "b").agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.array("s", "e"))).alias("spans"))
    pairs = hits.select("a", "b", "window").distinct().join(cut.select("window", "item"), "window").groupBy("a", "b").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = stage(spans.join(pairs, ["a", "b"]).select(F.struct("a", "b").alias("key"), "n_hit", "items", "spans"), "contaminated")
    staged.drop()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None, **of: object) -> DataFrame:
    """(``row``, ``n_words``, ``n_hit``, ``items``, ``spans``) for every row of
    ``docs``: ``row`` is a struct of the columns in ``carry`` (all, if not
    given), so no name of the caller's can clash; the rest is as in
    ``contaminated_texts``, with zeros and empty lists where nothing is hit."""
    found = contaminated_texts(docs, benchmark, text, **of)
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(kept.alias("row"), word_count(F.col(f"`{text}`")).alias("n_words"), text_key(F.col(f"`{text}`")).alias("k"))
    joined = rows.join(bounded(found), F.col("k") == F.col("key"), "left")
    return joined.select("row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"))


def bounded(found: DataFrame) -> DataFrame:
    """With a broadcast hint, if it is known to be small: by what its rows hold."""
    size = found.agg(F.sum(64 + 16 * F.size("spans") + F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + 16 + F.length(x))).alias("n")).first().n
    return F.broadcast(found) if (size or 0) <= BROADCAST_BYTES else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all
    their columns; null and empty texts stay, as do repeated rows."""
    found = contaminated_texts(docs, benchmark, text).select("key")
    if found.count() * 32 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col(f"`{text}`")).alias("k"))
    return rows.join(found, F.col("k") == F.col("key"), "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the items of ``benchmark`` hit in every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[int, str]], size: int = WINDOW) -> tuple[int, int, str]:
    """(n_words, n_hit, digest of items) by trying every place: for tests."""
    found, hit, ids = words(text), set(), set()
    for i, t in items:
        for w in windows_of(words(t), size):
            for p in range(len(found) - len(w) + 1):
                if tuple(found[p : p + len(w)]) == w:
                    hit.update(range(p, p + len(w)))
                    ids.add(i)
    return len(found), len(hit), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS rn,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rn, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT rn, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.rn, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.size = bw.size),
words_hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rn),
items AS (
  SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rn)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit h ON d.rn = h.rn LEFT JOIN items i ON d.rn = i.rn
"""
