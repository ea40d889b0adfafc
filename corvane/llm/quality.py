"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression on counts of a text's characters,
words and lines) gives each document evidence for good quality.  Its shares are
aggregated by path and by host; the strength of the priors is estimated from
how much sites differ beyond chance (method of moments), so a sparse path is
shrunk towards its host, and a sparse host towards the global share.  Evidence
and the path's posterior are combined as log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import kept_by_worker, small_batches, stage, words

#: Labelled texts of either class that the classifier is fitted on at most.
PER_CLASS = 3000
#: Posteriors of more paths than this are joined by shuffle, not broadcast.
BROADCAST_PATHS = 200_000
#: A document is kept from this probability of good quality on.
KEEP = 0.5
#: How far the prior strength may go, in documents.
STRENGTH = (2.0, 10_000.0)
#: A site's posterior moves a document's log-odds by so much at most: sites
#: alone never reject a document whose text is clearly good.
SITE_LIMIT = 2.0

_KIND = np.zeros(256, np.intp)  # 0 letters, 1 digits, 2 spaces, 3 line ends, 4 usual marks, 5 other marks, 6 upper case, 7 controls, 8 other scripts
for _c in range(256):
    _KIND[_c] = 8 if _c >= 128 else 6 if 65 <= _c <= 90 else 0 if 97 <= _c <= 122 else 1 if 48 <= _c <= 57 else 3 if _c == 10 else 2 if _c in (9, 32) else 7 if _c < 32 or _c == 127 else 4 if chr(_c) in ".,;:'\"()-!?" else 5
N_FEATURES = 26


def features(text: str | None) -> list[float]:
    """Counts over the whole text as shares; zeros for a null or empty text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * N_FEATURES
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_KIND, count, minlength=9) / len(raw)
    own, lines = words(text), text.split("\n")
    spaced = max(1, raw.count(b" ") + raw.count(b"\n") + 1)
    distinct, n = len(set(own)), max(1, len(own))
    share = [x / spaced for x in (count[33], count[46], count[44], count[124], count[35] + count[36] + count[37] + count[38] + count[42] + count[64])]
    ends = sum(1 for x in lines if x.rstrip()[-1:] in (".", "!", "?")) / len(lines)
    return [
        *kind.tolist(), *np.sqrt(share).tolist(), float(np.log1p(n)), distinct / n, len(raw) / n / 10, n / spaced, ends,
        1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))), float(np.log1p(len(raw) / len(lines))), min(1.0, n / 20), float(n < 5), np.sqrt(kind[5]), np.sqrt(kind[6]),
    ]


class Classifier:
    """Logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        z = self._expand(x)
        self.w = np.zeros(z.shape[1])
        if len(set(y.tolist())) < 2:
            self.w[0] = 0.0 if not len(y) else 2.0 * (2 * y[0] - 1)
            return
        ridge = np.full(z.shape[1], 1.0)
        ridge[0] = 1e-3
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (p - y)) + ridge * self.w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, g)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((np.asarray(x, float).reshape(-1, N_FEATURES) - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], 1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality, within 12 of even."""
        return np.clip(self._expand(x) @ self.w, -12, 12)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = PER_CLASS) -> Classifier:
    """Fit on at most ``per_class`` texts of either label, those with the least
    hash of doc_id, weighted to the labels' natural shares.  Null labels and ids
    are left out; a doc_id labelled more than once is good only if all say so."""
    small_batches(docs.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = {r.quality: r["count"] for r in own.groupBy("quality").count().collect()}
    part = lambda c: own.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    picked = F.broadcast(part(0).unionByName(part(1)))

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "h": b["h"], "q": b["q"], "x": [features(t) for t in b["t"]]})

    texts = docs.select("doc_id", F.col(text).alias("t")).join(picked, "doc_id")
    rows = texts.select(F.col("doc_id").cast("string").alias("i"), F.xxhash64("t").alias("h"), F.col("quality").alias("q"), "t")
    # Of rows that repeat an id, the text with the least hash counts.
    one = rows.mapInPandas(count, "i string, h long, q int, x array<double>").groupBy("i").agg(F.min(F.struct("h", "q", "x")).alias("r"))
    got = sorted(one.select("i", "r.q", "r.x").collect(), key=lambda r: r.i)
    y = np.array([r.q for r in got], float)
    weight = np.array([total[r.q] / max(1, (y == r.q).sum()) for r in got])
    return Classifier(np.array([r.x for r in got], float).reshape(-1, N_FEATURES), y, weight * len(y) / max(1e-9, weight.sum()))


def evidence(model: Classifier, docs: DataFrame, text: str = "text") -> Column:
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept_by_worker("quality", dict)  # frees what other operators left
        for batch in batches:
            yield pd.Series(held.value.evidence(np.array([features(t) for t in batch], float)) if len(batch) else [], dtype=float)

    return tell(F.col(text))


def _shrink(total: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (total + strength * prior) / (n + strength)


def _strength(rows: DataFrame, n: str, s: str, prior: str) -> float:
    """The prior strength by the method of moments: with q = prior (1 - prior),
    the variance v between sites is what their shares vary beyond binomial
    chance, and a beta prior of that variance has the strength q / v - 1."""
    q = F.col(prior) * (1 - F.col(prior))
    far = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - F.col(prior), 2)) - F.sum(q)
    got = rows.agg((far / F.sum(n)).alias("v"), (F.sum(F.col(n) * q) / F.sum(n)).alias("q")).first()
    return STRENGTH[1] if not got.v or got.v <= 0 else float(np.clip(got.q / got.v - 1, *STRENGTH))


def site_posteriors(scored: DataFrame, host: str, path: str, evidence_of: str) -> DataFrame:
    """(host, path, n_path, n_host, global_rate, host_rate, path_rate) from all
    documents' expected quality.  Null hosts and paths are sites of their own.
    The sums by path are written once to the shared folder, so the texts are
    read once; only single rows of totals come to the driver."""
    p = 1 / (1 + F.exp(-F.col(evidence_of)))
    sums = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s"))
    paths = stage(sums, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    hosts = hosts.withColumn("global_rate", F.lit(((whole.s or 0.0) + 1) / ((whole.n or 0.0) + 2)))
    hosts = hosts.withColumn("host_rate", _shrink(F.col("hs"), F.col("hn"), F.col("global_rate"), F.lit(_strength(hosts, "hn", "hs", "global_rate"))))
    both = paths.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
    rate = _shrink(F.col("s"), F.col("n"), F.col("host_rate"), F.lit(_strength(both, "n", "s", "host_rate")))
    return both.select("host", "path", F.col("n").cast("long").alias("n_path"), F.col("hn").cast("long").alias("n_host"), "global_rate", "host_rate", rate.alias("path_rate"))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judge(docs: DataFrame, model: Classifier, host: str = "source", path: str = "lang", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(``row``, ``judged``) for every row of ``docs``.

    ``row`` is a struct of the columns in ``carry`` (all, if not given), so no
    name of the caller's can clash.  ``judged`` is a struct of ``evidence``,
    ``n_host``, ``n_path``, ``global_rate``, ``host_rate``, ``path_rate``,
    ``quality`` (0 to 1) and ``keep``.  Each text is scored once: what is
    carried is written to the shared folder with its evidence, so leave out of
    ``carry`` what is not needed.  Rows are kept as often as they come, with
    repeated or null ids or not.  Null and empty texts have the evidence of a
    text without any character; very long ones are read whole; null hosts and
    paths are sites of their own; an empty table gives no rows.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    told = docs.select(kept.alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), evidence(model, docs, text).alias("evidence"))
    scored = stage(told, "quality-evidence")
    sites = stage(site_posteriors(scored, "host", "path", "evidence").select(F.struct("*").alias("site")), "quality-sites")
    if sites.count() <= BROADCAST_PATHS:
        sites = F.broadcast(sites)
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("site.host")) & F.col("path").eqNullSafe(F.col("site.path")), "left")
    shift = logit(F.col("site.path_rate")) - logit(F.col("site.global_rate"))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), shift)))))
    rates = [F.col(f"site.{c}").alias(c) for c in ("n_host", "n_path", "global_rate", "host_rate", "path_rate")]
    return joined.select("row", F.struct("evidence", *rates, quality.alias("quality"), (quality >= KEEP).alias("keep")).alias("judged"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; see
    ``judge`` for nulls, empty and long texts, repeated rows and clashing names."""
    return judge(docs, train(docs, labels)).where("judged.keep").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence, site posteriors and verdict of every row of ``documents``,
    with its source as host and its language as path; see ``judge``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = judge(docs, model, carry=["doc_id", "source", "lang"])
    return judged.select("row.doc_id", F.col("row.source").alias("host"), F.col("row.lang").alias("path"), "judged.*")
