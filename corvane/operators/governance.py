"""Query log, feedback, roles, rate limits, histograms."""

from __future__ import annotations

import hmac
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
ROLES = ("reader", "editor", "admin")
#: Upper bounds of latency buckets in ms.
BUCKETS = (50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000)


@dataclass(frozen=True)
class Principal:
    id: str
    role: str
    groups: tuple[str, ...] = ()

    @property
    def visible_groups(self) -> list[str] | None:
        """None sees everything; a reader without groups sees what is public."""
        return None if self.role == "admin" else list(self.groups)

    def may(self, role: str) -> bool:
        return ROLES.index(self.role) >= ROLES.index(role)


def parse_keys(raw: str) -> dict[str, Principal]:
    """Keys as ``key:role:group|group``, separated by commas; role reader if missing."""
    out = {}
    for entry in filter(None, map(str.strip, raw.split(","))):
        key, role, groups, *_ = [*entry.split(":"), "", ""]
        role = role or "reader"
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        if len(key) < 16:
            log.warning("a key is shorter than 16 characters")
        out[key] = Principal(f"key-{len(out) + 1}", role, tuple(filter(None, groups.split("|"))))
    return out


def authenticate(header: str | None, keys: dict[str, Principal]) -> Principal | None:
    """By ``Bearer key`` or the key itself; anyone is admin without keys."""
    if not keys:
        return Principal("anonymous", "admin")
    given = (header or "").removeprefix("Bearer ").strip().encode()
    return next((p for k, p in keys.items() if hmac.compare_digest(k.encode(), given)), None)


def query_log_stats(log_rows: DataFrame, asked_at: str = "asked_at", since: Column | None = None) -> DataFrame:
    """One row: totals, rates and discrete percentiles of the total latency.
    ``log_rows``: (asked_at, answered, grounded, rating, latency_ms map)."""
    rows = log_rows if since is None else log_rows.where(F.col(asked_at) > since)
    total, answered = F.count(F.lit(1)), F.count_if(F.col("answered"))
    ms = F.col("latency_ms")["total"]
    p = lambda q: F.percentile_disc(ms, q) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({q}) within group (order by latency_ms['total'])")
    return rows.agg(
        total.alias("total"), answered.alias("answered"), F.count_if(~F.col("grounded")).alias("ungrounded"), F.count_if(F.col("rating") == 1).alias("liked"),
        F.count_if(F.col("rating") == -1).alias("disliked"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.bround(F.when(total > 0, answered / total), 3).alias("answer_rate"),
    )


def failed_queries(log_rows: DataFrame, n: int) -> DataFrame:
    """The latest questions unanswered, disliked or ungrounded; unknown is not failed."""
    bad = ~F.col("answered") | (F.col("rating") == -1) | ~F.col("grounded")
    return log_rows.where(F.coalesce(bad, F.lit(False))).withColumn("answer", F.substring("answer", 1, 300)).orderBy(F.desc("asked_at"), "id").limit(n)


def with_feedback(log_rows: DataFrame, feedback: DataFrame) -> DataFrame:
    """Log rows with their latest rating (feedback: id, rating, at); ratings
    other than 1 and -1 do not count."""
    latest = feedback.where(F.col("rating").isin(1, -1)).groupBy("id").agg(F.max_by("rating", F.struct("at", "rating")).alias("__new"))
    return log_rows.join(latest, "id", "left").withColumn("rating", F.coalesce("__new", "rating")).drop("__new")


def histogram(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(labels, le, count) cumulative, with ``+Inf``; and the sum and count."""
    v = F.col(value)
    sums = rows.groupBy(*labels).agg(*[F.count_if(v <= b).alias(str(b)) for b in BUCKETS], F.count(v).alias("+Inf"), F.round(F.sum(v), 6).alias("total"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"`{b}`").alias("n")) for b in [*map(str, BUCKETS), "+Inf"]])
    return sums.select(*labels, "total", F.explode(pairs).alias("x")).select(*labels, "x.le", "x.n", "total")


class TokenBucket:
    """A continuous refill of ``per_min`` tokens a minute; 0 or less lets all by."""

    def __init__(self, per_min: int):
        self.per_min, self.state = per_min, None

    def allow(self, at: float) -> tuple[bool, int]:
        """(whether it passes, seconds to wait) for a call at a time in seconds."""
        if self.per_min <= 0:
            return True, 0
        if self.state is None:
            self.state = (self.per_min - 1.0, at)
            return True, 0
        tokens = min(float(self.per_min), self.state[0] + (at - self.state[1]) * self.per_min / 60)
        if tokens < 1:
            self.state = (tokens, at)
            return False, int((1 - tokens) * 60 / self.per_min) + 1
        self.state = (tokens - 1, at)
        return True, 0


def rate_limit_replay(calls: DataFrame, per_min: int) -> DataFrame:
    """(key, at, allowed, retry_after) for calls (key, at timestamp): each key's
    calls stream through a task in time order, only its bucket is held."""
    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("s")).repartition("key").sortWithinPartitions("key", "s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = object(), None
        for b in batches:
            out = []
            for k, s in zip(b["key"], b["s"], strict=True):
                if k != key:
                    key, bucket = k, TokenBucket(per_min)
                out.append((k, s, *bucket.allow(s)))
            yield pd.DataFrame(out, columns=["key", "s", "allowed", "retry_after"])

    out = rows.mapInPandas(run, "key string, s double, allowed boolean, retry_after int")
    return out.select("key", F.col("s").cast("timestamp").alias("at"), "allowed", "retry_after")


def gap_counts(calls: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Calls with how many of the same key fell in the ``seconds`` before them."""
    w = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return calls.withColumn("recent", F.count(F.lit(1)).over(w))
