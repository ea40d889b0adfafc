"""Queries: query log, evaluation, limits, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluate, governance
from corvane.plans import retrieval as R
from corvane.plans import views as V
from corvane.streaming import query_log as streams


def query_log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.query_log_stats(V.query_log(spark, sf_dir), since=F.lit("2024-01-08").cast("timestamp"))


STATS_SQL = f"""WITH {V.QUERY_LOG} SELECT count(*) AS total, count(*) FILTER (answered) AS answered, count(*) FILTER (NOT grounded) AS ungrounded, count(*) FILTER (rating = 1) AS liked, count(*) FILTER (rating = -1) AS disliked,
  quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, round_even(count(*) FILTER (answered) / count(*), 3) AS answer_rate FROM query_log WHERE asked_at > TIMESTAMP '2024-01-08'"""


def failed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.failed_queries(V.query_log(spark, sf_dir), 100).select("id", "asked_at", "answer")


FAILED_SQL = f"WITH {V.QUERY_LOG} SELECT id, asked_at, left(answer, 300) AS answer FROM query_log WHERE NOT answered OR rating = -1 OR NOT grounded ORDER BY asked_at DESC, id LIMIT 100"


def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's rating by their latest purchase or cheap click."""
    log = V.query_log(spark, sf_dir)
    users = log.select(F.col("principal").alias("id")).distinct().withColumn("rating", F.lit(None).cast("int"))
    return governance.with_feedback(users, log.select(F.col("principal").alias("id"), "rating", F.struct("asked_at", F.col("id").cast("long")).alias("at")))


FEEDBACK_SQL = f"""WITH {V.QUERY_LOG} SELECT principal AS id, CAST(arg_max(rating, (asked_at, CAST(id AS BIGINT))) FILTER (rating IN (1, -1)) AS INT) AS rating FROM query_log GROUP BY 1"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(V.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


LATENCY_SQL = """WITH v AS (SELECT event_type AS stage, list_sort(list(value)) AS v, count(*) AS n, sum(value) AS t FROM events GROUP BY 1)
SELECT stage, n, round_even(v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1], 1) AS p50, round_even(v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 1) AS p95, round_even(t / n, 1) AS mean FROM v"""


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice") / 20).alias("ms"))
    return governance.histogram(rows, ["o_orderstatus"], "ms").drop("total")


HISTOGRAM_SQL = "WITH b AS (SELECT unnest([50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 1e18]) AS b) SELECT o_orderstatus, CASE WHEN b > 1e17 THEN '+Inf' ELSE CAST(CAST(b AS INT) AS VARCHAR) END AS le, count(*) FILTER (o_totalprice / 20 <= b) AS n FROM orders, b GROUP BY o_orderstatus, b"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; gold are documents that hold them."""
    b, d = V.table(spark, sf_dir, "benchmark"), V.table(spark, sf_dir, "documents")
    hits = R.sparse_or_topk(spark, sf_dir).where("rank <= 10").join(d.select(F.col("doc_id").alias("chunk_id"), "text", "lang"), "chunk_id")
    hits = hits.select("query_id", "rank", F.col("chunk_id").cast("string").alias("title"), F.lit(1).alias("page_from"), F.lit(1).alias("page_to"), "text").persist()  # searched once
    # A document can only hold a passage if it was found by its words: gold among the hits.
    held = hits.join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), "query_id").where(F.contains("text", "passage"))
    gold = held.select("query_id", F.col("title").alias("document"), F.lit(1).alias("page"))
    asked = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10 == 0).alias("unanswerable"), F.array(F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")), F.lit("all")).alias("tags"))
    return evaluate.scores(asked, hits.drop("text"), gold)


SCORED_SQL = f"""{R.SPARSE_SQL}, hits AS (SELECT s.query_id, s.rank, contains(d.text, b.text) AS gold FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id JOIN benchmark b ON b.item_id = s.query_id WHERE rank <= 10),
scored AS (SELECT b.item_id AS query_id, b.item_id % 10 = 0 AS unanswerable, count(h.rank) AS n, coalesce(list_sort(list(h.rank) FILTER (h.gold)), []) AS ranks FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id GROUP BY 1, 2)"""


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.retrieval_report(_scored(spark, sf_dir))


_PER_K = " UNION ALL ".join(
    f"""SELECT 'recall@{k}' AS metric, round(avg(CASE WHEN len(list_filter(ranks, lambda r: r <= {k})) > 0 THEN 1.0 ELSE 0.0 END), 6) AS value FROM a
UNION ALL SELECT 'precision@{k}', round(avg(CASE WHEN n > 0 THEN len(list_filter(ranks, lambda r: r <= {k})) / least(n, {k}) ELSE 0.0 END), 6) FROM a
UNION ALL SELECT 'ndcg@{k}', round(avg(coalesce(list_sum(list_transform(list_filter(ranks, lambda r: r <= {k}), lambda r: 1 / log2(r + 1))) / list_sum(list_transform(range(1, len(list_filter(ranks, lambda r: r <= {k})) + 1), lambda r: 1 / log2(r + 1))), 0.0)), 6) FROM a"""
    for k in evaluate.KS
)
METRICS_SQL = f"WITH {SCORED_SQL}, a AS (SELECT * FROM scored WHERE NOT unanswerable) SELECT 'mrr' AS metric, round(avg(coalesce(1.0 / ranks[1], 0)), 6) AS value FROM a UNION ALL {_PER_K}"


def recall_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_tag(_scored(spark, sf_dir))


TAG_SQL = f"""WITH {SCORED_SQL}, t AS (SELECT unnest(['t' || query_id % 3, 'all']) AS tag, len(ranks) > 0 AS hit FROM scored WHERE NOT unanswerable)
SELECT tag, count(*) AS questions, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall FROM t GROUP BY 1"""


def questions_without_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failures(_scored(spark, sf_dir))


MISSED_SQL = f"WITH {SCORED_SQL} SELECT query_id FROM scored WHERE NOT unanswerable AND len(ranks) = 0"


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values of the events of a week against those of the next."""
    e = V.table(spark, sf_dir, "events")
    run = lambda a, b, kinds: e.where(F.col("ts").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")) & ~F.col("event_type").isin(kinds)).groupBy(F.col("event_type").alias("mode")).agg(F.round(F.avg("value") / 30, 6).alias("value")).select("mode", F.lit("mean").alias("metric"), "value")
    return evaluate.compare(run("2024-01-01", "2024-01-08", ["view"]), run("2024-01-08", "2024-01-15", ["error"]))


_RUN = "SELECT event_type AS mode, 'mean' AS metric, round(avg(value) / 30, 6) AS v FROM events WHERE ts BETWEEN TIMESTAMP '{}' AND TIMESTAMP '{}' AND event_type <> '{}' GROUP BY 1"
COMPARE_SQL = f"""WITH o AS ({_RUN.format('2024-01-01', '2024-01-08', 'view')}), n AS ({_RUN.format('2024-01-08', '2024-01-15', 'error')})
SELECT coalesce(o.mode, n.mode) AS mode, coalesce(o.metric, n.metric) AS metric, o.v AS old, n.v AS new, round(n.v - o.v, 6) AS delta,
  CASE WHEN o.v IS NULL OR n.v IS NULL THEN 'incomparable' WHEN round(n.v - o.v, 6) > 0.02 THEN 'improved' WHEN round(n.v - o.v, 6) < -0.02 THEN 'worse' ELSE 'no difference' END AS verdict
FROM o FULL JOIN n ON o.mode = n.mode AND o.metric = n.metric"""


def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_no"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("mode"), "o_totalprice")
    return evaluate.merge_runs(o)


MERGE_SQL = "SELECT max(o_orderkey) AS file_no, o_orderstatus || '/' || o_orderpriority AS mode, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 2"


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.query_log(spark, sf_dir)
    rows = e.select((F.col("kind") == "error").alias("unanswerable"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("sorry: 제공된 문서에서 찾지 못했습니다."), "answer")).otherwise(F.col("answer")).alias("answer"), F.lit('"K"').alias("expect"), (F.col("k") % 4).alias("cited"), F.least(F.col("k") % 4, F.lit(1)).alias("matching"), "grounded")
    return evaluate.answer_report(rows)


ANSWERS_SQL = f"""WITH e AS (SELECT event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_type <> 'view' THEN event_type <> 'signup' END AS g, props FROM events)
SELECT round(avg(CASE WHEN kind <> 'error' THEN CASE WHEN contains(lower(props), '"k"') THEN 1.0 ELSE 0.0 END END), 6) AS answer_accuracy, round(avg(CASE WHEN k % 4 > 0 THEN least(k % 4, 1) / (k % 4) END), 6) AS citation_precision,
  round(avg(CASE WHEN g THEN 1.0 WHEN NOT g THEN 0.0 END), 6) AS grounded_rate, round(avg(CASE WHEN kind = 'error' THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END END), 6) AS honesty FROM e"""


def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events, an hour counted as a second."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("timestamp").alias("at"))
    return governance.rate_limit_replay(e, 2)


REPLAY_SQL = """WITH RECURSIVE c AS (
  SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor((epoch_us(ts) / 3.6e9) * 1e6) AS BIGINT) / 1e6 AS s FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s) AS i FROM c),
st AS (SELECT key, i, s, CAST(1 AS DOUBLE) AS tokens, true AS allowed, 0 AS retry_after FROM r WHERE i = 1
  UNION ALL SELECT key, i, s, CASE WHEN t < 1 THEN t ELSE t - 1 END, t >= 1, CASE WHEN t < 1 THEN CAST(floor((1 - t) * 60 / 2) AS INT) + 1 ELSE 0 END
  FROM (SELECT r.key, r.i, r.s, least(2.0::DOUBLE, st.tokens + (r.s - st.s) * 2 / 60) AS t FROM st JOIN r ON r.key = st.key AND r.i = st.i + 1))
SELECT key, make_timestamp(CAST(floor(s * 1e6) AS BIGINT)) AS at, allowed, retry_after FROM st"""


def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return governance.gap_counts(e, "user_id", "ts", 86400).select("event_id", "recent")


RECENT_SQL = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM events"


def stream_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed_stats(V.table(spark, sf_dir, "events"))


DAILY_SQL = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type AS label, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


_ALL = (query_log_stats, failed_queries, feedback_latest, latency_percentiles, value_histogram, retrieval_metrics, recall_by_tag, questions_without_hit, run_compare, merge_runs, answer_metrics, rate_limit_replay, recent_calls, stream_daily_stats)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "query_log_stats": STATS_SQL, "failed_queries": FAILED_SQL, "feedback_latest": FEEDBACK_SQL, "latency_percentiles": LATENCY_SQL, "value_histogram": HISTOGRAM_SQL, "retrieval_metrics": METRICS_SQL, "recall_by_tag": TAG_SQL,
    "questions_without_hit": MISSED_SQL, "run_compare": COMPARE_SQL, "merge_runs": MERGE_SQL, "answer_metrics": ANSWERS_SQL, "rate_limit_replay": REPLAY_SQL, "recent_calls": RECENT_SQL, "stream_daily_stats": DAILY_SQL,
}
