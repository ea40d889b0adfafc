"""Retrieval metrics over a batch of questions, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

KS = (1, 3, 5, 10)
NOISE = 0.02
#: The mode of answers without retrieval.
BASELINE = "no-retrieval"
#: Buckets of a stage's values in which a percentile is looked for.
LATENCY_BUCKETS = 4096


def matched_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, ranks): all ranks, rising, of hits that cover a gold location.
    ``hits``: (query_id, rank, title, page_from, page_to); ``gold``: (query_id,
    document, page), a null page meaning any."""
    covers = (F.col("g.document") == F.col("h.title")) & (F.col("g.page").isNull() | F.col("g.page").between(F.col("h.page_from"), F.col("h.page_to")))
    met = hits.alias("h").join(gold.alias("g"), (F.col("h.query_id") == F.col("g.query_id")) & covers, "left_semi")
    return met.groupBy("query_id").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))


def scores(questions: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, unanswerable, tags, n, ranks) for every question."""
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = questions.join(n, "query_id", "left").join(matched_ranks(hits, gold), "query_id", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def recall_at(k: int, ranks: Column) -> Column:
    return F.exists(ranks, lambda r: r <= k).cast("double")


def precision_at(k: int, ranks: Column, n: Column) -> Column:
    return F.when(n > 0, F.size(F.filter(ranks, lambda r: r <= k)) / F.least(n, F.lit(k))).otherwise(0.0)


def ndcg_at(k: int, ranks: Column) -> Column:
    """Binary gains against the same number of them packed at the top."""
    found = F.filter(ranks, lambda r: r <= k)
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))
    return F.when(F.size(found) > 0, gain(found) / gain(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))))).otherwise(0.0)


def reciprocal(ranks: Column) -> Column:
    return F.when(F.size(ranks) > 0, 1 / F.array_min(ranks)).otherwise(0.0)


def retrieval_report(scored: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(metric, value) over answerable questions; null where there are none."""
    r, n = F.col("ranks"), F.col("n")
    named: dict[str, Column] = {"mrr": reciprocal(r)}
    for k in ks:
        named |= {f"recall@{k}": recall_at(k, r), f"precision@{k}": precision_at(k, r, n), f"ndcg@{k}": ndcg_at(k, r)}
    row = scored.where(~F.col("unanswerable")).agg(*[F.avg(v).alias(k) for k, v in named.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(F.col(f"`{k}`"), 6).alias("value")) for k in named]))
    return row.select(pairs.alias("x")).select("x.metric", "x.value")


def by_tag(scored: DataFrame, k: int = 10) -> DataFrame:
    """(tag, questions, recall) of answerable questions, by tag."""
    rows = scored.where(~F.col("unanswerable")).select(F.explode("tags").alias("tag"), recall_at(k, F.col("ranks")).alias("hit"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("hit"), 6).alias("recall")).orderBy("tag")


def failures(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("unanswerable") & (F.size("ranks") == 0)).select("query_id")


def answer_report(answers: DataFrame) -> DataFrame:
    """One row: answer_accuracy, citation_precision, grounded_rate, honesty.
    ``answers``: (unanswerable, answer, expect, cited, matching, grounded,
    answered); parts a question has not are null and do not count."""
    correct = F.when(~F.col("unanswerable"), T.expectation_met(F.col("answer"), F.col("expect")).cast("double"))
    citation = F.when(F.col("cited") > 0, F.col("matching") / F.col("cited"))
    honest = F.when(F.col("unanswerable"), T.is_not_found(F.col("answer")).cast("double"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return answers.agg(mean(correct, "answer_accuracy"), mean(citation, "citation_precision"), mean(F.col("grounded").cast("double"), "grounded_rate"), mean(honest, "honesty"))


def answers_judged(scored: DataFrame, answers: DataFrame, expect: DataFrame) -> DataFrame:
    """What ``answer_report`` takes, from ``scores``, judged answers (query_id,
    answer, answered, cited, grounded) and (query_id, expect).  Cited hits that
    cover a gold location match; questions without an answer cite none."""
    rows = scored.join(answers.select("query_id", "answer", "cited", "grounded"), "query_id").join(expect, "query_id")
    cited = F.when(~F.col("unanswerable"), F.size("cited"))
    return rows.select("query_id", "unanswerable", "answer", "expect", cited.alias("cited"), F.size(F.array_intersect(F.col("cited").cast("array<int>"), F.col("ranks").cast("array<int>"))).alias("matching"), "grounded")


def long_form(report: DataFrame, mode: str) -> DataFrame:
    """(mode, metric, value) of a report of one row."""
    return report.unpivot([], report.columns, "metric", "value").select(F.lit(mode).alias("mode"), "metric", "value")


def payload(rows: list[tuple[str, str, float | None]], label: str, ran_at: str, facts: dict, settings: dict) -> dict:
    """A run as one plain mapping: its metrics by mode, the baseline apart, and
    what is needed to run it again."""
    modes: dict[str, dict] = {}
    for mode, metric, value in rows:
        modes.setdefault(mode, {})[metric] = value
    return {"label": label, "ran_at": ran_at, **facts, "baseline": modes.pop(BASELINE, None), "modes": modes, "settings": settings}


def nearest_rank(values: Column, q: float) -> Column:
    """The value at place half-even(q (n - 1)) of the sorted ones, 1 digit;
    ``values`` is an array."""
    at = F.bround(F.lit(q) * (F.size(values) - 1)).cast("int") + 1
    return F.when(F.size(values) > 0, F.bround(F.element_at(F.array_sort(values), at), 1))


def latency(stages: DataFrame) -> DataFrame:
    """(stage, n, p50, p95, mean) from (stage, ms), the values at places
    half-even(q (n - 1)): counts by buckets of equal width tell in which of
    them a place lies, and only that bucket's values are then ordered."""
    rows = stages.where("ms is not null").select("stage", F.col("ms").cast("double").alias("ms"))
    whole = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"), F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("ms") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    dealt = rows.join(whole.select("stage", "lo", "hi"), "stage").select("stage", "ms", F.least(F.floor(share * LATENCY_BUCKETS), F.lit(LATENCY_BUCKETS - 1)).alias("bucket"))
    upto = Window.partitionBy("stage").orderBy("bucket")
    counts = dealt.groupBy("stage", "bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto))
    asked = whole.select("stage", "n", F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("q")).withColumn("place", F.bround(F.col("q") * (F.col("n") - 1)).cast("long"))
    where = counts.join(asked, "stage").where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))
    where = where.select("stage", "bucket", "q", (F.col("place") - F.col("upto") + F.col("c")).alias("skip"))
    among = dealt.join(where, ["stage", "bucket"]).groupBy("stage", "q", "skip", "ms").agg(F.count(F.lit(1)).alias("c"))
    found = among.withColumn("upto", F.sum("c").over(Window.partitionBy("stage", "q").orderBy("ms"))).where(F.col("upto") > F.col("skip")).groupBy("stage").agg(*[F.bround(F.min(F.when(F.col("q") == q, F.col("ms"))), 1).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"))])
    return whole.join(found, "stage").select("stage", "n", "p50", "p95", F.bround(F.col("total") / F.col("n"), 1).alias("mean"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(mode, metric, old, new, delta, verdict) of two runs (mode, metric, value)."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["mode", "metric"], "full")
    delta = F.round(F.col("new") - F.col("old"), 6)
    verdict = F.when(delta.isNull(), "incomparable").when(delta > NOISE, "improved").when(delta < -NOISE, "worse").otherwise("no difference")
    return both.select("mode", "metric", "old", "new", delta.alias("delta"), verdict.alias("verdict"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Of runs (file_no, mode, ...) the latest file's row of each mode."""
    last = Window.partitionBy("mode").orderBy(F.desc("file_no"))
    return runs.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def markdown_report(metrics: list[tuple[str, str, float | None]], failed: list[str], stages: list[tuple]) -> str:
    """A report of (mode, metric, value), failed questions and (stage, p50, p95)."""
    shown = lambda v: "N/A" if v is None else f"{v:.3f}"
    modes, names = list(dict.fromkeys(m for m, _, _ in metrics)), list(dict.fromkeys(n for _, n, _ in metrics))
    value = {(m, n): v for m, n, v in metrics}
    out = ["# Evaluation", "", "| mode | " + " | ".join(names) + " |", "|" + "-|" * (len(names) + 1)]
    out += [f"| {m} | " + " | ".join(shown(value.get((m, n))) for n in names) + " |" for m in modes]
    out += ["", "## Latency (ms)", "", "| stage | p50 | p95 |", "|-|-|-|", *(f"| {s} | {a} | {b} |" for s, a, b in stages)]
    return "\n".join([*out, "", "## Questions without a hit", "", *(f"- {q}" for q in failed or ["none"]), ""])
