"""The engine's surface as Python calls over a store: what a service would route.

Every call takes the principal that asks; questions, feedback and jobs are
recorded in the store, and recording never fails a call.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import logging
import time
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import text as T
from corvane.functions.analyze import DEFAULT_GLOSSARY, Glossary, analyze
from corvane.functions.embedding import EchoGenerator, Embedder, Generator, embedder
from corvane.operators import answering, evaluate, governance, ingest, search, sync
from corvane.operators.governance import BUCKETS, Principal
from corvane.settings import Settings, problems
from corvane.sources import files
from corvane.sources.store import Store

log = logging.getLogger(__name__)
#: Bounds of a request.
MAX_QUESTION, MAX_TOP_K = 4000, 50
FEEDBACK = "id string, rating int, at timestamp"
MODES = {
    "dense": (("dense",), "none"), "sparse": (("sparse",), "none"), "exact": (("exact",), "none"), "trigram": (("trigram",), "none"),
    "hybrid": (search.PATHS, "none"), "hybrid+rerank": (search.PATHS, "rules"), "hybrid+llm": (search.PATHS, "llm"),
}


class Denied(PermissionError):
    """The principal's role is not enough."""


class Limited(RuntimeError):
    """Too many calls; ``retry_after`` in seconds."""

    def __init__(self, retry_after: int):
        super().__init__(f"retry after {retry_after} s")
        self.retry_after = retry_after


class Metrics:
    """Counters and histograms of this process, in the text format of scrapers."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.buckets: dict[str, Counter] = {}
        self.sums: Counter = Counter()

    def inc(self, name: str, **labels: str) -> None:
        self.counts[name, tuple(sorted(labels.items()))] += 1

    def observe(self, name: str, ms: float) -> None:
        own = self.buckets.setdefault(name, Counter())
        for b in (*BUCKETS, float("inf")):
            own[b] += ms <= b
        self.sums[name] += ms

    def render(self) -> str:
        shown = lambda labels: "{" + ",".join(f'{k}="{v}"' for k, v in labels) + "}" if labels else ""
        out = [f"{n}{shown(labels)} {v}" for (n, labels), v in sorted(self.counts.items())]
        for n, own in sorted(self.buckets.items()):
            out += [f'{n}_bucket{{le="{"+Inf" if b == float("inf") else b}"}} {own[b]}' for b in (*BUCKETS, float("inf"))]
            out += [f"{n}_sum {self.sums[n]}", f"{n}_count {own[float('inf')]}"]
        return "\n".join(out) + "\n"


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embed: Embedder | None = None, generate: Generator | None = None, glossary: Glossary = DEFAULT_GLOSSARY):
        self.spark, self.store, self.settings, self.glossary = spark, Store(spark, root), settings or Settings(), glossary
        errors, self.warnings = problems(self.settings)
        if errors:
            raise ValueError("; ".join(errors))
        self.embedder = embed or embedder(self.settings.embedding_provider, self.settings.embedding_dim)
        self.generator = generate or EchoGenerator()
        self.metrics, self.limits, self.jobs_ = Metrics(), {}, ingest.Jobs(self.store)

    # ---- checks

    def _admit(self, who: Principal, role: str = "reader") -> None:
        if not who.may(role):
            raise Denied(f"{role} needed")
        ok, wait = self.limits.setdefault(who.id, governance.TokenBucket(self.settings.rate_limit_per_min)).allow(time.time())
        if not ok:
            self.metrics.inc("limited_total")
            raise Limited(wait)

    @staticmethod
    def _valid(question: str, top_k: int) -> str:
        said = question.strip()
        if not 1 <= len(said) <= MAX_QUESTION:
            raise ValueError(f"a question has 1 to {MAX_QUESTION} characters")
        if not 1 <= top_k <= MAX_TOP_K:
            raise ValueError(f"top_k is 1 to {MAX_TOP_K}")
        return said

    def health(self) -> dict:
        return {"status": "ok", "warnings": self.warnings}

    def ready(self) -> dict:
        return {"documents": self.store.version("documents"), "missing": schemas.missing_versions(self.store.version("documents") or schemas.VERSION)}

    # ---- search and answers

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return self.store.read("chunks", schemas.CHUNKS), self.store.read("documents", schemas.DOCUMENTS)

    def search(self, who: Principal, question: str, top_k: int | None = None, products: list[str] | None = None, document_ids: list[int] | None = None, paths: list[str] | None = None) -> DataFrame:
        """The ranked hits of one question.  ``products`` (also an empty list)
        stand over those the question names; a comparison of several products
        searches each and interleaves."""
        self._admit(who)
        k = top_k or self.settings.search_top_k
        said = self._valid(question, k)
        chunks, docs = self._tables()
        asked = self.spark.createDataFrame([("q", said)], "query_id string, question string")
        filters = search.Filters(products, who.visible_groups, document_ids)
        return answering.retrieve(asked, chunks, docs, self.embedder, filters, self.settings, self.glossary, paths, k, self.generator)

    def ask(self, who: Principal, question: str, top_k: int | None = None, use_documents: bool = True, **filters) -> dict:
        began = time.monotonic()
        if not use_documents:
            self._admit(who)
            return answering.answer_plain(self._valid(question, 1), self.generator)
        hits = self.search(who, question, top_k, **filters).cache()
        asked = self.spark.createDataFrame([("q", question.strip())], "query_id string, question string")
        got = answering.answer_batch(asked, hits, self.generator, self.settings).first()
        shown = [r.asDict(recursive=True) for r in answering.sources(hits).orderBy("index").collect() if r["index"] in set(got.cited)]
        ids = [r.chunk_id for r in hits.orderBy("rank").select("chunk_id").collect()]
        hits.unpersist()
        ms = (time.monotonic() - began) * 1000
        self.metrics.observe("ask_ms", ms)
        self.metrics.inc("answers_total", answered=str(got.answered).lower())
        reply = {"id": uuid.uuid4().hex, "answer": got.answer, "answered": got.answered, "sources": shown, "grounded": got.grounded, "unsupported": list(got.unsupported), "latency_ms": {"total": ms}}
        self._record(who, question, reply, ids)
        return reply

    def ask_stream(self, who: Principal, question: str, top_k: int | None = None, **filters) -> Iterator[dict]:
        hits = self.search(who, question, top_k, **filters).orderBy("rank").collect()
        yield from answering.stream_answer(question.strip(), [{"content": h.content, "chunk_id": h.chunk_id, "title": h.title} for h in hits], self.generator)

    def _record(self, who: Principal, question: str, reply: dict, chunk_ids: list[int]) -> None:
        try:
            a = analyze(question, self.glossary)
            row = (reply["id"], dt.datetime.now(dt.UTC).replace(tzinfo=None), who.id, question, a.products, a.intent, len(chunk_ids), reply["answered"], reply["grounded"], reply["unsupported"], chunk_ids, reply["answer"], reply["latency_ms"], self.generator.name, reply["id"][:12], None, None)
            self.store.append("query_log", self.spark.createDataFrame([row], schemas.QUERY_LOG))
        except Exception:
            log.exception("the query log could not be written")

    def feedback(self, who: Principal, query_id: str, rating: int) -> bool:
        """Rate an answer 1 or -1; whether there is such a query."""
        self._admit(who)
        if rating not in (1, -1):
            raise ValueError("a rating is 1 or -1")
        if self.store.read("query_log", schemas.QUERY_LOG).where(F.col("id") == query_id).limit(1).count() == 0:
            return False
        self.store.append("feedback", self.spark.createDataFrame([(query_id, rating, dt.datetime.now(dt.UTC).replace(tzinfo=None))], FEEDBACK))
        return True

    # ---- documents

    def ingest(self, who: Principal, root: str, groups: list[str] | None = None, force: bool = False) -> str:
        """Index a directory as a job; its id."""
        self._admit(who, "editor")
        work = lambda: {r.status: r.n for r in ingest.ingest(self.store, root, self.embedder, self.settings, groups, force).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return self.jobs_.run("upload", work)

    def sync(self, who: Principal, root: str, delete_missing: bool = False) -> str:
        """Bring the index in line with a directory as a job; its id.  What is
        missing is only deleted on request; files whose size and time are as
        recorded are not read."""
        self._admit(who, "admin")

        def work() -> dict[str, int]:
            known = self.store.read("documents", schemas.DOCUMENTS)
            light = sync.quick_unchanged(files.scan(self.spark, root, content=False), known)
            hashes = files.scan(self.spark, root).select("path", "sha256").join(light.where("NOT same").select("path"), "path", "left_semi")
            plan = sync.plan(light.join(hashes, "path", "left").select("path", "size", "mtime", "sha256"), known, light.select("path").first()[0].split(root.rstrip("/"))[0] + root.rstrip("/") + "/" if light.limit(1).count() else root).cache()
            counts = {r.action: r.n for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
            moved = plan.where("action = 'moved'").select(F.col("document_id").alias("__d"), F.col("path").alias("__p"))
            if counts.get("moved"):
                self.store.update("documents", schemas.DOCUMENTS, lambda df: df.join(moved, F.col("id") == F.col("__d"), "left").withColumn("source_path", F.coalesce("__p", "source_path")).drop("__d", "__p"))
            if counts.get("new", 0) + counts.get("changed", 0):
                ingest.ingest(self.store, root, self.embedder, self.settings, supersede=True).count()
            if delete_missing and counts.get("missing"):
                gone = plan.where("action = 'missing'").select("document_id")
                chunks, docs = self._tables()
                self.store.replace_all({"chunks": chunks.join(gone, "document_id", "left_anti").select(*chunks.columns), "documents": docs.join(gone, docs.id == gone.document_id, "left_anti")})
            plan.unpersist()
            return counts

        return self.jobs_.run("sync", work)

    def jobs(self, who: Principal, job_id: str | None = None) -> DataFrame:
        self._admit(who, "editor")
        rows = self.jobs_.list()
        return rows if job_id is None else rows.where(F.col("id") == job_id)

    def documents(self, who: Principal) -> DataFrame:
        self._admit(who)
        chunks, docs = self._tables()
        return sync.rollup(docs.where(search.acl_predicate(F.col("acl_groups"), who.visible_groups)), chunks.select("document_id", "token_count"))

    def delete(self, who: Principal, document_id: int) -> bool:
        self._admit(who, "admin")
        return ingest.delete_document(self.store, document_id)

    # ---- administration

    def queries(self, who: Principal, n: int = 50, failed: bool = False) -> DataFrame:
        self._admit(who, "admin")
        rows = governance.with_feedback(self.store.read("query_log", schemas.QUERY_LOG), self.store.read("feedback", FEEDBACK))
        return governance.failed_queries(rows, n) if failed else rows.orderBy(F.desc("asked_at"), "id").limit(n)

    def stats(self, who: Principal, days: int = 7) -> DataFrame:
        self._admit(who, "admin")
        rows = governance.with_feedback(self.store.read("query_log", schemas.QUERY_LOG), self.store.read("feedback", FEEDBACK))
        return governance.query_log_stats(rows, since=F.current_timestamp() - F.make_interval(days=F.lit(days)))

    # ---- evaluation

    def evaluate(self, questions: DataFrame, modes: list[str] | None = None, top_k: int = 10, answers: bool = False, baseline: bool = False) -> DataFrame:
        """(mode, metric, value) for gold questions (schemas.QUESTIONS); with
        ``answers`` also what the answers are worth, with ``baseline`` those of
        the same generator without retrieval, which has no recall at all."""
        chunks, docs = self._tables()
        asked = questions.select(F.col("id").alias("query_id"), "question", "unanswerable", "tags")
        expect = questions.select(F.col("id").alias("query_id"), "expect")
        gold = questions.select(F.col("id").alias("query_id"), F.explode("answers").alias("a")).select("query_id", "a.document", F.explode_outer("a.pages").alias("page"))
        parts = []
        for mode in modes or list(MODES):
            paths, rerank = MODES[mode]
            s = Settings(**{**self.settings.__dict__, "rerank_provider": rerank})
            hits = answering.retrieve(asked, chunks, docs, self.embedder, None, s, self.glossary, paths, top_k, self.generator).persist()
            scored = evaluate.scores(asked, hits, gold)
            parts.append(evaluate.retrieval_report(scored).select(F.lit(mode).alias("mode"), "metric", "value"))
            if answers:
                told = answering.answer_batch(asked.select("query_id", "question"), hits, self.generator, s)
                parts.append(evaluate.long_form(evaluate.answer_report(evaluate.answers_judged(scored, told, expect)), mode))
        if baseline:
            plain = asked.withColumn("answer", answering.generated(self.generator, F.lit(answering.PLAIN_RULES), F.col("question"))).join(expect, "query_id")
            rows = plain.select("query_id", "unanswerable", "answer", "expect", F.lit(None).cast("int").alias("cited"), F.lit(None).cast("int").alias("matching"), F.lit(None).cast("boolean").alias("grounded"))
            parts.append(evaluate.long_form(evaluate.answer_report(rows), evaluate.BASELINE))
        return functools.reduce(DataFrame.unionByName, parts)

    def save_run(self, rows: DataFrame, label: str = "", top_k: int = 10) -> dict:
        """Keep the metrics of ``evaluate`` as a file of the store's ``results``."""
        s, now = self.settings, dt.datetime.now(dt.UTC)
        names = ("chunk_target_chars", "search_candidates", "rerank_candidates", "query_expansion", "grounding_mode")
        made = evaluate.payload([(r.mode, r.metric, r.value) for r in rows.collect()], label, now.isoformat(timespec="seconds"), {"top_k": top_k, "embedding": self.embedder.name, "generator": self.generator.name, "rerank": s.rerank_provider}, {n: getattr(s, n) for n in names} | {"weights": s.path_weights})
        self.store.write_text(f"results/{now:%Y%m%d-%H%M%S}{'-' + label if label else ''}.json", json.dumps(made, ensure_ascii=False, indent=2))
        return made


def not_found(reply: dict) -> bool:
    return T.NOT_FOUND.rstrip(".") in reply["answer"]
