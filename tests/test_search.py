"""Search paths, ranking, answers, evaluation, governance, streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.engine import MODES
from corvane.functions.embedding import EchoGenerator, HashEmbedder, embedded
from corvane.operators import answering, evaluate, governance, ranking, search
from corvane.settings import Settings
from corvane.streaming import query_log as streams

HIT = "query_id string, chunk_id long, rank int, score double, content string, section_path string, document_id long, kind string, products array<string>, paths map<string,int>"


def hits(spark, *rows):
    full = [("q", r["id"], i, r.get("score", 1.0), r["content"], r.get("section", "S"), r.get("doc", 1), r.get("kind", "prose"), r.get("products", []), {"dense": 1}) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, HIT)


def order(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_fusion_weights_and_ties(spark):
    path = lambda *ids: spark.createDataFrame([("q", c, i) for i, c in enumerate(ids, 1)], "query_id string, chunk_id long, rank int")
    got = search.fuse({"dense": path(1), "exact": path(2)}, {"dense": 1, "exact": 5})
    assert order(got) == [2, 1] and got.where("chunk_id = 2").first().paths == {"exact": 1}
    assert order(search.fuse({"dense": path(9), "sparse": path(3)}, {})) == [3, 9]
    with pytest.raises(ValueError):
        search.selected(["dense", "other"])


def test_dedupe_keeps_the_first(spark):
    rows = hits(spark, {"id": 1, "content": "a"}, {"id": 2, "content": " a "}, {"id": 3, "content": "b"})
    assert order(search.dedupe(rows, F.trim("content"))) == [1, 3]


def test_diversify(spark):
    a, b = "head\nmemory eight tb per socket", "head\nmemory eight tb per socket"
    rows = hits(spark, {"id": 1, "content": a}, {"id": 2, "content": b}, {"id": 3, "content": "head\npower two kw"})
    assert order(ranking.diversify(rows, 2)) == [1, 3] and order(ranking.diversify(rows, 3)) == [1, 3, 2]
    many = hits(spark, *[{"id": i, "content": f"h\nword{i}", "section": "A" if i < 5 else "B"} for i in range(1, 7)])
    assert order(ranking.diversify(many, 4)) == [1, 2, 3, 5] == order(ranking.cap_sections(many, 4))


def questions(spark, **q):
    row = ("q", q.get("products", []), q.get("identifiers", []), q.get("terms", []), q.get("intent", "general"))
    return spark.createDataFrame([row], "query_id string, products array<string>, identifiers array<string>, terms array<string>, intent string")


def test_rules_prefer_the_product_and_table_rows(spark):
    rows = hits(spark, {"id": 1, "content": "memory", "products": ["B"], "score": 2.0}, {"id": 2, "content": "memory", "products": ["A"], "score": 1.0})
    assert order(ranking.rules(questions(spark, products=["A"], terms=["memory"]), rows, 2)) == [2, 1]
    rows = hits(spark, {"id": 1, "content": "memory"}, {"id": 2, "content": "memory", "kind": "table_row"})
    assert order(ranking.rules(questions(spark, terms=["memory"], intent="spec"), rows, 2)) == [2, 1]
    zero = hits(spark, {"id": 1, "content": "x", "score": 0.0}, {"id": 2, "content": "y", "score": 0.0})
    assert order(ranking.rules(questions(spark), zero, 2)) == [1, 2]


class Backwards:
    name = "backwards"

    def generate(self, system: str, prompt: str) -> str:
        assert system and prompt.startswith("memory?\n\n[1] ")
        return "2, 1"


def test_model_reranker_is_registered(spark):
    rows, asked = hits(spark, {"id": 1, "content": "a"}, {"id": 2, "content": "b"}), questions(spark).withColumn("question", F.lit("memory?"))
    got = ranking.reranker("llm", Backwards())(asked, rows, 2)
    assert order(got) == [2, 1] and got.columns == rows.columns
    assert MODES["hybrid+llm"][1] == "llm"


def test_absent_terms_leave_the_denominator(spark):
    got = ranking.discriminating(questions(spark, terms=["Weight", "무게"], identifiers=["X9"]), hits(spark, {"id": 1, "content": "weight: 42"})).first()
    assert got.terms == ["weight"] and got.idents == ["x9"]


def test_model_reranking_survives_nonsense(spark):
    assert ranking.parse_order("garbage", 3) == [0, 1, 2] and ranking.parse_order("2", 3) == [1, 0, 2] and ranking.parse_order("9, 3, 3, 1", 3) == [2, 0, 1]
    rows = hits(spark, {"id": 1, "content": "a"}, {"id": 2, "content": "b"}).withColumn("question", F.lit("?"))
    assert order(ranking.listwise(rows, "question", lambda p: "[2]", 2)) == [2, 1]
    assert order(ranking.reranker("none")(None, rows, 1)) == [1]


def test_cover_density_and_word_similarity():
    assert search.cover_density([[0, 9], [1]]) == pytest.approx(0.1 + 0.1 / 8) and search.cover_density([[1], []]) == 0
    assert search.word_similarity("word", "two words") == pytest.approx(4 / 5) and search.word_similarity("word", "a word") == 1.0 and search.word_similarity("", "x") == 0


def test_access_is_public_only_for_no_groups(spark):
    docs = spark.createDataFrame([(1, []), (2, ["hr"]), (3, None)], "id int, acl array<string>")
    seen = lambda g: [r.id for r in docs.where(search.acl_predicate(F.col("acl"), g)).orderBy("id").collect()]
    assert seen(None) == [1, 2, 3] and seen([]) == [1, 3] and seen(["hr"]) == [1, 2, 3] and seen(["it"]) == [1, 3]


def corpus(spark):
    e = HashEmbedder(64)
    rows = [(1, 1, 0, "Memory maximum: 8TB", "Memory"), (2, 1, 1, "Part: 4X97B17362", "Parts"), (3, 2, 0, "Weight: 42 kg", "Body"), (4, 1, 2, "Memory maximum: 8TB", "Memory")]
    chunks = spark.createDataFrame([(*r, "table_row", 1, 1, ["ThinkSystem SR650 V4"] if r[1] == 1 else []) for r in rows], "id long, document_id long, ordinal int, content string, section_path string, kind string, page_from int, page_to int, products array<string>")
    chunks = chunks.withColumns({"embedding": embedded(F.col("content"), e), "content_hash": F.md5("content")})
    docs = spark.createDataFrame([(1, "Guide", "g.pdf", "indexed", []), (2, "Body", "b.pdf", "indexed", ["hr"])], "id long, title string, source_path string, status string, acl_groups array<string>")
    return chunks, docs, e


def test_answers_from_question_to_citation(spark):
    chunks, docs, e = corpus(spark)
    asked = spark.createDataFrame([("m", "SR650 V4 memory maximum?"), ("p", "4X97B17362?"), ("w", "weight kg")], "query_id string, question string")
    got = answering.retrieve(asked, chunks, docs, e, search.Filters(groups=[]))
    best = {r.query_id: r for r in got.where("rank = 1").collect()}
    assert best["m"].chunk_id == 1 and best["p"].chunk_id == 2 and got.where("chunk_id = 3").count() == 0 and got.where("chunk_id = 4").count() == 0
    assert best["p"].neighbours == ["Memory maximum: 8TB", "Memory maximum: 8TB"]
    answers = {r.query_id: r for r in answering.answer_batch(asked, got, EchoGenerator()).collect()}
    assert answers["m"].answered and answers["m"].cited == [1] and answers["m"].grounded
    assert answering.sources(got).where("query_id = 'm'").first().citation == "Guide p1"


def models(spark):
    e, rows = HashEmbedder(64), []
    for i, m in enumerate(["SR650 V4"] * 6 + ["SR630 V4"] * 2):
        rows.append((i, i // 6, i, f"{m}\nMemory maximum: {i + 1}TB DDR5 part 4X97B1736{i}", "Memory", "table_row", 1, 1, [f"ThinkSystem {m}"]))
    chunks = spark.createDataFrame(rows, "id long, document_id long, ordinal int, content string, section_path string, kind string, page_from int, page_to int, products array<string>")
    docs = spark.createDataFrame([(0, "A", "a.pdf", "indexed", []), (1, "B", "b.pdf", "indexed", [])], "id long, title string, source_path string, status string, acl_groups array<string>")
    return chunks.withColumns({"embedding": embedded(F.col("content"), e), "content_hash": F.md5("content")}), docs, e


def test_products_that_a_question_names_limit_it(spark):
    chunks, docs, e = models(spark)
    asked = spark.createDataFrame([("one", "SR630 V4 memory maximum?"), ("both", "SR650 V4 vs SR630 V4 memory maximum"), ("code", "SR630 V4 4X97B17363"), ("none", "memory maximum")], "query_id string, question string")
    s = Settings(rerank_candidates=4, section_cap=0, near_dup_similarity=1.0)
    found = {}
    for r in answering.retrieve(asked, chunks, docs, e, settings=s, top_k=4).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, r.products[0]))
    assert {p for _, p in found["one"]} == {"ThinkSystem SR630 V4"} and len(found["one"]) == 2
    assert {p for _, p in found["both"]} == {"ThinkSystem SR650 V4", "ThinkSystem SR630 V4"} and len(found["both"]) == 4
    assert {p for _, p in found["code"]} == {"ThinkSystem SR630 V4"} and len(found["none"]) == 4
    free = answering.retrieve(asked.where("query_id = 'code'"), chunks, docs, e, search.Filters(products=[]), s, top_k=4)
    assert 3 in order(free) and 3 not in {c for c, _ in found["code"]}  # the part number is another product's
    told = answering.answer_batch(asked, answering.retrieve(asked, chunks, docs, e, settings=s, top_k=4), SaysRules())
    assert {r.query_id: r.generated for r in told.collect()} == {"one": "plain", "both": "compare", "code": "plain", "none": "plain"}


class SaysRules:
    name = "rules"

    def generate(self, system, prompt):
        return "compare" if system == answering.COMPARE_RULES else "plain"


def test_blocks_equal_joins(spark, monkeypatch):
    import random

    rng, pool = random.Random(3), ["memory", "power", "drive", "메모리", "cpu", "fan"]
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) if i % 17 else None, [float(rng.randint(-2, 2)) for _ in range(4 if i % 13 else 3)] if i % 11 else None, [f"p{i % 3}"]) for i in range(200)], "id long, content string, embedding array<float>, products array<string>")
    asked = spark.createDataFrame([(q, [rng.choice(pool), f"{rng.choice(pool)} {rng.choice(pool)}"][: q % 3], [float(rng.randint(-2, 2)) for _ in range(4)], [["p1"], [], None, ["p0", "p2"]][q % 4]) for q in range(12)], "query_id int, terms array<string>, vector array<float>, only array<string>")
    run = lambda: [sorted(map(tuple, f(asked, chunks, 7).collect())) for f in (search.dense, search.sparse)]
    blocks = run()
    monkeypatch.setattr(search.blockwise, "SENT_BYTES", 0)
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", 5)
    joins = run()
    assert [[r[:2] + r[3:] for r in x] for x in blocks] == [[r[:2] + r[3:] for r in x] for x in joins] and all(blocks)
    assert all(a[2] == pytest.approx(b[2], abs=2e-9) for x, y in zip(blocks, joins, strict=True) for a, b in zip(x, y, strict=True))
    monkeypatch.setattr(search.blockwise, "SENT_BYTES", 1 << 20)
    monkeypatch.setattr(search.blockwise, "ELEMENTS", 60)
    assert [[r[:2] for r in x] for x in run()] == [[r[:2] for r in x] for x in joins]
    none = asked.limit(0)
    assert search.dense(none, chunks, 3).count() == search.sparse(none, chunks, 3).count() == search.dense(asked, chunks.limit(0), 3).count() == 0


def test_trigram_blocks_equal_joins_and_plain_loops(spark, monkeypatch):
    import random

    rng, pool = random.Random(5), ["memory", "memories", "power supply", "Powered", "drive", "driver", "메모리", "a", "SR650-V4", "", "--"]
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) if i % 17 else None, [f"p{i % 3}"]) for i in range(300)], "id long, content string, products array<string>")
    asked = spark.createDataFrame([(q, [*pool, "memory drives", "power drive", None][q], [["p1"], [], None, ["p0", "p2"]][q % 4]) for q in range(14)], "query_id int, trigram_text string, only array<string>")
    texts, wanted = {r.id: r for r in chunks.collect()}, asked.collect()
    for threshold, n in ((0.6, 7), (0.3, 400), (1.0, 5)):
        want = []
        for q in wanted:
            own = [(-round(search.word_similarity(q.trigram_text, c.content), 9), c.id) for c in texts.values() if q.trigram_text and c.content and (not q.only or set(q.only) & set(c.products))]
            want += [(q.query_id, i, -s, k) for k, (s, i) in enumerate(sorted(x for x in own if -x[0] >= threshold)[:n], 1)]
        run = lambda: sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in search.trigram(asked, chunks, n, threshold).collect())  # noqa: B023,E731
        assert run() == sorted(want) and want
        with monkeypatch.context() as m:
            m.setattr(search.blockwise, "ELEMENTS", 60)
            assert run() == sorted(want)
        with monkeypatch.context() as m:
            m.setattr(search.blockwise, "SENT_BYTES", 0)
            assert run() == sorted(want)
    assert search.trigram(asked.limit(0), chunks, 3).count() == search.trigram(asked, chunks.limit(0), 3).count() == 0


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_trigrams_do_not_send_chunks_through_the_driver(spark, monkeypatch, tmp_path, sent):
    monkeypatch.setattr(search.blockwise, "SENT_BYTES", sent)
    spark.range(20000).select("id", F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.sha1(F.col("id").cast("string")), F.when(F.col("id") % 4000 == 7, "brushed")).alias("content")).write.parquet(f"{tmp_path}/c")
    chunks, asked = spark.read.parquet(f"{tmp_path}/c"), spark.createDataFrame([("q", "brushed")], "query_id string, trigram_text string")
    limit, key = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    try:
        limit.set(key, "800k")  # the chunks are 1.6 MB and files of that size count as small
        assert order(search.trigram(asked, chunks, 50)) == [7, 4007, 8007, 12007, 16007]
    finally:
        limit.remove(key)


@pytest.mark.parametrize(("said", "cited", "answered"), [("8TB [1]", [1], True), ("8TB [99]", [], False), ("8TB", [], False), (T.NOT_FOUND + " [1]", [], False)])
def test_citation_matrix(spark, said, cited, answered):
    row = spark.createDataFrame([("q", said, ["Up to 8TB"], 1)], "query_id string, generated string, evidence array<string>, n int")
    got = answering.judged(row, "warn").first()
    assert got.answered == answered and list(got.cited) == cited and (answered or got.answer == T.NOT_FOUND)


def test_strict_grounding(spark):
    row = spark.createDataFrame([("q", "4TB [1]", ["Up to 8TB"], 1)], "query_id string, generated string, evidence array<string>, n int")
    assert answering.judged(row, "warn").first().unsupported == ["4TB"] and not answering.judged(row, "strict").first().answered and answering.judged(row, "off").first().grounded is None


def test_streamed_answers_warn_only_without_citations():
    class Says:
        name = "says"

        def __init__(self, text):
            self.text = text

        def generate(self, system, prompt):
            return self.text

    last = lambda text, h=({"content": "x"},): list(answering.stream_answer("q", list(h), Says(text)))[-1]
    assert last(T.NOT_FOUND)["warning"] == "" and last("uncited")["warning"] and last("yes [1]")["sources"] and last("any", ())["answer"] == T.NOT_FOUND


def test_metrics(spark):
    asked = spark.createDataFrame([(1, False, ["a"]), (2, False, ["a", "b"]), (3, True, [])], "query_id int, unanswerable boolean, tags array<string>")
    found = spark.createDataFrame([(1, 1, "D", 1, 2), (1, 2, "D", 3, 3), (2, 1, "E", 1, 1)], "query_id int, rank int, title string, page_from int, page_to int")
    gold = spark.createDataFrame([(1, "D", 3), (1, "D", 2), (2, "D", 1)], "query_id int, document string, page int")
    scored = evaluate.scores(asked, found, gold)
    got = {r.metric: r.value for r in evaluate.retrieval_report(scored).collect()}
    assert got["mrr"] == 0.5 and got["recall@1"] == 0.5 and got["precision@1"] == 0.5 and got["ndcg@10"] == 0.5
    assert [(r.tag, r.recall) for r in evaluate.by_tag(scored).collect()] == [("a", 0.5), ("b", 0.0)] and evaluate.failures(scored).first().query_id == 2
    none = evaluate.retrieval_report(scored.where("unanswerable")).collect()
    assert all(r.value is None for r in none)
    assert "N/A" in evaluate.markdown_report([("dense", "mrr", None)], [], [("search", 1, 2)])


def test_percentiles_differ_as_defined(spark):
    rows = spark.createDataFrame([("s", float(v)) for v in (10, 20, 30, 40)], "stage string, ms double")
    got = evaluate.latency(rows).first()
    assert (got.p50, got.p95, got.mean, got.n) == (30.0, 40.0, 25.0, 4)
    assert rows.groupBy().agg(evaluate.nearest_rank(F.collect_list("ms"), 0.5).alias("x")).first().x == 30.0


def test_comparison(spark):
    run = lambda *rows: spark.createDataFrame(rows, "mode string, metric string, value double")
    got = {r.metric: r.verdict for r in evaluate.compare(run(("m", "a", 0.5), ("m", "b", 0.5), ("m", "c", 0.5)), run(("m", "a", 0.53), ("m", "b", 0.52), ("m", "d", 1.0))).collect()}
    assert got == {"a": "improved", "b": "no difference", "c": "incomparable", "d": "incomparable"}


def test_keys_roles_and_limits(spark):
    keys = governance.parse_keys("a" * 16 + ":reader:hr|it, " + "b" * 16 + ":admin")
    p = governance.authenticate("Bearer " + "a" * 16, keys)
    assert p.visible_groups == ["hr", "it"] and not p.may("editor") and governance.authenticate("b" * 16, keys).visible_groups is None
    assert governance.authenticate("x", keys) is None and governance.authenticate(None, {}).may("admin")
    with pytest.raises(ValueError):
        governance.parse_keys("k:root")
    b = governance.TokenBucket(2)
    assert [b.allow(0.0)[0], b.allow(0.0)[0], b.allow(0.0), b.allow(30.0)[0]] == [True, True, (False, 31), True]
    calls = spark.createDataFrame([("k", 0), ("k", 0), ("k", 0), ("l", 0), ("k", 31)], "key string, at long").withColumn("at", F.col("at").cast("timestamp"))
    assert governance.rate_limit_replay(calls, 2).where("not allowed").count() == 1


def test_windows_as_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i // 5, i % 5), "view" if i % 2 else "click", float(i)) for i in range(20)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    live = streams.windowed_stats(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = live.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, streams.windowed_stats(table).collect()))


def test_live_rate_limit(spark, tmp_path):
    calls = spark.createDataFrame([("k", 0), ("k", 0), ("k", 0), ("l", 0)], "key string, at long").withColumn("at", F.col("at").cast("timestamp"))
    calls.write.parquet(str(tmp_path / "in"))
    live = streams.live_rate_limit(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), 2)
    query = live.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("limits").where("not allowed").count() == 1 and spark.table("limits").count() == 4


def test_context_fits_the_budget(spark):
    rows = spark.createDataFrame([("q", i, 100) for i in range(1, 5)], "query_id string, rank int, n int")
    assert search.within_budget(rows, F.col("n"), 250).count() == 2 and search.within_budget(rows, F.col("n"), 10).count() == 1
    assert Settings().path_weights["exact"] == 1.5
