"""Text functions, analysis, providers: expected values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import analyze as A
from corvane.functions import embedding as E
from corvane.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_products_need_a_word_boundary_of_any_script(spark):
    assert one(spark, T.products_in(F.col("t")), t="SR650a V4, SR650  V3 and SR650a V4") == ["ThinkSystem SR650a V4", "ThinkSystem SR650 V3"]
    assert one(spark, T.products_in(F.col("t")), t="SR650 V4는") == []


def test_narrowing_keeps_all_unless_exactly_one_fits(spark):
    both = ["ThinkSystem SR650 V4", "ThinkSystem SR630 V4"]
    assert one(spark, T.narrow_products(F.col("t"), F.col("c")), t="the SR630 only", c=both) == both[1:]
    assert one(spark, T.narrow_products(F.col("t"), F.col("c")), t="none", c=both) == both
    quirk = ["ThinkSystem SR650 V4", "ThinkSystem SR650a V4"]
    assert one(spark, T.narrow_products(F.col("t"), F.col("c")), t="SR650a here", c=quirk) == quirk


def test_token_estimate_rounds_half_to_even(spark):
    assert [one(spark, T.token_estimate(F.col("t")), t="a" * n) for n in (0, 6, 10, 14)] == [1, 2, 2, 4]
    assert one(spark, T.token_estimate(F.col("t")), t="가나다") == 2


def test_identifiers(spark):
    got = one(spark, T.identifiers(F.col("t")), t="DDR5-5600 of 4 TB, part 4X97B17362")
    assert got == A.identifiers("DDR5-5600 of 4 TB, part 4X97B17362")
    assert {"DDR5-5600", "4 TB", "4TB", "4X97B17362"} <= set(got)


def test_particles_agree_with_the_plain_version(spark):
    for word in ("서버인가요", "메모리는", "용량의", "매출액", "가", "으로", "전력은", "드라이브에서의"):
        assert one(spark, T.strip_particles(F.col("t")), t=word) == A.strip_particles(word)
    assert A.strip_particles("서버인가요") == "서버" and A.strip_particles("가") == "가"


def test_grounding(spark):
    check = lambda a, e: one(spark, T.unsupported(F.col("a"), F.col("e")), a=a, e=e)
    assert check("It is 8TB [1]", ["Up to 8 TB"]) == []
    assert check("It is 4TB [1][2]", ["Up to 8TB"]) == ["4TB"]
    assert check("Part 4X97B17362", ["nothing"]) == ["4X97B17362"]
    assert check("It is 4TB", []) == ["4TB"]


def test_citations(spark):
    cited = lambda a, n: one(spark, T.cited(F.col("a"), F.lit(n)), a=a)
    assert cited("yes [2] and [1] [2]", 3) == [1, 2]
    assert cited("yes [99]", 3) is None and cited("none", 3) is None and cited("[99999999999999999999]", 3) is None


def test_analysis():
    a = A.analyze("SR650a V4 최대 메모리 용량은?")
    assert a.products == ["ThinkSystem SR650a V4"] and {"memory", "maximum"} <= set(a.terms) and "SR650a" in a.identifiers and a.intent == "spec"
    assert A.classify("SR650 V4와 SR630 V4 차이", ["a", "b"]) == "comparison" and A.classify("설치 방법", []) == "procedure" and A.classify("소개", []) == "general"
    assert "X97B17362" not in A.analyze("4X97B17362 DDR5-5600 4TB").terms
    g = A.Glossary.of({"terms": {"매출액": "revenue", "매출": "sales"}})
    assert g.decompose("총매출액") == "매출액" and g.decompose("연매출") == "매출" and g.decompose("매출액") is None
    assert not {"server", "lenovo", "무엇"} & set(A.analyze("lenovo server 무엇 rack").terms)


def test_what_each_path_looks_for(spark):
    rows = [("SR650 V4 memory 4X97B17362", ["SR650", "V4", "memory", "power supply"], ["SR650", "4X97B17362"], ["ThinkSystem SR650 V4"]), ("SR650 V4?", ["SR650", "V4"], ["SR650"], ["ThinkSystem SR650 V4"]), ("메모리 용량", ["memory", "메모리", "용량"], [], []), ("?", [], [], [])]
    frame = spark.createDataFrame(rows, "q string, terms array<string>, ids array<string>, products array<string>")
    looked = A.sparse_terms(F.col("terms"), F.col("products"), F.size("products") > 0)
    got = frame.select(looked.alias("s"), A.beside_model(F.col("ids"), F.col("products")).alias("e"), A.trigram_text(F.col("q"), F.col("terms")).alias("t"), A.websearch(looked, " OR ").alias("w")).collect()
    assert [r.s for r in got] == [["memory", "power supply"], ["SR650", "V4"], ["memory", "메모리", "용량"], []]
    assert [r.e for r in got] == [["4X97B17362"], [], [], []]
    assert [r.t for r in got] == ["SR650 V4 memory power supply", "SR650 V4", "메모리 용량", "?"]
    assert got[0].w == 'memory OR "power supply"'


def test_analysis_batch_equals_plain(spark):
    said = ["메모리 용량은?", "", "SR650 V4 vs SR630 V4"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, q string").select("i", A.analyzed(F.col("q")).alias("a")).collect()
    for r in rows:
        assert r.a.terms == A.analyze(said[r.i]).terms and r.a.intent == A.analyze(said[r.i]).intent


def test_key_text_and_citation(spark):
    assert one(spark, T.key_text(F.col("t")), t="Memory: 8\nno key\n" + "x" * 81 + ": y") == "memory"
    cite = lambda p, a, b: one(spark, T.citation(F.lit("G"), F.lit(p), F.lit(a), F.lit(b), F.lit("S")))
    assert cite("g.pdf", 0, 0) == "G · S" and cite("g.pdf", 2, 2) == "G p2" and cite("g.PPTX", 2, 3) == "G 슬라이드 2-3"


def test_hash_embedder():
    v = E.HashEmbedder(32).embed(["Memory 메모리 8", "", "memory 메모리 8"])
    assert v[0] == v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and not any(v[1])
    with pytest.raises(ValueError):
        E.checked(v, ["a", "b", "c"], 32)
    with pytest.raises(ValueError):
        E.embedder("other", 3)


def test_retries_and_circuit_breaker():
    now, calls = [0.0], []

    def fails(*_):
        calls.append(now[0])
        raise ConnectionError("down")

    g = E.Guarded(fails, threshold=2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(2):
        with pytest.raises(E.Unavailable):
            g()
    assert len(calls) == 6
    with pytest.raises(E.Unavailable, match="circuit"):
        g()
    assert len(calls) == 6
    now[0] += 31
    with pytest.raises(E.Unavailable, match="down"):
        g()
    assert len(calls) == 9


def test_echo_generator_cites_only_passages():
    assert E.EchoGenerator().generate("", "[1] a\nb\n\n[2] c\n\nq").endswith("[1]") and E.EchoGenerator().generate("", "q") == T.NOT_FOUND
