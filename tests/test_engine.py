"""The whole surface over a small directory."""

from __future__ import annotations

import pytest

from corvane import schemas
from corvane.engine import Denied, Engine, Limited, not_found
from corvane.operators.governance import Principal
from corvane.settings import Settings
from tests.test_ingest import docx

ADMIN, READER, HR = Principal("a", "admin"), Principal("r", "reader"), Principal("h", "reader", ("hr",))


def test_engine(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "SR650 V4 Guide.docx").write_bytes(docx("#Memory", "Memory maximum: 8TB in all", "#Body", "Weight: 42 kg"))
    e = Engine(spark, str(tmp_path / "store"), Settings(embedding_dim=64, rate_limit_per_min=600))
    with pytest.raises(Denied):
        e.ingest(READER, str(root))
    job = e.ingest(ADMIN, str(root), ["hr"])
    assert e.jobs(ADMIN, job).first().stats == {"indexed": 1}
    assert e.documents(READER).count() == 0 and e.documents(HR).first().chunks == 4
    reply = e.ask(HR, "SR650 V4 memory maximum?")
    assert reply["answered"] and reply["sources"][0]["chunk_id"] and not not_found(reply) and not_found(e.ask(READER, "memory maximum?"))
    assert e.feedback(HR, reply["id"], -1) and not e.feedback(HR, "none", 1)
    assert e.queries(ADMIN, failed=True).count() == 2 and e.stats(ADMIN).first().total == 2
    assert [x["type"] for x in e.ask_stream(HR, "weight?")][-1] == "done" and e.ask(HR, "hi", use_documents=False)["sources"] == []
    for bad in (lambda: e.ask(HR, " "), lambda: e.ask(HR, "x", top_k=99), lambda: e.feedback(HR, reply["id"], 5), lambda: Engine(spark, "x", Settings(search_candidates=1))):
        with pytest.raises(ValueError):
            bad()
    gold = spark.createDataFrame([("q1", "memory maximum", [("SR650 V4 Guide", [])], None, False, ["t"]), ("q2", "nothing", [], None, True, [])], schemas.QUESTIONS)
    got = {(r.mode, r.metric): r.value for r in e.evaluate(gold, ["sparse", "hybrid+rerank"]).collect()}
    assert got["sparse", "recall@1"] == 1.0 and got["hybrid+rerank", "recall@10"] == 1.0
    told = e.evaluate(gold, ["hybrid+rerank"], answers=True, baseline=True).persist()
    worth = {(r.mode, r.metric): r.value for r in told.collect()}
    assert worth["hybrid+rerank", "citation_precision"] == 1.0 and worth["hybrid+rerank", "grounded_rate"] == 1.0 and worth["no-retrieval", "honesty"] == 1.0
    assert ("no-retrieval", "mrr") not in worth and worth["no-retrieval", "citation_precision"] is None
    run = e.save_run(told, "first")
    assert run["modes"]["hybrid+rerank"]["recall@1"] == 1.0 and run["baseline"]["honesty"] == 1.0 and len(list((tmp_path / "store" / "results").glob("*-first.json"))) == 1
    (root / "new.docx").write_bytes(docx("more text"))
    assert e.jobs(ADMIN, e.sync(ADMIN, str(root))).first().stats == {"unchanged": 1, "new": 1}
    (root / "new.docx").unlink()
    assert e.jobs(ADMIN, e.sync(ADMIN, str(root), delete_missing=True)).first().stats == {"unchanged": 1, "missing": 1}
    assert e.documents(ADMIN).count() == 1 and e.delete(ADMIN, e.documents(ADMIN).first().id) and e.documents(ADMIN).count() == 0
    assert "ask_ms_count" in e.metrics.render() and e.health()["status"] == "ok" and e.ready()["missing"] == []
    slow = Engine(spark, str(tmp_path / "store"), Settings(embedding_dim=64, rate_limit_per_min=1))
    slow.documents(READER)
    with pytest.raises(Limited):
        slow.documents(READER)
