"""The pipeline on a small table: each stage's decisions take effect."""

from __future__ import annotations

import __spark_entry__
import corpus_pipeline
from corvane.llm import decontamination, near_duplicates, quality, toxicity

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "near-duplicates", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = step(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id for r in docs.collect()}
        if name == "benchmark decontamination":
            assert kept == {i for i, t in before.items() if decontamination.brute_force(t, items)[1] == 0}
        if name == "near-duplicates":
            sets = {i: near_duplicates.shingles(t) for i, t in before.items()}
            for i in before.keys() - kept:
                assert any(before[i] == before[k] or near_duplicates.probability_jaccard(sets[i], sets[k]) >= 0.6 for k in kept)
        if name == "quality classifier":
            wrong = [i for i in before if i in labels and (i in kept) != bool(labels[i].quality)]
            assert len(wrong) <= 0.05 * len(labels)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == kept


def test_stages_equal_their_operators(spark):
    """Each stage keeps exactly the rows that its operator's verdicts, taken one by one, let through."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    step = dict(corpus_pipeline.STAGES)
    model = quality.train(docs, labels)
    e = model.evidence([quality.features(r.text) for r in docs.orderBy("doc_id").collect()])
    clear = {i for i, x in zip(sorted(r.doc_id for r in docs.collect()), e, strict=True) if abs(x) > quality.SITE_LIMIT + 0.5 and x > 0}
    kept = {r.doc_id for r in step["quality classifier"](spark, docs, SF).collect()}
    assert clear <= kept and len(kept - clear) < 0.2 * docs.count()
    model = toxicity.train(docs, labels.where("pmod(crc32(cast(doc_id as string)), 3) <> 1"))
    scores = toxicity.Scorer(model).scores([r.text for r in docs.orderBy("doc_id").collect()])
    want = {i for i, x in zip(sorted(r.doc_id for r in docs.collect()), scores, strict=True) if x < toxicity.THRESHOLD}
    assert {r.doc_id for r in step["toxicity"](spark, docs, SF).collect()} == want


def test_stages_of_an_empty_table_and_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30000, None, "s", 1), (3, "a short text of a few words.", "en", None, 1)], DOCUMENTS)
    for docs in (spark.createDataFrame([], DOCUMENTS), odd):
        n = docs.count()
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in DOCUMENTS.split(", ")] and docs.count() <= n
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0) == (docs.count() == 0)
