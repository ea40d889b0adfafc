"""Tables, blocks, chunks, files, store and sync."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.embedding import HashEmbedder
from corvane.operators import blocks as B
from corvane.operators import chunking, drafting, ingest, sync, tables
from corvane.settings import Settings, from_env, problems
from corvane.sources import config, files
from corvane.sources.store import Store


def test_two_header_lines_are_merged():
    head, data = tables.header_and_rows([["Name", "Accelerators", "", ""], ["", "QAT", "DLB", "DSA"], ["x", "1", "2", "3"]])
    assert head == ["Name", "Accelerators QAT", "Accelerators DLB", "Accelerators DSA"] and data == [["x", "1", "2", "3"]]


def test_vertical_merge_group_and_caption():
    got = list(tables.row_blocks([["c" * 60, "", ""], ["Kind", "Item", ""], ["sales", "build", "1"], ["", "outside", "2"], ["Part two", "", ""], [None, "total", "3"], ["", "", ""]]))
    assert [p[0] for _, p in got] == [("Kind", "sales")] * 3 and [g for g, _ in got] == ["", "", "Part two"]
    assert got[0][1][2] == ("col2", "1")


def test_two_columns_are_keys_and_values(spark):
    rows = spark.createDataFrame([(1, [["Feature", "Value"], ["Memory", "8 TB"], ["Only key", ""]]), (2, []), (3, None)], "page int, rows array<array<string>>")
    got = tables.table_rows(rows).select("page", tables.rendered(F.col("grp"), F.col("pairs"), F.lit("GB")).alias("t")).collect()
    assert [(r.page, r.t) for r in got] == [(1, "Memory: 8 TB\n(GB)")]


def test_section_map_closes_levels_and_prefers_the_last(spark):
    toc = spark.createDataFrame([("d", 0, 1, "A", 2), ("d", 1, 2, "B", 2), ("d", 2, 2, "C", 4), ("d", 3, 1, "D", 6)], "doc string, pos int, level int, title string, page int")
    pages = spark.createDataFrame([("d", i) for i in range(1, 8)], "doc string, page int")
    got = {r.page: r.section for r in B.section_map(toc, pages).collect()}
    assert got == {1: "", 2: "A > B", 3: "A > B", 4: "A > C", 5: "A > C", 6: "D", 7: "D"}


def test_boilerplate(spark):
    rows = [("d", p, f"Page {p} of 10") for p in range(10)] + [("d", 3, "body")] + [("short", p, "foot") for p in range(3)]
    prose = spark.createDataFrame(rows, "doc string, page int, text string")
    assert [(r.doc, r.key, r.pages) for r in B.boilerplate_keys(prose).collect()] == [("d", "Page # of #", 10)]
    assert B.drop_boilerplate(prose).count() == 4


def test_unit_note_is_attached(spark):
    prose = spark.createDataFrame([("d", 1, 5, "late (Unit: GB)"), ("d", 1, 2, "table (단위: 천원) below"), ("d", 2, 0, "x" * 121 + "(Unit: W)")], "doc string, page int, pos int, text string")
    rows = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    assert {(r.page, r.unit) for r in B.attach_units(rows, prose, ["doc", "page"]).collect()} == {(1, "단위: 천원"), (2, "")}


def test_long_prose_windows(spark):
    df = chunking.split_long(spark.createDataFrame([(1, "x" * 10000), (2, "y" * 1200), (3, "")], "i int, text string"), 1200, 200)
    got = {}
    for r in df.collect():
        got.setdefault(r.i, []).append((r.part, len(r.text)))
    assert sorted(got[1]) == [(i, 1200) for i in range(9)] + [(9, 1000)] and got[2] == [(0, 1200)] and got[3] == [(0, 0)]


def reference_chunks(blocks, target, overlap):
    """Written apart from the operator: buffer indices instead of blocks."""
    out, start, i = [], 0, 0
    while i < len(blocks):
        kind, _, section, _ = blocks[i]
        if kind == "table_row":
            out.append([start, i]) if i > start else None
            out.append((i,))
            start = i + 1
        else:
            if i > start and blocks[i - 1][2] != section:
                out.append([start, i])
                start = i
            if sum(len(b[1]) for b in blocks[start : i + 1]) >= target:
                out.append([start, i + 1])
                start = i if len(blocks[i][1]) <= overlap else i + 1
        i += 1
    if start < len(blocks):
        out.append([start, len(blocks)])
    return [("table_row", blocks[x[0]][1]) if isinstance(x, tuple) else ("prose", "\n".join(b[1] for b in blocks[x[0] : x[1]])) for x in out]


def test_accumulation_carries_and_repeats_the_tail():
    import random

    rng = random.Random(3)
    for _ in range(300):
        blocks = [("table_row" if rng.random() < 0.15 else "prose", "ab" * rng.randint(0, 30), rng.choice("ST"), 1) for _ in range(rng.randint(0, 12))]
        assert [c[:2] for c in chunking.accumulate(iter(blocks), 60, 20)] == reference_chunks(blocks, 60, 20)
    tail = [("prose", "a" * 50, "S", 1), ("prose", "b" * 10, "S", 2)]
    assert [c[1] for c in chunking.accumulate(iter(tail), 60, 20)] == ["a" * 50 + "\n" + "b" * 10, "b" * 10]


def test_chunks_of_documents(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "prose", "SR650 here", None, None, None, 1, "S"), (1, 1, "table_row", None, [("Memory", "8TB"), ("x", "")], "G", "GB", 2, "S"), (2, 0, "prose", None, None, None, None, None, None)],
        "doc long, pos int, kind string, text string, pairs array<struct<k:string,v:string>>, grp string, unit string, page int, section_path string",
    )
    docs = spark.createDataFrame([(1, "Guide", ["ThinkSystem SR650 V4", "ThinkSystem SR630 V4"]), (2, "Other", [])], "doc long, title string, products array<string>")
    got = chunking.chunk(blocks, docs).orderBy("document_id", "ordinal").collect()
    assert [c.content for c in got] == ["ThinkSystem SR650 V4 > S\nSR650 here", "ThinkSystem SR650 V4 / ThinkSystem SR630 V4 > S\n[G]\nMemory: 8TB\n(GB)", "Other\n"]
    with pytest.raises(ValueError):
        chunking.chunk(blocks, docs, Settings(chunk_overlap_chars=1200))


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs: str, table=()) -> bytes:
    out = io.BytesIO()
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table)
    body = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=%sHeading1%s/></w:pPr>" % (chr(34), chr(34)) if p.startswith("#") else ""}<w:r><w:t>{p.lstrip("#")}</w:t></w:r></w:p>' for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}{"<w:tbl>" + rows + "</w:tbl>" if rows else ""}</w:body></w:document>')
    return out.getvalue()


def test_docx_blocks():
    title, pages, blocks = files.parse_file("a/Guide.DOCX", docx("#Intro", "hello", table=[["k", "v"]]))
    assert title == "Guide" and pages == 0 and [b[4] for b in blocks] == ["Intro > 문단 1", "Intro > 문단 2", "Intro > 표 블록 3, 행 1"]
    assert blocks[2][2] == [{"k": "열 1", "v": "k"}, {"k": "열 2", "v": "v"}]
    with pytest.raises(ValueError):
        files.parse_file("x.txt", b"")


def test_xlsx_and_pptx_blocks():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="예산" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="B1"><v>100000</v></c><c r="C1"><f>A1+1</f></c></row><row r="2"><c r="A2"/></row></sheetData></worksheet>')
    _, _, blocks = files.parse_file("b.xlsx", out.getvalue())
    assert len(blocks) == 1 and blocks[0][4] == "예산 > 행 1" and {"k": "B1", "v": "100000"} in blocks[0][2] and {"k": "C1", "v": "=A1+1"} in blocks[0][2]
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="r1" Target="slides/s.xml"/></Relationships>')
        z.writestr("ppt/slides/s.xml", f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>hi</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>')
    _, pages, blocks = files.parse_file("c.pptx", out.getvalue())
    assert pages == 1 and blocks[0][1] == "hi" and blocks[0][3] == 1


def test_ingest_skip_fail_and_delete(spark, tmp_path):
    root, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    root.mkdir()
    (root / "a.docx").write_bytes(docx("hello world"))
    (root / "b.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in ingest.ingest(store, str(root), HashEmbedder(16)).collect()}
    assert (got["a.docx"].status, got["a.docx"].chunks) == ("indexed", 1) and got["b.docx"].status == "failed" and got["b.docx"].error
    assert ingest.ingest(store, str(root), HashEmbedder(16)).where("status = 'indexed'").count() == 0

    class Broken(HashEmbedder):
        def embed(self, texts):
            raise RuntimeError("no")

    got = {r.path.rsplit("/", 1)[1]: r for r in ingest.ingest(store, str(root), Broken(16), force=True).collect()}
    assert (got["a.docx"].status, got["a.docx"].error) == ("failed", "embedding failed")
    docs = store.read("documents", schemas.DOCUMENTS).where("status = 'indexed'").collect()
    assert [d.error for d in docs] == ["embedding failed"] and store.read("chunks", schemas.CHUNKS).where("embedding is not null").count() == 1
    (root / "a.docx").write_bytes(docx("hello again"))
    ingest.ingest(store, str(root), HashEmbedder(16), supersede=True)
    docs = store.read("documents", schemas.DOCUMENTS).where("status = 'indexed'").collect()
    assert len(docs) == 1 and store.read("chunks", schemas.CHUNKS).count() == 1
    assert ingest.delete_document(store, docs[0].id) and not ingest.delete_document(store, docs[0].id)
    assert store.read("chunks", schemas.CHUNKS).count() == 0 and store.version("documents") == schemas.VERSION
    store.vacuum("documents")
    assert store.read("documents", schemas.DOCUMENTS).where("status = 'indexed'").count() == 0


def test_readers_see_all_tables_of_a_change_or_none(spark, tmp_path, monkeypatch):
    store, rows = Store(spark, str(tmp_path / "s")), lambda n: spark.range(n).select("id")
    read = lambda t: store.read(t, "id long").count()
    assert read("a") == 0
    store.replace_all({"a": rows(1), "b": rows(2)})
    kept = Store(spark, store.root).read("a", "id long")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda fresh: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            store.replace_all({"a": rows(3), "b": rows(4)})
    assert (read("a"), read("b"), kept.count()) == (1, 2, 1)
    # Somebody else commits between our look and our rename: theirs stays, ours comes on top.
    look, other = store._manifest, Store(spark, store.root)
    turns = iter([lambda: other.replace("b", rows(7))])
    monkeypatch.setattr(store, "_manifest", lambda: (look(), next(turns, lambda: None)())[0])
    store.replace("a", rows(5))
    monkeypatch.undo()
    assert (read("a"), read("b"), kept.count()) == (5, 7, 1)
    store.vacuum("a")
    assert (read("a"), read("b")) == (5, 7)


def test_equal_files_are_indexed_once_by_the_least_path(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.docx").write_bytes(docx("same words here"))
    done = ingest.ingest(Store(spark, str(tmp_path / "s")), str(tmp_path), HashEmbedder(16)).collect()
    assert [os.path.basename(r.path) for r in done] == ["a.docx"] and done[0].status == "indexed"


def test_jobs(spark, tmp_path):
    jobs = ingest.Jobs(Store(spark, str(tmp_path)))
    good, bad = jobs.run("sync", lambda: {"new": 2}), jobs.run("sync", lambda: 1 / 0)
    got = {r.id: r for r in jobs.list().collect()}
    assert got[good].status == "done" and got[good].stats == {"new": 2} and got[bad].status == "failed" and "zero" in got[bad].detail


def test_sync_plan(spark):
    known = spark.createDataFrame(
        [(1, "/r/a", "h1", "indexed", 10, 100), (2, "/r/b", "h2", "indexed", 10, 100), (3, "/r/c", "h3", "failed", 10, 100), (4, "/r/gone", "h4", "indexed", 1, 1), (5, "/r/old", "h5", "indexed", 1, 1)],
        "id long, source_path string, sha256 string, status string, byte_size long, source_mtime long",
    ).withColumn("source_mtime", F.col("source_mtime").cast("timestamp"))
    seen = spark.createDataFrame([("/r/a", 10, 102, None), ("/r/b", 11, 100, "x"), ("/r/c", 10, 100, "h3"), ("/r/new", 1, 1, "y"), ("/r/moved", 1, 1, "h5")], "path string, size long, mtime long, sha256 string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    assert {r.path: r.action for r in sync.plan(seen, known, "/r/").collect()} == {"/r/a": "unchanged", "/r/b": "changed", "/r/c": "changed", "/r/new": "new", "/r/moved": "moved", "/r/gone": "missing"}


def test_gold_and_glossary(tmp_path):
    rows = config.gold_questions({"questions": [{"question": "q", "answers": [{"document": "d", "pages": [1]}], "other": 1}, {"id": "x", "question": "t", "unanswerable": True}]})
    assert rows[0][0] == "q001" and rows[1][4] is True
    for bad in ([{"id": "a", "question": "q", "unanswerable": True}] * 2, [{"question": " "}], [{"question": "q"}]):
        with pytest.raises(ValueError):
            config.gold_questions({"questions": bad})
    assert not config.read_glossary(str(tmp_path / "none.yaml")).terms
    (tmp_path / "g.json").write_text('{"terms": {"a": "b c"}, "synonyms": {"CPU": ["x"]}}')
    g = config.read_glossary(str(tmp_path / "g.json"))
    assert g.terms == {"a": ["b", "c"]} and g.synonyms == {"cpu": ["x"]}


def test_settings():
    assert from_env({"SEARCH_TOP_K": "5", "QUERY_EXPANSION": "false"}).search_top_k == 5 and Settings().context_chars == 14449
    assert problems(Settings())[0] == [] and len(problems(Settings(chunk_overlap_chars=1200, search_candidates=1, grounding_mode="x"))[0]) == 3
    assert schemas.missing_versions(1) == [2, 3]


def test_draft_questions(spark):
    rows = spark.createDataFrame([("d", 1, "Memory", "Max memory", "8 TB"), ("d", 2, "Memory", "Slots", "32"), ("d", 3, "X", "4X97", "12 GB"), ("e", 1, "specification", "Weight", "42 kg")], "document string, page int, section string, key string, value string")
    got = drafting.pick(drafting.candidates(rows), 2, 1).collect()
    assert [(r.document, r.key, r.score) for r in got] == [("d", "Max memory", 11), ("e", "Weight", 14)]


def test_expand_paths(tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"")
    assert [p.rsplit("/", 1)[1] for p in files.expand_paths([str(tmp_path), str(tmp_path / "*.PDF")])] == ["a.PDF"]
    with pytest.raises(FileNotFoundError):
        files.expand_paths([str(tmp_path / "*.docx")])
