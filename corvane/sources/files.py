"""Documents from files: directory scans, Office formats by their XML, PDF by
an optional library.  Files are read by Spark's ``binaryFile`` source, so any
file system it knows will do."""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.analyze import products
from corvane.operators.tables import row_blocks

FORMATS = (".pdf", ".docx", ".xlsx", ".pptx")
PARSED = (
    "path string, title string, products array<string>, sha256 string, page_count int, error string, pos int, kind string, text string, "
    "pairs array<struct<k:string,v:string>>, page int, section_path string, grp string, unit string"
)
# ---- Fixed values: words in sections of Office files. ----
BODY, COLUMN, TABLE, ROW, PARAGRAPH, SLIDE, TABLE_ROW = "본문", "열", "표 블록", "행", "문단", "슬라이드", "표 행"
# ---- End of fixed values. ----
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, size, mtime[, content, sha256]) of all supported files under a
    directory, or of one file.  Without ``content`` no file is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*FORMATS))
    base = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content", F.sha2("content", 256).alias("sha256")] if content else []))
    return base


def expand_paths(patterns: list[str]) -> list[str]:
    """Local files of patterns and directories, in order, each once; an error
    if a pattern matches nothing."""
    out: dict[str, None] = {}
    for p in patterns:
        found = sorted(glob.glob(p, recursive=True))
        found = [f for x in found for f in (sorted(glob.glob(os.path.join(glob.escape(x), "**"), recursive=True)) if os.path.isdir(x) else [x])]
        files = [f for f in found if os.path.isfile(f) and f.lower().endswith(FORMATS)]
        if not files:
            raise FileNotFoundError(f"nothing matches {p!r}")
        out.update(dict.fromkeys(files))
    return list(out)


def _title(z: zipfile.ZipFile, stem: str) -> str:
    if "docProps/core.xml" in z.namelist():
        found = ElementTree.fromstring(z.read("docProps/core.xml")).find("{http://purl.org/dc/elements/1.1/}title")
        if found is not None and (found.text or "").strip():
            return found.text
    return stem


def _prose(text: str, page: int, section: str) -> tuple:
    return "prose", text, [], page, section, "", ""


def _row(pairs: list[tuple[str, str]], page: int, section: str, group: str = "", unit: str = "") -> tuple:
    return "table_row", "", [{"k": k, "v": v} for k, v in pairs], page, section, group, unit


def parse_docx(content: bytes, stem: str) -> tuple[str, int, list[tuple]]:
    """Paragraphs and table rows in order; headings name the section."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        title = _title(z, stem)
    text = lambda e: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    section, out, i = BODY, [], 0
    for item in body if body is not None else ():
        if item.tag == f"{_W}tbl":
            i += 1
            for r, row in enumerate(item.iter(f"{_W}tr"), 1):
                cells = ["\n".join(text(p) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc")]
                out.append(_row([(f"{COLUMN} {c}", t) for c, t in enumerate(cells, 1)], 0, f"{section} > {TABLE} {i}, {ROW} {r}"))
        elif item.tag == f"{_W}p":
            i += 1
            if (said := text(item)).strip():
                style = item.find(f"{_W}pPr/{_W}pStyle")
                style_id = style.get(f"{_W}val") if style is not None else ""
                if (names.get(style_id) or style_id).lower().startswith("heading"):
                    section = said.strip()
                out.append(_prose(said, 0, f"{section} > {PARAGRAPH} {i}"))
    return title, 0, out


def parse_xlsx(content: bytes, stem: str) -> tuple[str, int, list[tuple]]:
    """Each row with a value as (coordinate, value) pairs; formulas as such."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[sheet.get(f"{_R}id")]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for r, row in enumerate(root.iter(f"{_S}row"), 1):
                pairs = []
                for c in row.findall(f"{_S}c"):
                    value, formula, inline = c.find(f"{_S}v"), c.find(f"{_S}f"), c.find(f"{_S}is")
                    if formula is not None and formula.text:
                        said = f"={formula.text}"
                    elif inline is not None:
                        said = "".join(t.text or "" for t in inline.iter(f"{_S}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        said = shared[int(value.text)] if c.get("t") == "s" else {"1": "True", "0": "False"}[value.text] if c.get("t") == "b" else value.text
                    pairs.append((c.get("r"), said))
                if pairs:
                    out.append(_row(pairs, 0, f"{sheet.get('name')} > {ROW} {row.get('r') or r}"))
        title = _title(z, stem)
    return title, 0, out


def parse_pptx(content: bytes, stem: str) -> tuple[str, int, list[tuple]]:
    """Slides are pages: text frames as prose, table rows as row blocks."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        slides = [targets[s.get(f"{_R}id")] for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
        said = lambda e: "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in e.iter(f"{_A}p"))
        for i, target in enumerate(slides, 1):
            tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"ppt/{target}")).find(f"{_P}cSld/{_P}spTree")
            for shape in tree if tree is not None else ():
                frame = shape.find(f"{_P}txBody")
                if frame is not None and said(frame).strip():
                    out.append(_prose(said(frame), i, f"{SLIDE} {i}"))
                for table in shape.iter(f"{_A}tbl"):
                    for r, row in enumerate(table.findall(f"{_A}tr"), 1):
                        out.append(_row([(f"{COLUMN} {c}", said(cell)) for c, cell in enumerate(row.findall(f"{_A}tc"), 1)], i, f"{SLIDE} {i} > {TABLE_ROW} {r}"))
        return _title(z, stem), len(slides), out


def parse_pdf(content: bytes, stem: str) -> tuple[str, int, list[tuple]]:
    """Pages' tables, then their prose outside of tables; needs PyMuPDF."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package PyMuPDF") from e
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        marks, out = {}, []
        trail: list[str] = []
        for level, name, page in pdf.get_toc():
            trail[level - 1 :] = [name]
            marks[page] = " > ".join(trail)
        section = ""
        for n, page in enumerate(pdf, 1):
            section = marks.get(n, section)
            tables = list(page.find_tables())
            blocks = [b for b in page.get_text("blocks") if not any(pymupdf.Rect(b[:4]).intersects(t.bbox) for t in tables)]
            texts = [t for t in (re.sub(r"[ \t]+", " ", b[4]).strip() for b in blocks) if t and not t.isdigit()]
            for t in tables:
                out += [_row(pairs, n, section, group) for group, pairs in row_blocks(t.extract())]
            out += [_prose(t, n, section) for t in texts]
        return (pdf.metadata or {}).get("title") or stem, len(pdf), out


PARSERS = {".pdf": parse_pdf, ".docx": parse_docx, ".xlsx": parse_xlsx, ".pptx": parse_pptx}


def parse_file(path: str, content: bytes) -> tuple[str, int, list[tuple]]:
    """(title, pages, blocks) by the lower-cased suffix."""
    stem, suffix = os.path.splitext(os.path.basename(path))
    if suffix.lower() not in PARSERS:
        raise ValueError(f"unsupported format {suffix!r}")
    return PARSERS[suffix.lower()](content, stem)


def parse(files: DataFrame) -> DataFrame:
    """PARSED: one row per block of every file of ``scan``; a file that cannot
    be read has one row with its error, so others are not held up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in re.sub(r"<[^ ]*>", "", PARSED).split(", ")]
        for b in batches:
            for path, content, sha in zip(b["path"], b["content"], b["sha256"], strict=True):
                try:
                    title, pages, blocks = parse_file(path, content)
                    rows = [(path, title, products(title), sha, pages, None, i, *x) for i, x in enumerate(blocks)]
                    rows = rows or [(path, title, products(title), sha, pages, "no content", None, *[None] * 7)]
                except Exception as e:
                    rows = [(path, None, [], sha, 0, str(e)[:2000], None, *[None] * 7)]
                yield pd.DataFrame(rows, columns=names).astype({"pos": "Int32", "page": "Int32"})

    return files.select("path", "content", "sha256").mapInPandas(run, PARSED)
