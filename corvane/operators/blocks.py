"""Transforms of parsed blocks: sections, labels, units, boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def section_map(toc: DataFrame, pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, section) for every page: the as-of join of pages with the
    table of contents ``toc`` (doc, pos, level, title, page).

    Titles of the open levels are joined by `` > ``.  An entry holds from its
    page up to the next entry's; of entries that start on one page the last
    holds.  Pages before the first entry have an empty section.

    An entry's open title of a level is that of the last entry up to it of this
    level or a higher one, if it is of this level: one running value for each
    level there is, few by nature, so no table of contents is gathered.
    """
    upto = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    titles = []
    for n in sorted(r.level for r in toc.select("level").where("level is not null").distinct().collect()):
        last = F.last(F.when(F.col("level") <= n, F.struct("level", "title")), ignorenulls=True).over(upto)
        titles.append(F.when((F.col("level") >= n) & (last["level"] == n), last["title"]))
    entries = toc.select(doc, "pos", "page", F.concat_ws(" > ", *titles).alias("section"))
    marks = entries.groupBy(doc, "page").agg(F.max_by("section", "pos").alias("section"))
    timeline = pages.select(doc, "page", F.lit(None).cast("string").alias("section"), F.lit(1).alias("ask")).unionByName(marks.select(doc, "page", "section", F.lit(0).alias("ask")))
    asof = Window.partitionBy(doc).orderBy("page", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return timeline.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(asof), F.lit(""))).where("ask = 1").select(doc, "page", "section")


def fill_forward(rows: DataFrame, value: str, partition: list[str], order: list[str], only: Column | None = None) -> DataFrame:
    """``value`` filled from the last row before that has one (not null or
    empty); rows where ``only`` is false neither give nor take a value."""
    gives = F.when((F.col(value) != "") & (F.lit(True) if only is None else only), F.col(value))
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(gives, ignorenulls=True).over(before)
    takes = F.lit(True) if only is None else only
    return rows.withColumn(value, F.when(takes, F.coalesce(last, F.col(value))).otherwise(F.col(value)))


def unit_notes(prose: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit): the unit in the first short prose block of a page."""
    found = prose.where(F.length("text") <= 120).withColumn("unit", F.regexp_extract("text", T.UNIT_NOTE, 0)).where(F.col("unit") != "")
    first = found.groupBy(*keys).agg(F.min_by("unit", "pos").alias("unit"))
    return first.withColumn("unit", F.regexp_replace(T.normalise_cell(F.col("unit")), r"^[()]+|[()]+$", ""))


def attach_units(table_rows: DataFrame, prose: DataFrame, keys: list[str]) -> DataFrame:
    return table_rows.drop("unit").join(unit_notes(prose, keys), keys, "left").withColumn("unit", F.coalesce("unit", F.lit("")))


def boilerplate_keys(prose: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", ratio: float = 0.5, least: int = 4, max_chars: int = 160) -> DataFrame:
    """(doc, key, pages): lines that recur, but for digits, on at least half of
    a document's pages and on four; documents of fewer pages have none.  The
    distinct pages are pre-aggregated, so one line on all pages is no hot key."""
    spread = prose.select(F.col(doc).alias("doc"), F.col(page).alias("page"), T.boilerplate_key(F.col(text)).alias("key"), (F.length(text) <= max_chars).alias("short"))
    pages = spread.select("doc", "page").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    keys = spread.where("short and key <> ''").select("doc", "page", "key").distinct().groupBy("doc", "key").agg(F.count(F.lit(1)).alias("pages"))
    return keys.join(pages, "doc").where(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("n") * ratio))).select("doc", "key", "pages")


def drop_boilerplate(prose: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    keys = boilerplate_keys(prose, doc, page, text).select(F.col("doc").alias("__d"), F.col("key").alias("__k"))
    return prose.join(keys, (F.col(doc) == F.col("__d")) & (T.boilerplate_key(F.col(text)) == F.col("__k")), "left_anti")


def clean_prose(prose: DataFrame, text: str = "text") -> DataFrame:
    """Blocks with runs of blanks collapsed, without empty or all-digit ones."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \t]+", " "))
    return prose.withColumn(text, squeezed).where((F.col(text) != "") & ~F.col(text).rlike(r"(?U)^\d+$"))


def scanned(blocks: DataFrame, doc: str = "doc", text: str = "text", pages: str = "page_count", least: int = 120) -> DataFrame:
    """(doc, chars, needs_review): fewer characters a page than a text has."""
    sums = blocks.groupBy(doc).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"), F.max(pages).alias("pages"))
    return sums.select(doc, "chars", (F.col("chars") / F.greatest("pages", F.lit(1)) < least).alias("needs_review"))
