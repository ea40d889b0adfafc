"""Rows of extracted tables as key-value blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.schemas import PAIR

#: A lone first cell of at least this length is a caption, a shorter one a group label.
CAPTION_CHARS = 60


def cell(value: object) -> str:
    return "" if value is None else " ".join(str(value).split())


def _lone(row: Sequence[str]) -> bool:
    return bool(row[0]) and not any(row[1:])


def header_and_rows(rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """One header line, or two merged: the second fills blanks of the first, and
    each of its labels stands under the nearest label to its left."""
    if not rows:
        return [], []
    top, under = rows[0], rows[1] if len(rows) > 1 else []
    if sum(1 for a, b in zip(top, under, strict=False) if b and not a) < 2:
        return top, rows[1:]
    names, last = [], ""
    for a, b in zip(top, under, strict=False):
        last = a or last
        names.append(last if last == b else f"{last} {b}".strip())
    return names, rows[2:]


def row_blocks(table: list[list[object]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(group label, key-value pairs) of each data row.

    Captions above the table are dropped, short lone labels become the group of
    what follows, and an empty first cell (a cell merged downwards) repeats the
    label above it, also across group labels.  In a table of two columns the
    first is the key; else the header names the keys and ``col{i}`` those
    without a name.  Rows without any value are dropped.
    """
    rows = [r for r in ([cell(c) for c in row] for row in table) if any(r)]
    start = next((i for i, r in enumerate(rows) if not (_lone(r) and len(r[0]) >= CAPTION_CHARS)), len(rows))
    names, data = header_and_rows(rows[start:])
    group = label = ""
    for row in data if names else []:
        if _lone(row) and len(row[0]) < CAPTION_CHARS:
            group = row[0]
            continue
        label = row[0] or label
        full = [label, *row[1:]] if any(row[1:]) else row
        pairs = [(full[0], full[1])] if len(names) == 2 else [(n or f"col{i}", v) for i, (n, v) in enumerate(zip(names, full, strict=False))]
        if any(v for _, v in pairs):
            yield group, pairs


def table_rows(tables: DataFrame) -> DataFrame:
    """Explode raw tables (any columns, with ``rows`` array<array<string>>) into
    one row per data row: their other columns, ``row_no`` from 0, ``grp`` and
    ``pairs``.  Null or empty tables give none."""

    @F.pandas_udf(f"array<struct<grp:string,pairs:array<{PAIR}>>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"grp": g, "pairs": [{"k": k, "v": v} for k, v in p]} for g, p in row_blocks([list(r) for r in t])] if t is not None else [] for t in batch], dtype=object)

    others = [c for c in tables.columns if c != "rows"]
    return tables.select(*others, F.posexplode(parse("rows")).alias("row_no", "row")).select(*others, "row_no", "row.grp", "row.pairs")


def rendered(grp, pairs, unit):
    """A row block's text: ``[group]``, a line for each value, ``(unit)``."""
    lines = F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.concat_ws(": ", p["k"], p["v"]))
    head = F.when(F.coalesce(grp, F.lit("")) != "", F.array(F.concat(F.lit("["), grp, F.lit("]")))).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.coalesce(unit, F.lit("")) != "", F.array(F.concat(F.lit("("), unit, F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines, tail), "\n")
