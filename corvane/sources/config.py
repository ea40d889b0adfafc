"""Small files that steer the engine: glossaries, gold questions, results."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.analyze import Glossary
from corvane.schemas import QUESTIONS


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_glossary(path: str) -> Glossary:
    """From YAML or JSON; a missing file is an empty glossary."""
    if not os.path.exists(path):
        return Glossary()
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return Glossary.of(json.load(f))
    return Glossary.of(_yaml(path))


def gold_questions(raw: dict) -> list[tuple]:
    """Rows of QUESTIONS; unknown keys are ignored.  Errors: an id twice, an
    empty question, an answerable one without answers."""
    rows, seen = [], set()
    for i, q in enumerate(raw.get("questions") or [], 1):
        name, asked = str(q.get("id") or f"q{i:03d}"), str(q.get("question") or "").strip()
        if name in seen:
            raise ValueError(f"question id {name!r} occurs twice")
        if not asked:
            raise ValueError(f"question {name!r} is empty")
        answers = [(str(a["document"]), [int(p) for p in a.get("pages") or []]) for a in q.get("answers") or []]
        trap = bool(q.get("unanswerable"))
        if not trap and not answers:
            raise ValueError(f"question {name!r} has no answers")
        seen.add(name)
        rows.append((name, asked, answers, q.get("expect"), trap, [str(t) for t in q.get("tags") or []]))
    return rows


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(gold_questions(_yaml(path)), QUESTIONS)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation payloads written as JSON."""
    return spark.read.json(path, multiLine=True)
