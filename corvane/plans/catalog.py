"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

import functools

from corvane.plans import analytics, ingestion, retrieval
from corvane.session import let_workers_import


def _ready(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        let_workers_import(spark)
        return query(spark, sf_dir)

    return run


_PLANS = (retrieval, ingestion, analytics)
QUERIES: dict = {name: _ready(q) for plan in _PLANS for name, q in plan.QUERIES.items()}
ORACLES: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
