"""Operators for training-data pipelines.  Nothing outside imports this."""

from __future__ import annotations


def load_queries() -> dict:
    from corvane.llm import registry

    return dict(registry.QUERIES)


def load_oracles() -> dict:
    from corvane.llm import registry

    return dict(registry.ORACLES)
