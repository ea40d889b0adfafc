"""Trigrams of words, padded as ``  word ``, and the similarity of a query to an
extent of a text (the public definition of word similarity)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

_WORD = re.compile(r"\w+")


@lru_cache(1 << 14)
def _in_order(word: str) -> tuple[str, ...]:
    padded = f"  {word} "
    return tuple(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))


def _grams(word: str) -> Sequence[str]:
    """Each trigram of a word once; only those of short words are remembered."""
    return _in_order(word) if len(word) <= 32 else _in_order.__wrapped__(word)


def trigram_set(text: str) -> set[str]:
    return {g for w in _WORD.findall(text.lower()) for g in _grams(w)}


def sequence(text: str) -> list[str]:
    """The trigrams of a text's words one after another."""
    return [g for w in _WORD.findall(text.lower()) for g in _grams(w)]


def extent_similarity(want: set[str], seq: Sequence[str]) -> float:
    """The largest similarity of ``want`` to those of any extent of ``seq``."""
    hits = [i for i, g in enumerate(seq) if g in want]
    best = 0.0
    for a, i in enumerate(hits):
        inside: set[str] = set()
        total: set[str] = set()
        at = i
        for j in hits[a:]:
            total.update(seq[at : j + 1])
            at = j + 1
            inside.add(seq[j])
            best = max(best, len(inside) / (len(want) + len(total) - len(inside)))
            if len(inside) == len(want):
                break
    return best


def word_similarity(query: str, text: str) -> float:
    """The largest similarity of the query's trigrams to those of any extent of
    the text's consecutive trigrams (the public definition)."""
    want = trigram_set(query)
    return extent_similarity(want, sequence(text)) if want else 0.0


def among(wants: list[set[str]], threshold: float) -> Callable[[str], list[tuple[int, float]]]:
    """A function that gives, for a text, (number, similarity) of those of
    ``wants`` that may reach the threshold.  A text must have that part of a
    query's trigrams to get there, so an index of theirs finds them."""
    lists: dict[str, list[int]] = {}
    for q, want in enumerate(wants):
        for g in want:
            lists.setdefault(g, []).append(q)
    index = {g: np.array(qs, np.int32) for g, qs in lists.items()}
    need = np.array([max(1e-9, len(w) * threshold - 1e-6) for w in wants])

    def run(text: str) -> list[tuple[int, float]]:
        seq = sequence(text)
        met = [index[g] for g in set(seq) if g in index]
        if not met:
            return []
        q, got = np.unique(np.concatenate(met), return_counts=True)
        return [(i, extent_similarity(wants[i], seq)) for i in q[got >= need[q]].tolist()]

    return run
