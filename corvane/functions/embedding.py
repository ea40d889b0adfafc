"""Embedding and text providers: protocols, a deterministic hash embedder, an
echoing generator, and the registry; vectors as column expressions."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import NOT_FOUND, WORDS


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    name: str

    def generate(self, system: str, prompt: str) -> str: ...


class HashEmbedder:
    """Signed feature hashing of words, scaled to length 1 (0 stays 0)."""

    name = "hash"

    def __init__(self, dim: int = 1024):
        self.dim, self._words = dim, re.compile(WORDS)

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for w in self._words.findall(text.lower()):
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "big") % self.dim] += 1.0 if d[4] & 1 else -1.0
        return (v / (np.linalg.norm(v) or 1.0)).tolist()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]


class EchoGenerator:
    """Cites the first passage of a prompt that has any."""

    name = "echo"

    def generate(self, system: str, prompt: str) -> str:
        n = len(re.findall(r"^\[\d+\] ", prompt, re.M))
        return f"{n} passages were given. [1]" if n else NOT_FOUND


class Unavailable(RuntimeError):
    """A provider that cannot be reached now."""


class Guarded:
    """Retries with growing pauses, then a circuit breaker: after so many
    failures in a row calls fail at once until the cool-down is over."""

    def __init__(self, call: Callable, retries: int = 3, backoff: float = 1.0, threshold: int = 5, cooldown: float = 30.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.call, self.retries, self.backoff, self.threshold, self.cooldown, self.clock, self.sleep = call, retries, backoff, threshold, cooldown, clock, sleep
        self.failures, self.closed_at = 0, -math.inf

    def __call__(self, *args):
        if self.clock() < self.closed_at:
            raise Unavailable("circuit is open")
        for attempt in range(self.retries):
            try:
                out = self.call(*args)
            except (ConnectionError, TimeoutError) as e:
                if attempt + 1 < self.retries:
                    self.sleep(self.backoff * 2**attempt)
                    continue
                self.failures += 1
                if self.failures >= self.threshold:
                    self.failures, self.closed_at = 0, self.clock() + self.cooldown
                raise Unavailable(str(e)) from e
            self.failures = 0
            return out


def embedder(name: str, dim: int) -> Embedder:
    if name == "hash":
        return HashEmbedder(dim)
    raise ValueError(f"unknown embedding provider {name!r}")


def generator(name: str) -> Generator:
    if name == "echo":
        return EchoGenerator()
    raise ValueError(f"unknown text provider {name!r}")


def checked(vectors: list[list[float]], texts: list[str], dim: int) -> list[list[float]]:
    """The vectors, if there are as many as texts, each of the right length,
    finite and not zero."""
    if len(vectors) != len(texts):
        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    for v in vectors:
        if len(v) != dim or not all(map(math.isfinite, v)) or not any(v):
            raise ValueError("a vector of the wrong length, not finite, or zero")
    return vectors


def embedded(text: Column, provider: Embedder, batch: int = 16, strict: bool = True) -> Column:
    """Vectors of texts, ``batch`` at a time.  ``strict`` fails on a bad vector;
    else a text without a usable vector, or whose batch failed, has none."""

    def usable(texts: list[str]) -> list:
        try:
            got = provider.embed(texts)
        except Exception:
            return [None] * len(texts)
        return [v if len(v) == provider.dim and all(map(math.isfinite, v)) and any(v) else None for v in got] if len(got) == len(texts) else [None] * len(texts)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out: list = []
            for at in range(0, len(rows), batch):
                texts = [t or "" for t in rows.iloc[at : at + batch]]
                out += checked(provider.embed(texts), texts, provider.dim) if strict else usable(texts)
            yield pd.Series(out, dtype=object)

    return run(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero or their lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
