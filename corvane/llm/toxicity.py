"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed: a word's embedding is the sum of the embeddings of its own
bucket and of those of its first and last characters, so unseen inflections of
a known stem lie close to it.  Filters of several widths slide over the whole
text; their maxima feed a linear layer.  The embeddings start from each
bucket's log-odds in the training texts.  The margin is then calibrated by
language, as told from the text's own words: the cut that separates the
calibration texts of a language best gets the score 0.7.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import drop_stage, fold_of, kept_by_worker, small_batches, stage, words

BUCKETS = 1 << 18
DIM, FILTERS, WIDTHS = 10, 8, (1, 2, 3)
AFFIXES = (4, 5, 6, 7)
PARTS = 1 + 2 * len(AFFIXES)
#: Labelled texts of either class that the model is fitted on at most; a
#: quarter of them serves to calibrate.
POSITIVES, NEGATIVES = 1600, 2400
#: Words of them all; if they have more, the longest of them are left out.
FIT_WORDS = 1 << 24
EPOCHS, RATE = 5, 0.08
THRESHOLD = 0.7
#: Words whose filter responses a worker remembers: the first it meets of up
#: to so many bytes.
REMEMBERED, SHORT = 60_000, 64
#: Words of a text that are looked at once.
PIECE = 50_000
#: A language needs so many toxic calibration texts for a cut of its own.
LEAST_TOXIC = 12


def buckets_of(word: bytes) -> list[int]:
    """The buckets of a word, of its first and of its last characters; a part
    that is not shorter than the word is the word."""
    own = xxhash.xxh32_intdigest(word, 1) % BUCKETS
    w, out = word.decode("utf-8", "replace"), [own]
    for n in AFFIXES:
        out += [xxhash.xxh32_intdigest(w[:n], 10 + n) % BUCKETS, xxhash.xxh32_intdigest(w[-n:], 20 + n) % BUCKETS] if len(w) > n else [own, own]
    return out


class Network:
    """Embeddings, filters and the linear layer; fitted one text at a time."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.filters:
            c[:, :3, : FILTERS // 2] = np.abs(c[:, :3, : FILTERS // 2])
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.base = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0
        self.squares: dict = {}

    def start(self, parts: Iterable[np.ndarray], y: np.ndarray) -> None:
        """Put shrunken log-odds of the buckets into the first three dimensions:
        the word's own, its beginnings' and its ends'."""
        seen = np.zeros((2, BUCKETS), np.float32)
        for p, label in zip(parts, y, strict=True):
            seen[int(label)][np.unique(p)] += 1
        n = np.maximum(np.bincount(y, minlength=2), 1)[:, None]
        rate = (seen + 0.5) / (n + 1)
        odds = np.log(rate[1] / rate[0]) * (seen.sum(0) / (seen.sum(0) + 8))
        self.odds = np.clip(odds, -1, 6).astype(np.float32)

    def embed(self, parts: np.ndarray) -> np.ndarray:
        x = self.e[parts].sum(1)
        o = self.odds[parts]
        x[:, 0] += o[:, 0]
        x[:, 1] += o[:, 1::2].mean(1)
        x[:, 2] += o[:, 2::2].mean(1)
        return x

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float]:
        tops, at = [], []
        for c, b, w in zip(self.filters, self.bias, WIDTHS, strict=True):
            z = sum(x[k : len(x) - w + 1 + k] @ c[k] for k in range(w)) + b
            i = z.argmax(0)
            at.append(i)
            tops.append(z[i, np.arange(FILTERS)])
        h = np.maximum(np.concatenate(tops), 0)
        return h, at, float(h @ self.out + self.base)

    def _step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        g = self.squares.setdefault(name, np.full_like(value, 0.1))
        g += grad * grad
        value -= RATE * grad / np.sqrt(g)

    def learn(self, parts: np.ndarray, label: int, weight: float) -> None:
        x = np.zeros((max(len(parts), max(WIDTHS)), DIM), np.float32)
        if len(parts):
            x[: len(parts)] = self.embed(parts)
        h, at, margin = self.forward(x)
        err = np.float32(weight * (1 / (1 + np.exp(-margin)) - label))
        if abs(err) < 1e-3:
            return
        back = err * self.out * (h > 0)
        self._step("out", self.out, err * h + 1e-4 * self.out)
        self.base -= RATE * 0.1 * err
        rows, grads = [], []
        for j, (c, b, w) in enumerate(zip(self.filters, self.bias, WIDTHS, strict=True)):
            g, i = back[j * FILTERS : (j + 1) * FILTERS], at[j]
            if not g.any():
                continue
            gc = np.zeros_like(c)
            for k in range(w):
                gc[k] = x[i + k].T * g
                rows.append(i + k)
                grads.append(c[k].T * g[:, None])
            self._step(f"c{j}", c, gc)
            self._step(f"b{j}", b, g)
        if rows and len(parts):
            r, g = np.concatenate(rows), np.concatenate(grads)
            keep = r < len(parts)
            np.add.at(self.e, parts[r[keep]], (-0.02 * g[keep])[:, None, :])


class Toxicity:
    """The fitted network with its calibration by language."""

    def __init__(self, found: list[np.ndarray], names: list[bytes], y: np.ndarray, langs: list[str | None], natural: tuple[float, float]):
        """``found`` has each text's words, in order, as numbers of ``names``."""
        self.net, self.key = Network(), uuid.uuid4().hex
        table = np.zeros((len(names), PARTS), np.int32)
        for i, w in enumerate(names):
            table[i] = buckets_of(w)
        fit = np.arange(len(y)) % 4 != 3
        self.net.start((table[own] for own, f in zip(found, fit, strict=True) if f), y[fit])
        rng, order = np.random.default_rng(5), np.flatnonzero(fit)
        n = np.maximum(np.bincount(y[fit], minlength=2), 1)
        weight = (n.sum() / (2 * n)).clip(0.5, 3)
        for _ in range(EPOCHS if (np.bincount(y[fit], minlength=2) > 0).all() else 0):
            for i in rng.permutation(order):
                self.net.learn(table[found[i]], int(y[i]), float(weight[y[i]]))
        self._languages(found, langs, names)
        self._prepare()
        held = np.flatnonzero(~fit)
        margins = np.array([self.margin(table[found[i]]) for i in held])
        told = np.array([self.language(Counter(names[k] for k in found[i])) for i in held], int)
        share = [natural[c] / max(1, int((y == c).sum())) for c in (0, 1)]
        cost = np.array([share[c] for c in y[held]])
        everywhere = best_cut(margins, y[held], cost)
        self.cuts = np.full(len(self.names) + 1, everywhere)
        for k in range(len(self.names)):
            own = told == k
            if (y[held][own] == 1).sum() >= LEAST_TOXIC:
                self.cuts[k] = best_cut(margins[own], y[held][own], cost[own])
        del self.net.squares

    def _languages(self, found: list[np.ndarray], langs: list[str | None], names: list[bytes]) -> None:
        """Log shares of each language's 200 commonest words."""
        by: dict[str, Counter] = {}
        for own, lang in zip(found, langs, strict=True):
            if lang is not None:
                n = np.bincount(own)
                by.setdefault(lang, Counter()).update({names[k]: int(n[k]) for k in np.flatnonzero(n)})
        self.names = sorted(by)
        total = {k: max(1, sum(c.values())) for k, c in by.items()}
        common = {w for c in by.values() for w, _ in c.most_common(200)}
        self.common = {w: np.log([(by[k][w] + 1) / (total[k] + 100) for k in self.names]).astype(np.float32) for w in common}

    def language(self, seen: Counter) -> int:
        """The likeliest language by a text's common words; the last number if
        it has none."""
        known = [n * self.common[w] for w, n in sorted(seen.items()) if w in self.common]
        return int(np.argmax(sum(known))) if known else len(self.names)

    def _prepare(self) -> None:
        """All places of all filters side by side, for one product per word."""
        self.flat = np.concatenate([c[k] for c in self.net.filters for k in range(len(c))], 1)

    def responses(self, parts: np.ndarray) -> np.ndarray:
        """Of each word (a row of buckets), to every place of every filter."""
        o = self.net.odds[parts]
        return self.net.e[parts].sum(1) @ self.flat + o[:, :1] * self.flat[0] + o[:, 1::2].mean(1)[:, None] * self.flat[1] + o[:, 2::2].mean(1)[:, None] * self.flat[2]

    def tops(self, r: np.ndarray) -> np.ndarray:
        """Every filter's best place, from the responses of words in order;
        fewer words than the widest filter has are followed by zeros."""
        if len(r) < max(WIDTHS):
            r = np.concatenate([r, np.zeros((max(WIDTHS) - len(r), r.shape[1]), np.float32)])
        n, tops, at = len(r), [], 0
        for b, w in zip(self.net.bias, WIDTHS, strict=True):
            z = r[: n - w + 1, at : at + FILTERS]
            for k in range(1, w):
                z = z + r[k : n - w + 1 + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            tops.append(z.max(0) + b)
            at += w * FILTERS
        return np.concatenate(tops)

    def judged(self, tops: np.ndarray) -> float:
        return float(np.maximum(tops, 0) @ self.net.out + self.net.base)

    def margin(self, parts: np.ndarray) -> float:
        step, best = PIECE - max(WIDTHS) + 1, None
        for at in range(0, max(1, len(parts) - max(WIDTHS) + 1), step):
            own = parts[at : at + PIECE]
            tops = self.tops(self.responses(own) if len(own) else np.zeros((0, self.flat.shape[1]), np.float32))
            best = tops if best is None else np.maximum(best, tops)
        return self.judged(best)

    def calibrate(self, margin: float, lang: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(2 * (margin - self.cuts[lang]) + np.log(THRESHOLD / (1 - THRESHOLD)), -50, 50))))


class Scorer:
    """A worker's side: scores texts and remembers words."""

    def __init__(self, model: Toxicity):
        self.m, self.known = model, {}
        self.rows = np.zeros((REMEMBERED, model.flat.shape[1]), np.float32)

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """Texts are looked at in pieces that overlap by what the widest filter
        needs, many short texts at once: memory does not grow with a text."""
        out, pieces, size = [], [], 0
        for t in texts:
            own = words(t)
            out.append([None, Counter()])
            for at in range(0, max(1, len(own) - max(WIDTHS) + 1), PIECE - max(WIDTHS) + 1):
                pieces.append((out[-1], own[at : at + PIECE], 0 if at == 0 else max(WIDTHS) - 1))
                size += len(pieces[-1][1])
                if size >= PIECE:
                    self._look(pieces)
                    pieces, size = [], 0
        self._look(pieces)
        return [self.m.calibrate(self.m.judged(tops), self.m.language(seen)) for tops, seen in out]

    def _look(self, pieces: list[tuple[list, list[bytes], int]]) -> None:
        """Bring the tops and common words of the pieces' texts up to date;
        the first words of a piece may have been in the one before."""
        known = self.known
        fresh = list({w for _, own, _ in pieces for w in own}.difference(known))
        new = self.m.responses(np.array([buckets_of(w) for w in fresh], np.int32).reshape(-1, PARTS))
        at = {}
        for i, w in enumerate(fresh):
            if len(known) < REMEMBERED and len(w) <= SHORT:
                self.rows[len(known)] = new[i]
                known[w] = len(known)
            else:
                at[w] = REMEMBERED + i
        place = (lambda w: i if (i := known.get(w)) is not None else at[w]) if at else known.__getitem__
        for text, own, again in pieces:
            where = np.fromiter(map(place, own), np.int64, len(own))
            r = self.rows[np.minimum(where, REMEMBERED - 1)]
            if at:
                unknown = np.flatnonzero(where >= REMEMBERED)
                r[unknown] = new[where[unknown] - REMEMBERED]
            tops = self.m.tops(r)
            text[0] = tops if text[0] is None else np.maximum(text[0], tops)
            text[1].update(w for w in own[again:] if w in self.m.common)


def scorer_of(model: Toxicity) -> Scorer:
    """The worker's scorer of a model; it outlives a task, its words stay known."""
    return kept_by_worker(("toxicity", model.key), lambda: Scorer(model))


def best_cut(margins: np.ndarray, y: np.ndarray, cost: np.ndarray) -> float:
    """The margin between texts with the best F1 of the toxic class, each text
    counting as many as it stands for; 0 without texts of both classes."""
    if not len(y) or (y == 1).all() or (y == 0).all():
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, hit, all_ = margins[order], np.cumsum((cost * (y == 1))[order]), np.cumsum(cost[order])
    f1 = 2 * hit / (all_ + (cost * (y == 1)).sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    i = int(np.argmax(f1))
    return float((m[i] + m[i + 1]) / 2 if i + 1 < len(m) else m[i] - 1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", positives: int = POSITIVES, negatives: int = NEGATIVES, fit_words: int = FIT_WORDS) -> Toxicity:
    """Fit on the labelled rows given: at most ``positives`` and ``negatives``
    texts, those with the least hash of doc_id, and ``fit_words`` words.

    Null labels, ids and texts are left out; a doc_id labelled more than once
    is toxic if any label says so; of rows that repeat an id, the text with the
    least hash counts.  Empty texts are examples like others.  Without labels
    of both classes, as with empty tables, all scores are alike.  The driver
    gets numbers of words and the different words, not the texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r["count"] for r in own.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    part = lambda c, n: own.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = F.broadcast(part(1, positives).unionByName(part(0, negatives)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.col(f"`{text}`").isNotNull()).select("doc_id", F.col(f"`{text}`").alias("t"), lang.alias("lang")).join(picked, "doc_id")

    def number(batches):
        for b in batches:
            out = []
            for t in b["t"]:
                vocab: dict[bytes, int] = {}
                seq = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words(t)), np.int32)
                out.append((len(seq), seq.tobytes(), b" ".join(vocab)))
            yield pd.concat([b[["i", "toxic", "lang", "h"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "seq", "vocab"])], axis=1)

    rows = texts.select(F.col("doc_id").cast("string").alias("i"), F.col("toxic").cast("int").alias("toxic"), "lang", F.xxhash64("t").alias("h"), "t")
    made = rows.mapInPandas(number, "i string, toxic int, lang string, h long, n long, seq binary, vocab binary")
    made = stage(made.groupBy("i").agg(F.min_by(F.struct("toxic", "lang", "n", "seq", "vocab"), F.struct("h", "n")).alias("r")).select("i", "r.*"), "toxicity-sample")
    sizes = sorted(r.n for r in made.select("n").collect())
    longest = max((n for n, upto in zip(sizes, np.cumsum(sizes), strict=True) if upto <= fit_words), default=0)
    # Words become numbers of one list for all texts.
    every: dict[bytes, int] = {}
    texts_, y, langs, key = [], [], [], []
    for r in made.where(F.col("n") <= longest).toLocalIterator():
        here = np.fromiter((every.setdefault(w, len(every)) for w in bytes(r.vocab).split()), np.int32)
        texts_.append(here[np.frombuffer(r.seq, np.int32)] if r.n else here)
        y.append(r.toxic)
        langs.append(r.lang)
        key.append((xxhash.xxh64_intdigest(r.i), r.i))
    drop_stage(spark, made)
    order = sorted(range(len(key)), key=key.__getitem__)
    return Toxicity([texts_[i] for i in order], list(every), np.array([y[i] for i in order], int), [langs[i] for i in order], (float(total.get(0, 0)), float(total.get(1, 0))))


def score(model: Toxicity, docs: DataFrame, text: str = "text") -> Column:
    """A column for ``docs``: the score from 0 to 1 of the whole text, toxic
    from THRESHOLD on.

    A null text scores as an empty one; very long ones are scored whole, in
    pieces.  Each row is scored by its text alone: rows that repeat have equal
    scores, an empty table has none, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer_of(held.value)
        for batch in batches:
            yield pd.Series(own.scores(list(batch)), dtype=float)

    return tell(F.col(f"`{text}`"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents below the threshold, with all their columns; see ``train``
    and ``score`` for nulls, long texts, repeated rows and empty tables."""
    return docs.where(score(train(docs, labels, text), docs, text) < THRESHOLD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every row of ``documents``, learned from labels outside
    fold 1; see ``train`` and ``score``.  A null id counts as held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(fold_of(F.col("doc_id"), 3) != 1))
    found = docs.select("doc_id", score(model, docs).alias("score"))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
