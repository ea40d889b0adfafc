"""Near-duplicate detection by ProbMinHash, banding and verification.

A text is a weighted set of five-word shingles with weight 1 + ln(count).  Its
ProbMinHash signature takes, for each register, the shingle whose exponential
arrivals (at the rate of its weight) hit the register first; two signatures
agree in a register with the probability Jaccard similarity of the texts.
Arrivals of a shingle stop once they are later than every register's best.

Registers are grouped into bands; distinct texts that share a band are
candidates.  A band's texts are first compared with one leader of the band, in
two rounds, not with each other; a band whose texts are then in one component
is done.  Of the other bands small ones are compared pairwise.  The texts of a
crowded one are told apart by their differences from its leader: texts x and y
of at least the similarity have symmetric differences from the leader that
are nearly the same, so all but a bounded number of the shingles in the one
must be in the other (see ``most_apart``).  An ordered prefix of each
difference is joined, and a pair is a candidate only if the places at which
its prefixes meet leave room for enough common ones.  No pair of at least the
similarity is lost by that.  All candidates are verified exactly on the whole
texts; classes are the connected components of the verified links.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import Staged, drop_stage, kept_by_worker, mix, small_batches, stage, words

SHINGLE, SIMILARITY = 5, 0.8
#: 25 bands of 5 registers: a pair at the threshold shares a band with
#: probability 1 - (1 - 0.8^5)^25 = 0.99995.
BANDS, ROWS = 25, 5
#: A band of more texts is crowded.
CROWD = 48
#: Comparisons with one leader are split into parts of about so many.
PART = 2000
#: Rows that repeat an id and a text are told in runs of so many.
RUN = 10_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of a whole text's shingles, by rising hash.  A text of
    fewer words, but not none, is one shingle."""
    h = word_hashes(words(text))
    if not len(h):
        return h, np.zeros(0)
    size = min(size, len(h))
    s = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        s = mix(s * _SEED + h[k : len(h) - size + 1 + k])
    found, n = np.unique(s, return_counts=True)
    return found, 1.0 + np.log(n)


def signature(items: np.ndarray, weights: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The register's shingles (not empty items)."""
    best, who = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    seed, rate, time, step = mix(items), weights, np.zeros(len(items)), 0
    while len(seed):
        # So many arrivals of each item at once that most registers are hit.
        n = max(1, min(512, int(np.ceil(registers * (np.log(registers) + 1) / len(seed)))) if step == 0 else 1 + int(registers // max(1, len(seed))))
        r = mix(seed[:, None] + (np.arange(step + 1, step + n + 1, dtype=np.uint64) * _SEED)[None, :])
        wait = -np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0) / rate[:, None]
        at = time[:, None] + np.cumsum(wait, 1)
        k = (((r & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)).astype(np.intp)
        flat, where = at.ravel(), k.ravel()
        early = flat < best.max()
        flat, where, item = flat[early], where[early], np.repeat(items if step == 0 else live, n)[early]
        order = np.lexsort((item, flat))[::-1]
        first = np.full(registers, -1, np.intp)
        first[where[order]] = order  # the last written is the earliest
        hit = np.flatnonzero(first >= 0)
        hit = hit[flat[first[hit]] < best[hit]]
        best[hit], who[hit] = flat[first[hit]], item[first[hit]]
        go = at[:, -1] < best.max()
        live = (items if step == 0 else live)[go]
        seed, rate, time, step = seed[go], rate[go], at[go, -1], step + n
    return who


def band_keys(who: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * _SEED + who.reshape(bands, rows)[:, k])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets: for every common item i one
    over the sum, over all j, of max(a_j / a_i, b_j / b_i)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i], b[1][j]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    later = x.sum() - np.cumsum(x)  # items with a larger ratio count by a, the others by b
    upto = np.cumsum(y)
    return float((1.0 / ((later + only_a) / x + (upto + only_b) / y)).sum())


def text_id(text: Column) -> Column:
    """128 bits that stand for a text; null for a null text."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))


def banded(docs: DataFrame, text: str) -> DataFrame:
    """(band, id, copies): the bands of every distinct text with words, and the rows that have it."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker("near-duplicates", dict)  # frees what other operators left
        for b in batches:
            found = []
            for x, y, t in zip(b["a"], b["b"], b["t"], strict=True):
                items, weights = shingles(t)
                if len(items):
                    found.append((x, y, band_keys(signature(items, weights))))
            yield pd.DataFrame(found, columns=["a", "b", "keys"])

    rows = docs.select(text_id(F.col(text)).alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull()).select("id.a", "id.b", "t")
    signed = rows.mapInPandas(sign, "a long, b long, keys array<long>")
    return signed.select(F.explode("keys").alias("band"), F.struct("a", "b").alias("id")).groupBy("band", "id").agg(F.count(F.lit(1)).alias("copies"))


def both_texts(pairs: DataFrame, texts: DataFrame, part: int = PART) -> DataFrame:
    """(ma, mb, la, lb, tm, tl) and the other columns of ``pairs`` (m, l, ...).
    ``texts`` has (id, t).  A leader l with more than ``part`` members has its
    text sent to parts of them."""
    more = [c for c in pairs.columns if c not in ("m", "l")]
    counts = pairs.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    ends = lambda id_, t: texts.select(F.col("id").alias(id_), F.col("t").alias(t))
    own = pairs.join(ends("m", "tm"), "m")
    if counts.where(F.col("n") > part).limit(1).count() == 0:
        both = own.join(ends("l", "tl"), "l")
    else:
        parts = counts.select("l", F.ceil(F.col("n") / part).cast("int").alias("parts"))
        led = parts.select("l", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(ends("l", "tl"), "l")
        many = parts.where("parts > 1")
        both = own.join(many, "l", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("m"), F.col("parts")), F.lit(0)).cast("int")).join(led, ["l", "part"])
    return both.select(F.col("m.a").alias("ma"), F.col("m.b").alias("mb"), F.col("l.a").alias("la"), F.col("l.b").alias("lb"), "tm", "tl", *more)


class Recent:
    """The shingles of the texts met last: a leader's are made once."""

    def __init__(self, most: int = 64):
        self.kept, self.most = OrderedDict(), most

    def __call__(self, key: tuple, text: str) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.popitem(last=False)
            self.kept[key] = shingles(text)
        return self.kept[key]


def _ends(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.struct(F.col("ma").alias("a"), F.col("mb").alias("b")).alias("m"), F.struct(F.col("la").alias("a"), F.col("lb").alias("b")).alias("l"), *more)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, part: int = PART) -> DataFrame:
    """The ``pairs`` (m, l) whose texts are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker("near-duplicates", dict)
        leader = Recent()
        for b in batches:
            keep = [probability_jaccard(shingles(r.tm), leader((r.la, r.lb), r.tl)) >= similarity - 1e-9 for r in b.itertuples(index=False)]
            yield b.loc[keep, ["ma", "mb", "la", "lb"]]

    return _ends(both_texts(pairs, texts, part).mapInPandas(check, "ma long, mb long, la long, lb long"))


def most_apart(x: Column, y: Column, similarity: float) -> Column:
    """How many shingles two texts of at least ``similarity`` t can have that
    are not in both; x and y are their total weights.

    Let a be the share of x's weight that is outside y and b the other way
    round.  A common shingle i with shares p of x and q of y counts at most
    1 / (1/p + b/q), which is concave and homogeneous, so the similarity is at
    most (1-a)(1-b) / (1-ab).  No weight is below 1, so not more than ax + by
    shingles are outside; that is largest, under the similarity being t, at the
    value returned.
    """
    t = similarity
    inner = (x + y - 2 * t * F.sqrt(x * y)) / (1 + t)
    return F.when((y >= t * t * x) & (x >= t * t * y), inner).otherwise((1 - t) * F.greatest(x, y)) + 1e-6


def totals(texts: DataFrame) -> DataFrame:
    """(id, weight, size): the sum of a text's weights and its shingles."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker("near-duplicates", dict)
        for b in batches:
            found = [shingles(t)[1] for t in b["t"]]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "weight": [float(w.sum()) for w in found], "size": [len(w) for w in found]})

    found = texts.select("id.a", "id.b", "t").mapInPandas(add, "a long, b long, weight double, size long")
    return found.select(F.struct("a", "b").alias("id"), "weight", "size")


def differences(pairs: DataFrame, texts: DataFrame, part: int = PART) -> DataFrame:
    """(m, l, apart, first) for ``pairs`` (m, l, most): how many shingles are in
    one text only and, in one order for all texts of a leader, the first
    ``most`` of them: what m has more, by hash, then what it lacks."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker("near-duplicates", dict)
        leader = Recent()
        for b in batches:
            apart, first = [], []
            for r in b.itertuples(index=False):
                x, y = shingles(r.tm)[0], leader((r.la, r.lb), r.tl)[0]
                d = np.concatenate([np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)])
                apart.append(len(d))
                first.append(d[: int(r.most)].view(np.int64))
            yield pd.DataFrame({"ma": b["ma"], "mb": b["mb"], "la": b["la"], "lb": b["lb"], "apart": apart, "first": first})

    return _ends(both_texts(pairs, texts, part).mapInPandas(tell, "ma long, mb long, la long, lb long, apart long, first array<long>"), "apart", "first")


def crowded_pairs(members: DataFrame, texts: DataFrame, staged: Staged, similarity: float, part: int = PART) -> DataFrame:
    """(m, l): all pairs of texts with one leader that can be similar enough and
    are in different components.  ``members`` has (id, c, l, lc): a text, its
    component, its leader, the leader's component; ``texts`` has (id, t)."""
    t = similarity - 1e-9
    wanted = texts.join(members.select("id").distinct(), "id", "left_semi")
    sized = staged(members.join(totals(wanted), "id"), "sized")
    # A text's partner weighs at most ``wide`` times as much, by how much a leader's texts repeat themselves.
    repeat = sized.groupBy("l").agg(F.max(F.col("weight") / F.col("size")).alias("repeat"))
    wide = F.when(1 / F.col("repeat") > 1 - t + 1e-3, 1 / (1 / F.col("repeat") - (1 - t))).otherwise(F.lit(float(1 << 30)))
    bound = F.least(F.floor(F.col("weight") * wide * (2 * (1 - t) / (1 + t)) + 1e-6), F.lit(1 << 30)) + 1
    sized = sized.join(repeat, "l").withColumn("most", bound).drop("repeat")
    told = differences(sized.select(F.col("id").alias("m"), "l", "most"), texts, part).withColumnRenamed("m", "id")
    told = staged(sized.join(told, ["id", "l"]), "differences")
    keyed = told.select("l", "id", "c", "weight", "apart", F.posexplode("first").alias("at", "shingle"))
    x, y = keyed.alias("x"), keyed.alias("y")
    room = 1 + F.least(F.col("x.apart") - F.col("x.at") - 1, F.col("y.apart") - F.col("y.at") - 1)
    bound = most_apart(F.col("x.weight"), F.col("y.weight"), t)
    differ = F.col("x.apart") + F.col("y.apart")
    meet = (F.col("x.l") == F.col("y.l")) & (F.col("x.c") != F.col("y.c"))
    ends = lambda df: df.select(F.col("x.id").alias("m"), F.col("y.id").alias("l"))
    by_shingle = ends(x.join(y, meet & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") > F.col("y.id")) & (differ - 2 * room <= bound)))
    # Texts so near to their leader that they need nothing in common: those in its component are together already.
    near = told.where("apart < most").select("l", "lc", "id", "c", "weight", "apart")
    far, other = near.where("c != lc").alias("x"), near.alias("y")
    return by_shingle.unionByName(ends(far.join(other, meet & (differ <= bound))))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of ``links`` (m, l): the least id it reaches.

    Alternating large and small stars: each node points its neighbours to the
    least node it knows.  Rounds, each of which about halves distances, end
    when only stars are left: no node has two parents, no parent has one.
    """
    spark = links.sparkSession
    edges = stage(links.where("m != l").select(F.greatest("m", "l").alias("u"), F.least("m", "l").alias("v")).distinct(), "links")
    while not _stars(edges):
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        # Large star: a node's larger neighbours go to its least.
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(edges)
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = stage(small, "links")
        drop_stage(spark, edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return both.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


def merged(classes: DataFrame | None, links: DataFrame, staged: Staged) -> DataFrame:
    """``classes`` (id, root) joined up by new ``links`` (m, l): only the roots
    that links connect are worked on."""
    if classes is None:
        return staged(components(links), "classes")
    end = lambda name: classes.select(F.col("id").alias(name), F.col("root").alias(f"r{name}"))
    up = links.join(end("m"), "m", "left").join(end("l"), "l", "left").select(F.coalesce("rm", "m").alias("m"), F.coalesce("rl", "l").alias("l"))
    moved = staged(components(up), "roots")
    old = classes.join(moved.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return staged(old.unionByName(moved.join(classes, "id", "left_anti")), "classes")


def text_classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, crowd: int = CROWD, part: int = PART) -> DataFrame:
    """(id, root) of every distinct text that is linked to another one."""
    staged = Staged()
    bands = staged(banded(docs, text), "bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    met = staged(bands.join(shared, "band"), "bands-shared")
    staged.drop(bands)
    wanted = met.select("id").distinct()
    texts = docs.select(text_id(F.col(text)).alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    texts = staged(texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("t").alias("t")), "texts")
    asked, classes = None, None

    def mixed() -> DataFrame:
        """(band, id, copies, c, n): the bands of more than one component, n texts in each."""
        rows = met.join(classes, "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")
        apart = rows.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("n")).where("c1 != c2").select("band", "n")
        return staged(rows.join(apart, "band"), "bands-mixed")

    def compare(pairs: DataFrame) -> None:
        nonlocal asked, classes
        pairs = pairs.select(F.greatest("m", "l").alias("m"), F.least("m", "l").alias("l")).distinct()
        pairs = staged(pairs if asked is None else pairs.join(asked, ["m", "l"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            asked = pairs if asked is None else asked.unionByName(pairs)
            classes = merged(classes, staged(verify(pairs, texts, similarity, part), "verified"), staged)

    # Round 0: a band's text with the most copies, then the least, so that a class has few leaders.
    led = met.groupBy("band").agg(F.min(F.struct((-F.col("copies")).alias("x"), "id")).alias("x")).select("band", F.col("x.id").alias("l"))
    compare(met.join(led, "band").where("id != l").select(F.col("id").alias("m"), "l"))
    if classes is None:
        staged.drop()
        return docs.select(text_id(F.col(text)).alias("id")).select("id", F.col("id").alias("root")).limit(0)
    # Round 1: the text that shares most with others, and so is most like them all.
    rows = mixed()
    weight = rows.groupBy("id").agg(F.sum("n").alias("w"))
    led = rows.join(weight, "id").groupBy("band").agg(F.min(F.struct((-F.col("w")).alias("x"), "id", "c")).alias("x"))
    led = staged(led.select("band", F.col("x.id").alias("l"), F.col("x.c").alias("lc")), "leaders")
    compare(rows.join(led, "band").where("c != lc").select(F.col("id").alias("m"), "l"))
    staged.drop(rows)
    rows = mixed()
    small = rows.where(F.col("n") <= crowd)
    pairs = small.alias("x").join(small.alias("y"), "band").where("x.id > y.id and x.c != y.c").select(F.col("x.id").alias("m"), F.col("y.id").alias("l"))
    many = rows.where(F.col("n") > crowd)
    if many.limit(1).count():
        leads = led.select("band", "l").join(classes.select(F.col("id").alias("l"), F.col("root").alias("lc")), "l", "left").select("band", "l", F.coalesce("lc", "l").alias("lc"))
        members = many.join(leads, "band").where("id != l").select("id", "c", "l", "lc").distinct()
        pairs = pairs.unionByName(crowded_pairs(members, texts, staged, similarity, part))
    compare(pairs)
    staged.drop(*[d for d in staged.made if d is not classes])
    return classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs``.

    ``class_id`` is the least doc_id of the class: equal texts, and texts
    connected by links of at least ``similarity``.  ``kept`` marks the one row
    of each class that stays.  Null texts are classes of their own, one for
    each row, with their own id as class_id, and stay; texts without words are
    linked to equal texts only.  Rows that repeat an id are rows like others;
    if rows tie for staying, the one with the least text hash and then any one
    of the identical ones stays.  Other columns are left out.
    """
    classes = text_classes(docs, text, similarity)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_id(F.col(text)).alias("id"))
    null = rows.where("id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    # One row for every (id, doc_id): copies of a text, pre-aggregated.
    held = rows.where("id is not null").groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    held = stage(held.join(classes, "id", "left").withColumn("root", F.coalesce("root", "id")), "members")
    first = held.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "id")).alias("f")).select("root", "f.doc_id", F.col("f.id").alias("fid"))
    joined = held.join(first.withColumnRenamed("doc_id", "class_id"), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("id") == F.col("fid"))
    # Repeated rows come back one by one, from runs of bounded length.
    runs = joined.select("doc_id", "class_id", "n", stays.alias("stays"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("run"))
    told = runs.select("doc_id", "class_id", "stays", F.explode(F.sequence(F.col("run") + 1, F.least(F.col("run") + RUN, F.col("n")))).alias("copy"))
    return told.select("doc_id", "class_id", (F.col("stays") & (F.col("copy") == 1)).alias("kept")).unionByName(null)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    classes = text_classes(docs, text)
    spark, columns = docs.sparkSession, docs.columns
    marked = docs.withColumn("__id", text_id(F.col(text)))
    narrow = marked.where(F.col("__id").isNotNull()).groupBy("__id").agg(F.min(F.struct(F.col(doc_id).isNull().alias("x"), F.col(doc_id).alias("d"))).alias("f"))
    per_text = narrow.join(classes.select(F.col("id").alias("__id"), "root"), "__id", "left").select("__id", F.coalesce("root", "__id").alias("root"), F.col("f.x").alias("x"), F.col("f.d").alias("d"))
    keepers = per_text.groupBy("root").agg(F.min(F.struct("x", "d", F.col("__id").alias("i"))).alias("f")).select(F.col("f.i").alias("__kid"), F.col("f.d").alias("__kd"))
    keepers = stage(keepers, "keepers")
    stays = marked.join(keepers, F.col("__id").eqNullSafe(F.col("__kid")) & F.col(doc_id).eqNullSafe(F.col("__kd")), "left_semi")
    # Rows that repeat both id and text would stay together: of those any one is taken.
    repeated = marked.where(F.col("__id").isNotNull()).groupBy("__id", doc_id).count().where("count > 1").limit(1).count()
    if repeated:
        stays = stays.dropDuplicates(["__id", doc_id])
    return stays.unionByName(marked.where(F.col("__id").isNull())).select(*[F.col(f"`{c}`") for c in columns])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every row of ``documents``; see ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
