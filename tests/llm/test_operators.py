"""The training-data operators against brute force, round trips and held-out
labels; null, empty, long, tied, repeated and clashing inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, chat, decontamination, language_id, near_duplicates, packing, quality, sharding, toxicity, url_filters
from corvane.llm.shared import words

VOCAB = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# ---- url filters


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Example.ORG/es/x?q#f", "c"), (2, "https://example.org/en/1", "c"), (3, "http://x.com/fr/", "c"), (4, "http://x.com/de/a", "c"), (5, "http://x.net/a/?utm_source=feed", "c"), (6, "https://www.X.net/a#t", "c"), (7, None, "c"), (8, "no scheme", "c"), (9, "http://notorg/", "c"), (9, "http://notorg/", "c"), (10, "http://org?x", "c"), (11, "http://" + "y" * 50000 + ".net/z", "c")],
        "page_id long, url string, block string",
    ).withColumns({"key": F.lit(1), "w0": F.lit(2), "host": F.lit("old"), "row": F.lit(3)})
    listed = spark.createDataFrame([("x.net/a",), ("x.net/a",), (None,)], "u string")
    got = sorted((r.page_id, r.host[:20], r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, listed).collect())
    assert got == [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/1", "example.org/en/1", "block"), (3, "x.com", "/fr/", "com/fr/", "allow"), (4, "x.com", "/de/a", "com/de/", "block"),
        (5, "x.net", "/a/", None, "block"), (6, "www.x.net", "/a", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "notorg", "/", None, "allow"), (9, "notorg", "/", None, "allow"), (10, "org", "", None, "allow"), (11, "y" * 20, "/z", None, "allow"),
    ]
    assert url_filters.filter_urls(pages.limit(0), listed).count() == 0 and url_filters.filter_urls(pages, listed.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_urls_by_shuffle_and_ties_of_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.net/p{i % 3}") for i in range(60)] + [(100 + i, "http://hot.net/x") for i in range(40)], "page_id long, url string")
    listed = spark.createDataFrame([("hot.net/x",), ("h1.net/p1",)], "u string")
    run = lambda: sorted((r.page_id, r.verdict) for r in url_filters.filter_urls(pages, listed).collect())
    sent = run()
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 0)
    assert run() == sent and [i for i, v in sent if v == "block"] == [i for i in range(60) if i % 7 == 1 and i % 3 == 1] + list(range(100, 140))
    ties = (("block", "b.com", "/"), ("allow", "a.com", "/"), ("block", "a.com", "/"))
    rule, verdict = url_filters.rule_columns(F.lit("x.a.com"), F.lit("/q"), ties)
    assert spark.range(1).select(rule.alias("r"), verdict.alias("v")).first()["r"] == "a.com/"


def test_bloom_blocks_have_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = {r.block: r for r in url_filters.bloom_blocks(keys, "k", 190).collect()}
    masks, pick = url_filters._masks(F.col("k"))
    probe = lambda df: [all(b is not None and b[f"w{j}"] & r[f"m{j}"] == r[f"m{j}"] for j in range(4)) for r in df.select(F.pmod(pick, F.lit(190)).alias("b"), *[m.alias(f"m{j}") for j, m in enumerate(masks)]).collect() for b in [blocks.get(r.b)]]
    assert all(probe(keys))
    assert np.mean(probe(spark.range(3000).select(F.concat(F.lit("other"), "id").alias("k")))) < 0.02


# ---- sharding


@pytest.mark.parametrize("case", ["mixed", "one hot group", "empty"])
def test_sharding(spark, case):
    rng = random.Random(1)
    texts = {"mixed": [None, "", ""] + [f"copy {i % 9}" for i in range(60)] + ["long " * 50000] + [prose(rng, 5) for _ in range(136)], "one hot group": ["hot"] * 90 + [prose(rng, 4) for _ in range(60)] + ["é"] * 7, "empty": []}[case]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(3, "twice", "x")] * 2 * bool(texts)
    got = sharding.shard(docs(spark, rows, ", shard string"), 16).collect()
    assert len(got) == len(rows)
    count = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(count) - min(count) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    if case == "mixed":
        for k in range(9):
            assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(f"copy {k}".encode())}) == 1
    if case == "one hot group":
        assert len({r.shard for r in got if r.size == 4}) <= 16 and len({r.shard for r in got if r.size == 3 and r.text_crc32 == zlib.crc32("é".encode())}) <= 5


def test_shards_cut_no_more_groups_than_a_plain_packing(spark):
    """Against brute force: largest groups first, each whole into the emptiest shard, cut only where none has room."""
    rng = random.Random(25)
    texts = [f"group {g}" for g in range(90) for _ in range(rng.randint(1, 60))]
    got = sharding.shard(docs(spark, list(enumerate(texts))), 16).collect()
    room, cut = [len(texts) // 16 + (s < len(texts) % 16) for s in range(16)], 0
    for n in sorted((texts.count(t) for t in set(texts)), reverse=True):
        s = max(range(16), key=room.__getitem__)
        if room[s] >= n:
            room[s] -= n
        else:
            cut += 1
            while n:
                s = max(range(16), key=room.__getitem__)
                n, room[s] = n - min(n, room[s]), room[s] - min(n, room[s])
    at = {}
    for r in got:
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in at.values()) <= cut + 5 and sum(len(s) - 1 for s in at.values()) <= 2 * (cut + 5)


@pytest.mark.parametrize("texts", [["hot"] * 640 + [f"pair {i // 2}" for i in range(360)] + [f"one {i}" for i in range(920)], [f"pair {i // 2}" for i in range(1920)], ["hot"] * 300 + ["hotter"] * 500 + [f"big {i % 9}" for i in range(990)] + [f"pair {i // 2}" for i in range(130)]])
def test_groups_that_fit_are_whole(spark, texts):
    got = sharding.shard(docs(spark, list(enumerate(texts))), 16).collect()
    assert sorted(r.slot for r in got) == sorted(i for s in range(16) for i in range(len(texts) // 16))
    at = {}
    for r in got:
        at.setdefault(texts[r.doc_id], []).append(r.shard)
    assert all(len(set(s)) == 1 for s in at.values() if len(s) <= len(texts) // 16)


# ---- near-duplicates


def j_p(a: dict, b: dict) -> float:
    """By the definition."""
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)


def weighted(text: str) -> dict:
    w = words(text)
    n = min(5, len(w))
    found = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []
    return {s: 1 + np.log(found.count(s)) for s in set(found)}


def near_copies():
    rng, rows = random.Random(7), []
    for _ in range(12):
        base = prose(rng, rng.randint(30, 300)).split()
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            rows.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper() + "!")
    return rows + ["a b", "a b", "A, b", "", "", "...", None, None, prose(rng, 20000)]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1)]
    sets = [weighted(t) if t else {} for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        same = texts[i] is not None and texts[i] == texts[j]
        if same or (sets[i] and sets[j] and j_p(sets[i], sets[j]) >= 0.8):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    frame = docs(spark, rows, ", root string, id int")
    got = near_duplicates.near_duplicates(frame).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, find(i)) for i in range(len(texts))} and len(got) == len(rows)
    assert sorted(r.doc_id for r in got if r.kept) == sorted({find(i) for i in range(len(texts))})
    left = near_duplicates.drop_near_duplicates(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == sorted({find(i) for i in range(len(texts))})
    assert near_duplicates.near_duplicates(frame.limit(0)).count() == 0 and near_duplicates.drop_near_duplicates(frame.limit(0)).count() == 0


def one_band(monkeypatch):
    """All texts with words share a single band."""
    alike = lambda d, text: d.where(F.length(text) > 0).groupBy(F.lit(1).cast("long").alias("band"), near_duplicates.text_id(F.col(text)).alias("id")).agg(F.count(F.lit(1)).alias("copies"))
    monkeypatch.setattr(near_duplicates, "banded", alike)


def partition(spark, texts, **limits):
    """The classes of texts as sets, from ``text_classes``."""
    frame = docs(spark, list(enumerate(texts)))
    ids = frame.select("doc_id", near_duplicates.text_id(F.col("text")).alias("id"))
    by = {}
    for r in ids.join(near_duplicates.text_classes(frame, **limits), "id", "left").collect():
        by.setdefault(r.root or r.id, set()).add(texts[r.doc_id])
    return sorted(map(sorted, by.values()))


def brute_partition(texts):
    sets = [near_duplicates.shingles(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or near_duplicates.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(find(i), set()).add(t)
    return sorted(map(sorted, by.values()))


def test_similar_pair_is_linked_behind_a_dissimilar_leader(spark, monkeypatch):
    rng = random.Random(15)
    base, odd = prose(rng, 60), prose(rng, 60)
    texts = [odd] * 3 + [base + " end", base + " stop"]  # the odd one has most copies, and leads
    one_band(monkeypatch)
    assert partition(spark, texts) == partition(spark, texts, crowd=1) == sorted([[odd], sorted(texts[3:])])


@pytest.mark.parametrize("seed", [21])
def test_crowded_band_equals_brute_force(spark, monkeypatch, seed):
    rng, texts = random.Random(seed), []
    bases = [prose(rng, 70), prose(rng, 70), prose(rng, 20) + " again and again " * 4 + prose(rng, 30)]
    for i in range(110):
        copy = rng.choice([*bases, bases[0], *texts[-30:]]).split()  # copies of copies make chains
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 1)] = rng.choice([[], ["typo"], [f"t{i}"], copy[at : at + 4]])
        texts.append(" ".join(copy * (2 if rng.random() < 0.1 else 1)))
    texts += [prose(rng, 60) for _ in range(6)] + ["a b", "a b c"]
    want = brute_partition(texts)
    assert 8 < len(want) < len(set(texts)) and max(map(len, want)) > 10
    one_band(monkeypatch)
    assert partition(spark, texts, crowd=3, part=7) == want


def test_no_similar_pair_is_more_apart_than_the_bound(spark):
    rng = np.random.default_rng(23)
    for t in (0.5, 0.8, 0.95):
        seen = []
        for _ in range(1500):
            n = rng.integers(1, 60)
            x = 1 + np.log(rng.integers(1, 4 if rng.random() < 0.5 else 2, n))
            y = np.where(rng.random(n) < 0.8, x, 1 + np.log(rng.integers(1, 5, n)))
            x, y = (v * (rng.random(n) > rng.choice([0.02, 0.1, 0.3])) for v in (x, y))
            i, j = np.flatnonzero(x), np.flatnonzero(y)
            if len(i) and len(j) and near_duplicates.probability_jaccard((i, x[i]), (j, y[j])) >= t:
                seen.append((float(x.sum()), float(y.sum()), int(((x > 0) ^ (y > 0)).sum())))
        frame = spark.createDataFrame(seen, "x double, y double, apart int")
        assert len(seen) > 50 and frame.where(F.col("apart") > near_duplicates.most_apart(F.col("x"), F.col("y"), t)).count() == 0


def test_signatures_estimate_the_similarity():
    rng, est = np.random.default_rng(2), []
    for _ in range(150):
        base, w = rng.integers(0, 2**63, 90).astype(np.uint64), rng.choice([1.0, 1.7, 2.1], 90)
        pick = lambda lo, hi, scale: (base[lo:hi][np.argsort(base[lo:hi])], (w * scale)[lo:hi][np.argsort(base[lo:hi])])
        a, b = pick(0, 70, 1), pick(15, 90, 3)
        exact = j_p(dict(zip(a[0].tolist(), a[1], strict=True)), dict(zip(b[0].tolist(), b[1], strict=True)))
        assert near_duplicates.probability_jaccard(a, b) == pytest.approx(exact)
        est.append((near_duplicates.signature(*a) == near_duplicates.signature(*b)).mean() - exact)
    assert abs(np.mean(est)) < 0.012


def test_components(spark):
    rng = random.Random(4)
    links = [(a, a + 1) for a in range(1, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    frame = spark.createDataFrame(links, "x int, y int").select(F.struct(F.col("x").alias("a")).alias("m"), F.struct(F.col("y").alias("a")).alias("l"))
    root = {n: n for e in links for n in e}
    find = lambda n: n if root[n] == n else find(root[n])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id.a: r.root.a for r in near_duplicates.components(frame).collect()}
    assert got == {n: find(n) for n in root if any(a != b and n in (a, b) for a, b in links)}


# ---- packing


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encode, whole = packing.WordEncoder(path), Tokenizer.from_file(path)
    texts = [f"{chr(c)}a{chr(c)} {chr(c)}'S 1{chr(c)}." for c in range(0x250)] + [f"x{chr(c)} {chr(c)}y" for c in range(0x250, 0x3000, 7)] + ["", " ", "İstanbul ẞ don't WE'LL 12 3４5 ...!?", "Σας ΣΑΣ", "<|endoftext|> a", "日本語 text"]
    for t, ids in zip(texts, encode.many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_cuts_are_optimal():
    rng = random.Random(6)
    for _ in range(200):
        pos = np.array([0, *itertools.accumulate(rng.randint(1, 9) for _ in range(rng.randint(1, 9)))])
        pen, size = np.array([0] + [rng.choice([0, 3, 7]) for _ in pos[1:]]), rng.randint(9, 20)
        best = {0: 0}
        for j in range(1, len(pos)):
            best[j] = min(best[i] + size - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= size)
        cuts = packing.best_cuts(pos, pen, size)
        cost = sum(size - (b - a) + pen[list(pos).index(b)] for a, b in itertools.pairwise([0, *cuts]))
        ends = [j for j in best if pos[j] >= pos[-1] - size]
        assert cost == min(best[j] for j in ends) and all(b - a <= size for a, b in itertools.pairwise([0, *cuts]))


def test_packing_round_trip(spark):
    rng = random.Random(8)
    texts = [None, "", "One. Two!", "x" * 5000, "no end " * 3000] + [" ".join(prose(rng, 9) + "." for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(2**60 + i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (7, "same", "x"), (7, "same", "x")]
    got = packing.pack(docs(spark, rows, ", start string").coalesce(2)).collect()
    encode = packing.WordEncoder(packing.tokenizer_path())
    want = {i: encode.many([t or ""])[0] + packing.END.tobytes() for i, t, _ in rows}
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(want)
    for i, pieces in by.items():
        assert {p.doc_tokens for p in pieces} == {len(want[i]) // 4} and sum(p.length for p in pieces) == len(want[i]) // 4 * (1 + (i == 7))
        assert i == 7 or b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start)) == want[i]
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at <= 2048
    assert packing.pack(docs(spark, [])).count() == 0


def sequences(rows):
    """Each sequence's pieces in order, whole and without gaps."""
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append(r)
    for pieces in seq.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
    return seq


@pytest.mark.parametrize("limits", [{"size": 64, "block": 300}, {"size": 2048, "tails": 7}, {"size": 100, "block": 1, "tails": 1}])
def test_tails_and_blocks_are_packed_together(spark, limits):
    rng = random.Random(19)
    texts = [" ".join(prose(rng, 6) + "." for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["z" * 900, None]
    frame = spark.createDataFrame([(f"id {i}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, tail int").repartition(20)
    got = packing.pack(frame, **limits).collect()
    encode = packing.WordEncoder(packing.tokenizer_path())
    for i, t in enumerate(texts):
        want, own = encode.many([t or ""])[0] + packing.END.tobytes(), sorted((r for r in got if r.doc_id == f"id {i}"), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == want and [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert {r.doc_tokens for r in own} == {len(want) // 4} and all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    seq = sequences(got)
    sizes = [sum(p.length for p in s) for s in seq.values()]
    assert max(sizes) <= limits["size"]
    if limits["size"] == 2048:  # 20 partitions in 3 streams: no more short sequences than powers of two at the end of each
        assert sum(n < 2048 for n in sizes) <= 3 * 11 and len(sizes) < 20
        mid = [p for s in seq.values() for p in s[-1:] if p.start + p.length < p.doc_tokens and not encode.ends[np.frombuffer(p.ids, "<u4")[-1]]]
        assert len(mid) <= 3 * 2
    assert "ids" not in packing.pack(frame, ids=False, **limits).columns
    kept = packing.pack(frame, ids=False, **limits).agg(F.sum("length").alias("n"), F.sum("ids_crc32").alias("c")).first()
    assert kept.n == sum(r.length for r in got)


def test_last_cuts_are_optimal():
    rng, sentence = np.random.default_rng(20), np.zeros(9, bool)
    sentence[3] = True
    for _ in range(60):
        ids, size = rng.integers(2, 9, rng.integers(1, 30)).astype(np.uint32), 16
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 3), len(ids)))
        fee = lambda j: 0 if j in ends else packing.SENTENCE_CUT if ids[j - 1] == 3 else packing.FORCED_CUT
        waste = lambda n: (0 if n & (n - 1) == 0 else size - n) + (packing.SHORT_SEQUENCE if n < size else 0)
        best = [0]
        for j in range(1, len(ids) + 1):
            best.append(min(best[i] + waste(j - i) for i in range(max(0, j - size), j)) + fee(j))
        cuts = packing.last_cuts(ids, ends, sentence, size)
        assert cuts[-1] == len(ids) and sum(waste(b - a) + fee(b) for a, b in itertools.pairwise([0, *cuts])) == best[-1]


def test_memory_of_words_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3000)
    encode = packing.WordEncoder(packing.tokenizer_path())
    whole = packing.WordEncoder(packing.tokenizer_path()).whole
    for t in ["a" * 5000, " ".join(f"w{i}x" for i in range(500)), "short words here"] * 2:
        assert np.frombuffer(encode.many([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(encode.words) + len(encode.chunks) < 40


# ---- chat


def test_chat_round_trip(spark):
    rng = random.Random(9)
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<\\/s>", "[", "<s>", "[/TURN]x\\", "é\n\n", "", None, "[INST" + "]", "a" * 50000]
    rows = []
    for c in [*range(30), None, 2**60]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool [TURN]", "", None]), rng.choice(nasty), 1))
    rows += [rows[0]] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in chat.digest_examples(chat.format_conversations(frame)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        turns, loss = [(r[2] or "", r[3] or "") for r in own], "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest_examples(chat.format_conversations(frame.limit(0))).count() == 0


def test_each_reply_is_its_own_example():
    got = list(chat.expand([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")]))
    assert [t[a:b] for _, t, a, b, _, _ in got] == ["b", "d", ""] and [x[5] for x in got] == [False, False, True]
    assert got[1][1] == "<s>[INST]a[/INST][REPLY]b</s>[INST]c[/INST][REPLY]d</s>" and got[1][1].startswith(got[0][1])


# ---- decontamination


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.randint(1, 40))) for i in range(25)] + [(30, None), (31, ""), (32, "only three words"), (5, "same again here"), (33, "w1 " * 12)]
    texts = [None, "", "w1 " * 15, "ONLY three-words, only Three wordsx"]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(w))
            parts += [" ".join(w[a : a + rng.randint(5, 30)]), prose(rng, rng.randint(0, 5))]
        texts.append(" ".join(parts))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (None, texts[8], "x")]
    for kind in ("long", "string"):
        bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
        frame = docs(spark, rows, ", items string").withColumns({c: F.lit("mine") for c in ("row", "key", "n_hit", "k", "a", "t")})
        got = decontamination.contamination(frame, bench).collect()
        assert sorted(str(r.row.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        for r in got:
            digest = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
            assert (r.n_words, r.n_hit, digest) == decontamination.brute_force(r.row.text, items), r.row.doc_id
            assert sum(b - a for a, b in r.spans) == r.n_hit and all(a < b for a, b in r.spans) and r.spans == sorted(r.spans)
        left = decontamination.drop_contaminated(frame, bench)
        assert left.columns == frame.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.row.doc_id) for r in got if not r.n_hit)
    assert decontamination.drop_contaminated(docs(spark, [r[:2] for r in rows]), bench.limit(0)).count() == len(rows)
    assert decontamination.drop_contaminated(docs(spark, []), bench).count() == 0


def test_filter_lets_all_shingles_pass_even_when_full(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 10)
    rng = random.Random(24)
    items = [(i, prose(rng, 30)) for i in range(60)]
    texts = [prose(rng, 12) + " " + items[i][1] + " " + prose(rng, 3) for i in range(0, 60, 7)] + [prose(rng, 200)]
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), docs(spark, list(enumerate(texts)))
    got = {r.row.doc_id: r for r in decontamination.contamination(frame, bench).collect()}
    assert all((r.n_words, r.n_hit, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) == decontamination.brute_force(texts[i], items) for i, r in got.items()) and len(got) == len(texts)


# ---- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[3], x[200] = x[100], x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(3000, None, 0), (3001, [0.0] * 16, 0), (3100, [float("nan")] * 16, 0), (3200, [None] + [1.0] * 15, 0), (3300, [float("inf")] * 16, 0), (3400, [1.0], 0), (None, x[0].tolist(), 0), (5, x[5].tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.search(frame, frame.where("vec_id % 100 = 0")).collect()
    asked = {q: sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"]) for q in {r.query_id for r in got}}
    assert set(asked) == set(range(0, 1500, 100))
    hits = 0
    for q, found in asked.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in found)
        hits += len({r.vec_id for r in found} & set(want))
    assert hits / (10 * len(asked)) >= 0.9 and [r.vec_id for r in asked[100]][:2] == [3, 200]
    few = ann.search(frame.where("vec_id < 4"), frame.where("vec_id = 0")).collect()
    assert len(few) == 3 and ann.search(frame.limit(0), frame).count() == 0 and ann.search(frame, frame.limit(0)).count() == 0


def test_neighbours_among_copies_and_near_copies(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(2400, 16)).astype(np.float32)
    order = rng.permutation(2400)
    same, near = order[:800], order[800:1400]
    x[same] = x[same[0]]
    x[near] = x[near[0]] + rng.normal(scale=1e-3, size=(600, 16)).astype(np.float32)
    beside = order[1400]
    x[beside] = x[same[0]] + np.float32(0.01)
    asked = [int(i) for i in (*same[:8], *near[:8], beside)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(frame, frame.where(F.col("vec_id").isin(asked)), sample=400).collect()
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(2400), d)) if i != q][:10]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def exact_neighbours(x, q, top=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(i, float(d[i])) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:top]


@pytest.mark.parametrize("case", ["spread", "very near", "huge", "tiny"])
def test_neighbours_over_several_blocks_keep_doubles(spark, case):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(1300, 24))
    if case == "very near":
        x = 1 + 1e-9 * rng.integers(0, 50, (1300, 24))
    x *= {"huge": 1e120, "tiny": 1e-120}.get(case, 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, hits, scores = ann.search(frame, frame.where("vec_id % 50 = 0"), block=300, query_block=7, rerank=60, sample=600).collect(), 0, 0
    for q in range(0, 1300, 50):
        want, found = dict(exact_neighbours(x, q)), sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        assert all(r.score == pytest.approx(float(np.sqrt(((x[r.vec_id] - x[q]) ** 2).sum())), rel=1e-12, abs=0) for r in found)
        hits += len(want.keys() & {r.vec_id for r in found})
        scores += 10
    assert hits / scores >= 0.97


def test_codebooks_sample_sent_to_the_driver_is_bounded(spark):
    rng = np.random.default_rng(29)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(12000, 64)))], "vec_id long, embedding array<double>")
    conf = {"spark.sql.execution.arrow.pyspark.enabled": "false", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "128k"}
    before, limit, key = {k: spark.conf.get(k) for k in conf}, spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        limit.set(key, "2m")  # 24 tasks with 400 vectors each are 5 MB
        got = ann.search(frame, frame.where("vec_id = 7"), sample=400).collect()
    finally:
        limit.remove(key)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 10
    rows = frame.repartition(5)
    for sample in (1, 50, 12000, 20000):
        want = [r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
        assert ann.least_hashed(rows, 12000, sample)["vec_id"].tolist() == want


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 8))
    books = ann.fit(x, 4, 16)
    err = lambda beam: ((x - sum(books[m][ann.encode(x, books, beam)[0][:, m]] for m in range(4))) ** 2).sum()
    codes, norms = ann.encode(x, books, 4)
    assert err(8) < err(1) and np.allclose(norms, (sum(books[m][codes[:, m]] for m in range(4)) ** 2).sum(1), rtol=1e-3)


# ---- classifiers

LANGS = {"aa": ["the", "and", "of", "this", "that"], "bb": ["der", "und", "ist", "das", "nicht"], "cc": ["le", "et", "est", "dans", "pour"]}


def labelled(spark, n=240):
    rng, rows, labels = random.Random(13), [], []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        text = [rng.choice(LANGS[lang]) + rng.choice(["", lang * 2]) for _ in range(rng.randint(20, 80))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vileword", "vilewords"])
        joined = " ".join(w + "###" if bad and rng.random() < 0.5 else w for w in text)
        rows.append((i, joined, lang, rng.choice(["s1", "s2"]), 1, 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(1000, None, None, None, 1, 1), (1001, "", "aa", "s1", 1, 1), (1002, "123 !?", None, "s3", 1, 1), (None, "the und", "bb", None, 1, 1), (1003, "der " * 30000, "bb", "s1", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int, quality int"), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_language_identification(spark):
    frame, _ = labelled(spark)
    model = language_id.train(frame.where("doc_id % 4 <> 0"))
    got = frame.select("doc_id", "lang", language_id.predict(model, frame).alias("p")).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 4 == 0]
    assert np.mean([r.p.lang == r.lang for r in held]) >= 0.95 and all(0 <= r.p.score <= 1 for r in got)
    assert {r.doc_id: r.p.lang for r in got if r.doc_id in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    none = language_id.train(frame.limit(0))
    assert frame.select(language_id.predict(none, frame).alias("p")).where("p.lang <> 'und'").count() == 0
    codes = language_id.code_matrix(12)
    assert min((a != b).sum() for a, b in itertools.combinations(codes, 2)) >= 5


def test_every_language_with_a_text_is_learned(spark):
    """One of a single text that repeats, rare ones, and more than the sample has room for."""
    rng = random.Random(16)
    own = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(100)}
    rows = [(" ".join(rng.choice(own[k]) for _ in range(40)), k) for k in own for _ in range(4)] + [("immer der gleiche satz hier", "same")] * 3000 + [(None, "empty"), ("x", None)]
    frame = spark.createDataFrame(rows, "text string, lang string").withColumns({"l": F.lit(1), "h": F.lit(2), "t": F.lit(3)})
    model = language_id.train(frame)
    assert model.languages == [*own, "same"]
    got = frame.select("lang", language_id.predict(model, frame).alias("p")).collect()
    assert np.mean([r.p.lang == r.lang for r in got if r.lang in own]) >= 0.95 and {r.p.lang for r in got if r.lang == "same"} == {"same"}
    few = language_id.train(frame, all_languages=202)
    assert few.languages == model.languages
    least = language_id.train(frame.where("lang in ('l001', 'same')"), per_language=1)
    assert least.languages == ["l001", "same"]


def test_rows_and_columns_solve_the_same_regression():
    rng = np.random.default_rng(17)
    x, t = rng.random((60, 40)), rng.choice([-1.0, 1.0], (60, 3))
    z = x - x.mean(0)
    want = np.linalg.solve(z.T @ z + language_id.RIDGE * np.eye(40), z.T @ t)
    assert np.allclose(language_id.ridge(x, t, x.mean(0)), want) and np.allclose(language_id.ridge(x[:30], t[:30], x.mean(0)), z[:30].T @ np.linalg.solve(z[:30] @ z[:30].T + language_id.RIDGE * np.eye(30), t[:30]))


def test_decoding_equals_plain_loops(spark):
    frame, _ = labelled(spark)
    m = language_id.train(frame)
    for r in frame.limit(40).collect():
        x = language_id.features(r.text)
        bits = [sum(float(a - c) * float(w) for a, c, w in zip(x, m.mean, m.w[:, b], strict=True)) + m.b[b] for b in range(m.codes.shape[1])]
        loss = [sum(m.weight[b] * np.log1p(np.exp(-4 * code[b] * bits[b])) for b in range(len(bits))) for code in m.codes]
        p = np.exp([-8 * (v - min(loss)) for v in loss])
        name, score, doubtful = m.decode(x)
        assert name == m.languages[int(np.argmin(loss))] and score == pytest.approx(p.max() / p.sum(), abs=1e-4) and doubtful == (score < language_id.AMBIGUOUS)


def test_ambiguous_text_is_flagged(spark):
    frame, _ = labelled(spark)
    model = language_id.train(frame)
    by = {lang: np.mean([language_id.features(r.text) for r in frame.where(F.col("lang") == lang).limit(20).collect()], 0) for lang in ("aa", "bb")}
    clear, mixed = model.decode(by["aa"]), [model.decode(by["aa"] * w + by["bb"] * (1 - w)) for w in np.linspace(0.3, 0.7, 41)]
    assert clear[0] == "aa" and not clear[2] and any(m[2] for m in mixed)


def test_toxicity(spark):
    frame, labels = labelled(spark)
    model = toxicity.train(frame, labels.where("doc_id % 4 <> 0"))
    got = {r.doc_id: r.s for r in frame.select("doc_id", toxicity.score(model, frame).alias("s")).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id is not None and r.doc_id % 4 == 0}
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in truth.items()]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    none = toxicity.train(frame, labels.limit(0))
    assert frame.select(toxicity.score(none, frame).alias("s")).distinct().count() >= 1
    assert toxicity.drop_toxic(frame.limit(0), labels).count() == 0


def plain_score(model, text):
    """A text's score word by word: embeddings, every place of every filter, the linear layer, the language's cut."""
    net, own = model.net, words(text)
    parts = np.array([toxicity.buckets_of(w) for w in own], int).reshape(-1, toxicity.PARTS)
    x = np.zeros((max(len(own), max(toxicity.WIDTHS)), toxicity.DIM), np.float32)
    if len(own):
        x[: len(own)] = net.embed(parts)
    margin = net.base
    for j, (c, b, w) in enumerate(zip(net.filters, net.bias, toxicity.WIDTHS, strict=True)):
        for k in range(toxicity.FILTERS):
            best = max(sum(float(x[p + i] @ c[i][:, k]) for i in range(w)) for p in range(len(x) - w + 1)) + b[k]
            margin += max(0.0, best) * net.out[j * toxicity.FILTERS + k]
    known = [model.common[w] for w in own if w in model.common]
    cut = model.cuts[int(np.argmax(sum(known)))] if known else model.cuts[-1]
    return 1 / (1 + np.exp(-np.clip(2 * (margin - cut) + np.log(0.7 / 0.3), -50, 50)))


def test_scores_equal_the_plain_network(spark, monkeypatch):
    frame, labels = labelled(spark, 160)
    frame = frame.unionByName(frame.where("doc_id in (1, 2)")).where("length(text) < 100000 or text is null")
    model = toxicity.train(frame, labels)
    texts = [r.text for r in frame.collect()] + ["vileword", "the vileword", "x" * 300 + " der", None]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(toxicity.Scorer(model).scores(texts), want, atol=1e-4)
    net = model.net
    assert net.forward(net.embed(np.array([toxicity.buckets_of(w) for w in words(texts[0])])))[2] == pytest.approx(model.margin(np.array([toxicity.buckets_of(w) for w in words(texts[0])])), abs=1e-4)
    # Pieces of long texts and words that are not remembered change nothing.
    monkeypatch.setattr(toxicity, "PIECE", 7)
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    assert np.allclose(toxicity.Scorer(model).scores(texts), want, atol=1e-4)
    assert np.allclose([r.s for r in frame.select(toxicity.score(model, frame).alias("s")).collect()], want[:-4], atol=1e-4)


def test_fit_leaves_out_the_longest_over_its_words(spark):
    frame, labels = labelled(spark, 60)
    odd = frame.withColumns({c: F.lit(1) for c in ("i", "h", "n", "seq", "vocab", "t")})
    model = toxicity.train(odd, labels, fit_words=500)
    assert 0 < len(model.common) and all(0 <= r.s <= 1 for r in odd.select(toxicity.score(model, odd).alias("s")).collect())
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_quality(spark):
    frame, labels = labelled(spark)
    frame = frame.unionByName(frame.where("doc_id in (1, 2)"))  # repeated rows
    model = quality.train(frame, labels.where("doc_id % 4 <> 0"))
    rows = quality.judge(frame, model).collect()
    got = {r.row.doc_id: r.judged for r in rows}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None and r.doc_id % 4 == 0}
    assert np.mean([got[i].keep == bool(t) for i, t in truth.items()]) >= 0.95 and len(rows) == frame.count()
    assert got[1000].n_host == 2 and all(0 < q.path_rate < 1 for q in got.values())
    assert quality.judge(frame.limit(0), model).count() == 0 and quality.keep_good(frame, labels.limit(0)).columns == frame.columns


def test_quality_equals_brute_force(spark):
    """Every row's verdict, from the classifier's evidence and plain loops."""
    frame, labels = labelled(spark)
    model = quality.train(frame, labels)
    rows = frame.collect()
    e = model.evidence(np.array([quality.features(r.text) for r in rows]))
    p, hosts, paths = 1 / (1 + np.exp(-e)), {}, {}
    for r, own in zip(rows, p, strict=True):
        for sums, key in ((hosts, r.source), (paths, (r.source, r.lang))):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = (n + 1, s + own)
    top = (p.sum() + 1) / (len(p) + 2)

    def shrunk(sites, prior):
        """Each site's share drawn to its prior, by the strength that the spread between sites shows."""
        n, s = (np.array([x[k] for x in sites.values()]) for k in (0, 1))
        m = np.array([prior(k) for k in sites])
        q = m * (1 - m)
        v = ((n * (s / n - m) ** 2).sum() - q.sum()) / n.sum()
        strength = quality.STRENGTH[1] if v <= 0 else np.clip((n * q).sum() / n.sum() / v - 1, *quality.STRENGTH)
        return {k: (sites[k][1] + strength * prior(k)) / (sites[k][0] + strength) for k in sites}

    host = shrunk(hosts, lambda k: top)
    path = shrunk(paths, lambda k: host[k[0]])
    odds = lambda x: np.log(x / (1 - x))
    want = sorted((str(r.doc_id), float(1 / (1 + np.exp(-(own + np.clip(odds(path[r.source, r.lang]) - odds(top), -quality.SITE_LIMIT, quality.SITE_LIMIT)))))) for r, own in zip(rows, e, strict=True))
    got = sorted((str(r.row.doc_id), r.judged.quality) for r in quality.judge(frame, model, carry=["doc_id"]).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([q for _, q in got], [q for _, q in want], atol=1e-9)


def test_quality_with_clashing_names(spark):
    frame, labels = labelled(spark, 60)
    names = ["__q", "__evidence", "row", "judged", "site", "host", "path", "evidence", "__id", "i", "h", "q"]
    odd = frame.withColumns({c: F.lit("mine") for c in names})
    left = quality.keep_good(odd, labels)
    assert left.columns == odd.columns and left.where(" and ".join(f"`{c}` = 'mine'" for c in names)).count() == left.count() == quality.keep_good(frame, labels).count()


def test_site_posteriors_by_hand(spark):
    rows = [("h", "p", 3.0)] * 8 + [("h", "q", -3.0)] + [("g", "p", -3.0)] * 6
    got = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "s string, l string, e double"), "s", "l", "e").collect()}
    p = 1 / (1 + np.exp(-3.0))
    total = 8 * p + 7 * (1 - p)
    assert got["h", "p"].global_rate == pytest.approx((total + 1) / 17)
    assert got["h", "q"].path_rate < got["h", "q"].host_rate and 1 - p < got["h", "q"].path_rate and got["g", "p"].host_rate < got["h", "p"].host_rate
    assert got["h", "p"].n_host == 9 and got["h", "p"].n_path == 8
