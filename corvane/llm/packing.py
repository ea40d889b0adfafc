"""Order-preserving packing of token streams by dynamic programming.

The documents of an input partition follow each other in their order.  Cuts
are allowed at document ends (free), at sentence ends (a small penalty) and,
inside stretches without either, at fixed steps (a larger penalty).  With
positions ``pos`` of the allowed cuts the least cost of packing up to cut j is

    f[j] = min over i, pos[j] - pos[i] <= size, of
           f[i] + size - (pos[j] - pos[i]) + penalty[j]

and since the cost splits into ``f[i] + pos[i]`` and terms of j alone, the
minimum over the sliding window is the head of a monotone queue: linear time.
The stream is solved in blocks; what lies after the last full sequence of a
block is carried into the next, so memory is bounded.  The tails of many
partitions, of less than a sequence each, follow each other in another stream
that is solved in the same way.  What is left at its end is cut by a program
that may cut anywhere, at the same penalties, and that knows sequences without
padding: those as long as a power of two.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import kept_by_worker, small_batches, stage

SIZE = 2048
END_ID = 1
SENTENCE_CUT, FORCED_CUT = 8, 24
#: Steps at which a stretch without a sentence end may be cut.
STEP = 24
#: Tokens that are solved at once.
BLOCK = 1 << 20
#: Bytes, about, that a worker's memory of words, and that of parts between
#: white space, may take: of the first it meets, so of the common ones.
REMEMBERED = 80 << 20
#: What an entry takes besides its characters and ids.
ENTRY = 200
#: What a sequence costs that is not full.
SHORT_SEQUENCE = 64
#: Partitions whose tails are packed together.
TAILS = 256
#: Characters that are encoded at once.
CHARS = 1 << 20
#: Rows written at once, in tokens.
FLUSH = 1 << 18

#: The pattern that PLAIN equals on texts without BEYOND.
PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
BEYOND = re.compile(r"[\x1c-\x1f\u0250-\U0010ffff]")

SCHEMA = "doc_id string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tail int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """The ids of a tokenizers file, as little-endian uint32, word by word.

    Such a tokenizer normalises, splits into words by a pattern and encodes
    each word by itself, so a word's ids can be remembered.  Texts with an
    added token, and files of another make, go through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"])) if made["added_tokens"] else None
        parts = [p for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"] if made["pre_tokenizer"]["type"] == "Sequence" else []
        self.by_word = made["model"]["type"] == "BPE" and len(parts) == 1 and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"]) if self.by_word else None
        self.plain = self.by_word and parts[0]["pattern"]["Regex"] == PLAIN_FOR
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.room = {id(self.words): REMEMBERED, id(self.chunks): REMEMBERED}
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max([*vocab.values(), END_ID]) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True

    def _pieces(self, text: str) -> tuple[bool, list[str]]:
        """(whether they still have to be split into words, parts of a text).
        Words never cross white space, so the parts between it can be
        remembered as they are.  Up to U+024F Python's own case mapping, white
        space and character classes agree with the library's (a test goes
        through them all) and are much faster."""
        if self.plain and not BEYOND.search(text):
            return True, (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        return False, self.pattern.findall(self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text)

    def _learn_words(self, found: set[str]) -> dict[str, bytes]:
        """The ids of words, of which as many as there is room for are remembered."""
        fresh = [w for w in found if w not in self.words]
        made = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(fresh, self.whole.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
        self._remember(self.words, made)
        return made

    def _remember(self, known: dict[str, bytes], made: dict[str, bytes]) -> None:
        """As many of ``made`` as there is room for, by bytes."""
        room = self.room[id(known)]
        if room <= 0:
            return
        for w, ids in made.items():
            room -= ENTRY + len(w) + len(ids)
            if room <= 0:
                break
            known[w] = ids
        self.room[id(known)] = room

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list = []
        for t in texts:
            if not self.by_word or (self.added and self.added.search(t)):
                out.append((None, None, np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()))
                continue
            split, pieces = self._pieces(t)
            got = list(map((self.chunks if split else self.words).get, pieces))
            out.append((split, [(i, pieces[i]) for i, x in enumerate(got) if x is None] if None in got else [], got))
        parts = {c: PLAIN.findall(c) for c in {c for split, gaps, _ in out if split for _, c in gaps}}
        wanted = set(itertools.chain.from_iterable(parts.values())).union(w for split, gaps, _ in out if split is False for _, w in gaps)
        made = self._learn_words(wanted)
        word = lambda w: made[w] if w in made else self.words[w]
        chunks = {c: word(w[0]) if len(w) == 1 else b"".join(map(word, w)) for c, w in parts.items()}
        self._remember(self.chunks, chunks)
        for split, gaps, got in out:
            for i, piece in gaps or ():
                got[i] = chunks[piece] if split else word(piece)
        return [got if split is None else b"".join(got) for split, _, got in out]


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder of a file; it outlives a task, its words stay known."""
    return kept_by_worker(("encoder", path), lambda: WordEncoder(path))


def best_cuts(pos: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """The cuts, as increasing positions, of least padding plus penalties.

    ``pos`` rises from 0; steps between neighbours are at most ``size``.  The
    last cut is the cheapest within ``size`` of the end (the latest of these);
    what follows it is left over.
    """
    p, q, n = pos.tolist(), penalty.tolist(), len(pos)
    f, back = [0] * n, [0] * n
    queue: deque = deque([(0, 0, 0)])  # (f + pos, pos, index), rising in the first
    for j in range(1, n):
        at = p[j]
        while queue[0][1] < at - size:
            queue.popleft()
        key, _, back[j] = queue[0]
        f[j] = v = key + size - at + q[j]
        v += at
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, at, j))
    j = min((j for j in range(n) if p[j] >= p[-1] - size), key=lambda j: (f[j], -p[j]))
    cuts = []
    while j > 0:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def allowed_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) at which the stream may be cut, from 0."""
    kind = np.full(len(ids) + 1, -1, np.int16)
    kind[0] = 0
    kind[np.flatnonzero(sentence[np.minimum(ids, len(sentence) - 1)]) + 1] = SENTENCE_CUT
    kind[doc_ends] = 0
    at = np.flatnonzero(kind >= 0)
    gaps = np.diff(at, append=len(ids))
    step = min(STEP, size)
    for i in np.flatnonzero(gaps > step):
        kind[at[i] + step : at[i] + gaps[i] : step] = FORCED_CUT
    if kind[-1] < 0:
        kind[-1] = FORCED_CUT
    at = np.flatnonzero(kind >= 0)
    return at, kind[at]


def last_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, size: int) -> list[int]:
    """The cuts, the last at the end, of least padding, penalties and cost of
    short sequences; sequences as long as a power of two are not padded."""
    n, penalty = len(ids), np.full(len(ids) + 1, FORCED_CUT)
    penalty[np.flatnonzero(sentence[np.minimum(ids, len(sentence) - 1)]) + 1] = SENTENCE_CUT
    penalty[doc_ends] = 0
    f, back = np.zeros(n + 1), np.zeros(n + 1, int)
    long = np.arange(size, 0, -1)
    cost = np.where((long & (long - 1)) == 0, 0, size - long) + np.where(long == size, 0, SHORT_SEQUENCE)
    for j in range(1, n + 1):
        first = max(0, j - size)
        total = f[first:j] + cost[size - (j - first) :]
        i = int(total.argmin())
        f[j], back[j] = total[i] + penalty[j], first + i
    cuts, j = [], n
    while j > 0:
        cuts.append(j)
        j = int(back[j])
    return cuts[::-1]


class Packer:
    """Packs one stream of (doc_id, ids) into rows of SCHEMA."""

    def __init__(self, sentence: np.ndarray, size: int, first_sequence: int, block: int = BLOCK, ids: bool = True):
        self.sentence, self.size, self.block, self.sequence, self.ids = sentence, size, block, first_sequence, ids
        self.docs: list[list] = []  # [doc_id, start of what is held, ids held, tokens of the whole document]
        self.held = 0

    def add(self, doc_id: str | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> Iterator[tuple]:
        """Take in a document, or the part from ``start`` of one of ``total`` ids."""
        self.docs.append([doc_id, start, ids, len(ids) if total is None else total])
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.solve()

    def solve(self) -> Iterator[tuple]:
        """What is held up to the last full sequence, as rows."""
        if self.docs:
            ids, ends = self._stream()
            yield from self._cut(best_cuts(*allowed_cuts(ids, ends, self.sentence, self.size), self.size), ends)

    def end(self) -> Iterator[tuple]:
        """All that is held, as rows."""
        yield from self.solve()
        if self.docs:
            ids, ends = self._stream()
            yield from self._cut(last_cuts(ids, ends, self.sentence, self.size), ends)

    def tail(self) -> Iterator[tuple]:
        """All that is held, as rows up to the last full sequence, and rows of
        the tail that belong to no sequence yet."""
        yield from self.solve()
        for k, (doc_id, start, held, total) in enumerate(self.docs):
            yield doc_id, start, len(held), held.tobytes(), 0, total, self.sequence, k, 1

    def _stream(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([d[2] for d in self.docs]), np.cumsum([len(d[2]) for d in self.docs])

    def _cut(self, cuts: list[int], ends: np.ndarray) -> Iterator[tuple]:
        k, begin = 0, 0
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc_id, start, held, total = self.docs[k]
                base = int(ends[k]) - len(held)
                stop = min(cut, int(ends[k]))
                piece = held[begin - base : stop - base].tobytes()
                yield doc_id, start + begin - base, stop - begin, piece if self.ids else None, zlib.crc32(piece), total, self.sequence, offset, 0
                offset += stop - begin
                begin = stop
                if begin == ends[k]:
                    k += 1
            self.sequence += 1
        rest, whole = self.docs[k:], int(ends[-1])
        if rest and begin > (base := int(ends[k]) - len(rest[0][2])):
            rest[0] = [rest[0][0], rest[0][1] + begin - base, rest[0][2][begin - base :].copy(), rest[0][3]]
        self.docs, self.held = rest, whole - begin


def flushed(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of bounded size."""
    out, tokens = [], 0
    for row in rows:
        out.append(row)
        tokens += row[2]
        if tokens >= FLUSH:
            yield pd.DataFrame(out, columns=COLUMNS)
            out, tokens = [], 0
    if out:
        yield pd.DataFrame(out, columns=COLUMNS)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, tokenizer: str | None = None, ids: bool = True, block: int = BLOCK, tails: int = TAILS) -> DataFrame:
    """Pack whole documents into sequences of at most ``size`` ids.

    One row per piece: ``doc_id`` (of any type that strings are cast to),
    ``start`` (the document's ids before it), ``length``, ``ids``
    (little-endian uint32; not with ``ids=False``), ``ids_crc32``,
    ``doc_tokens`` (the document's ids with the final ``END_ID``),
    ``sequence_id``, ``offset`` in the sequence.  A null or empty text is one
    end id.  Rows with equal or null ids are packed one by one.  A text of any
    length is encoded whole.  An empty table gives no rows; other columns are
    left out.  Sequence ids are unique, not gapless.

    Each input partition is one stream in its order, without a shuffle.  Its
    rows are written to the shared folder, so that no text is encoded twice,
    and the tails of each ``tails`` partitions are packed together.
    """
    small_batches(docs.sparkSession)
    path, kind = tokenizer or tokenizer_path(), docs.schema[doc_id].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder_of(path)
        packer = Packer(encode.ends, size, TaskContext.get().partitionId() << 40, block, ids)

        def rows():
            for batch in batches:
                texts = [t or "" for t in batch["t"]]
                sizes = np.cumsum([len(t) for t in texts]) // CHARS
                for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                    for i, own in zip(batch["i"].iloc[at], encode.many([texts[k] for k in at]), strict=True):
                        yield from packer.add(i, np.frombuffer(own + END.tobytes(), "<u4"))
            yield from packer.tail()

        yield from flushed(rows())

    def join_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(encoder_of(path).ends, size, (1 << 61) + (int(key[0]) << 40), block, ids)
        out = []
        for r in frame.sort_values(["sequence_id", "offset"]).itertuples(index=False):
            out += packer.add(r.doc_id, np.frombuffer(r.ids, "<u4"), r.start, r.doc_tokens)
        return pd.DataFrame([*out, *packer.end()], columns=COLUMNS)

    made = stage(docs.select(F.col(f"`{doc_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).mapInPandas(run, SCHEMA), "packed")
    group = F.floor(F.shiftright("sequence_id", 40) / tails).cast("long")
    joined = made.where("tail = 1").groupBy(group.alias("group")).applyInPandas(join_up, SCHEMA)
    columns = [c for c in COLUMNS if c != "tail" and (ids or c != "ids")]
    return made.where("tail = 0").unionByName(joined).select(*columns).withColumn("doc_id", F.col("doc_id").cast(kind))


END = np.array([END_ID], "<u4")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents``, whose ids are told by their checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
