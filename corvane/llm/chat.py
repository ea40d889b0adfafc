"""Chat formatting with prefix-target expansion.

Every assistant turn becomes its own example: all turns before it as context
and only that reply under the loss mask.  Turns after the last reply (or a
conversation without one) give one more example without a target, so nothing
is lost and the turns can be read back from the output.

Template: ``<s>`` starts an example; a turn is ``[ROLE]`` + its text + the
closing mark, with the marks below for the usual roles and
``[TURN]role[/TURN]`` for others.  Inside texts and role names a backslash
before a character makes it ordinary: backslashes are doubled and the second
character of every control string is preceded by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import small_batches

OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[REPLY]"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
START, OTHER, OTHER_END, CLOSE_OTHER = "<s>", "[TURN]", "[/TURN]", "[/END]"
CONTROLS = [START, *OPEN.values(), *CLOSE.values(), OTHER, OTHER_END, CLOSE_OTHER]
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_MARK = re.compile("|".join(map(re.escape, CONTROLS)))
#: Characters of examples that are handed on at once.
FLUSH_CHARS = 1 << 22

EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long, n_turns long, last boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(formatted turn, start and end of the text's part in it).  A null role
    is the empty role."""
    body, role = escape(text or ""), role or ""
    head = OPEN.get(role) or OTHER + escape(role) + OTHER_END
    return head + body + CLOSE.get(role, CLOSE_OTHER), len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of an example."""
    roles = {v: k for k, v in OPEN.items()}
    turns, at = [], len(START)
    while at < len(text):
        mark = _MARK.match(text, at)
        at = mark.end()
        if mark[0] == OTHER:
            end = text.index(OTHER_END, at)
            role, at = unescape(text[at:end]), end + len(OTHER_END)
        else:
            role = roles[mark[0]]
        close = CLOSE.get(role, CLOSE_OTHER)
        end = text.index(close, at)
        turns.append((role, unescape(text[at:end])))
        at = end + len(close)
    return turns


def expand(turns: Iterable[tuple[str | None, str | None]]) -> Iterator[tuple[int, str, int, int, int, bool]]:
    """(example, text, loss_start, loss_end, n_turns, last) for one conversation in order."""
    parts, size, example, n, pending = [START], len(START), 0, 0, None
    for role, text in turns:
        turn, a, b = format_turn(role, text)
        n += 1
        if pending:
            yield *pending, False
            pending = None
        parts.append(turn)
        if role == "assistant":
            parts = ["".join(parts)]
            pending = (example, parts[0], size + a, size + b, n)
            example += 1
        size += len(turn)
    if pending:
        yield *pending, True
    elif n:
        yield example, "".join(parts), size, size, n, True


def _flush(rows: Iterator[tuple], columns: list[str], chars) -> Iterator[pd.DataFrame]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += chars(row)
        if size >= FLUSH_CHARS:
            yield _frame(out, columns)
            out, size = [], 0
    if out:
        yield _frame(out, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    made = dict(zip(columns, zip(*rows, strict=True), strict=True))
    return pd.DataFrame(made | {"conv_id": pd.array(made["conv_id"], dtype="Int64")})


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with one key (a number as text, since pandas would make
    floats of numbers with nulls), each an iterator that must be used up."""
    import itertools

    rows = (r for b in batches for r in b.itertuples(index=False))
    for k, run in itertools.groupby(rows, key=lambda r: getattr(r, key)):
        yield None if k is None else int(k), run


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: EXAMPLES.  Rows of a conversation are ordered by
    turn (nulls first), ties by role and text; repeated rows are turns like
    any other.  Null texts are empty, null conversation ids are one
    conversation, other columns are left out, and an empty table gives no
    rows.  Turns stream through a task sorted; a conversation is never
    gathered, only the formatted prefix is held that its examples share.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("o"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "o", "r", "t").select(F.col("conv_id").cast("string"), "r", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = ((c, *e) for c, own in _grouped(batches, "conv_id") for e in expand((None if x.r is None else x.r, x.t) for x in own))
        yield from _flush(examples, ["conv_id", "example", "text", "loss_start", "loss_end", "n_turns", "last"], lambda e: len(e[2]))

    return rows.mapInPandas(run, EXAMPLES)


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their texts
    and loss spans.  The examples of a conversation must follow each other, as
    ``format_conversations`` gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for conv, own in _grouped(batches, "conv_id"):
                loss, loss_chars, chars, last = hashlib.sha256(), 0, 0, ""
                for e in own:
                    target = unescape(e.text[int(e.loss_start) : int(e.loss_end)])
                    loss.update(target.encode("utf-8", "surrogatepass"))
                    loss_chars, chars, last = loss_chars + len(target), chars + len(e.text), e.text
                turns = read_turns(last)
                whole = hashlib.sha256()
                for r, t in turns:
                    whole.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
                yield conv, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _flush(rows(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], lambda r: 200)

    return examples.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    one = lambda turn, role: spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), said)
    return digest_examples(format_conversations(turns.unionByName(one(0, "user")).unionByName(one(1, "assistant"))))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]')),
f AS (
  SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 11 ELSE 19 + length(role) END
    + length(regexp_replace(text, '\\|</?s>|\[/?(SYS|INST|TURN)\]|\[REPLY\]|\[/END\]', 'x\0', 'g')) AS size
  FROM t),
c AS (
  SELECT *, 3 + sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
         turn = max(turn) OVER (PARTITION BY conv_id) AS is_last
  FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR is_last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
