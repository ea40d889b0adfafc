"""What several operators share: words, shared folders, batches, labels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words (all ASCII but letters and digits) become spaces
#: and A-Z become a-z; bytes of other scripts stay, so a word is exactly
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT: dict = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, such as words it has met.
    It holds one such thing: another key's makes room first, and what that frees
    goes back to the system, so the operators of a pipeline do not add up in a
    worker's memory."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset
    a local session, as in tests, gets a folder of its own; on a cluster rows
    would be lost on the executors' own disks, so that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.gettempdir() + "/corvane-shared"
    return at.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: this cuts the
    lineage, and a lost executor loses none of it."""
    at = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_stage(spark: SparkSession, df: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for f in df.inputFiles()[:1]:
        folder = hadoop(f).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Staged:
    """``stage`` that remembers what it wrote, to delete it once it is used up."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.made.append(stage(df, label))
        return self.made[-1]

    def drop(self, *used: DataFrame) -> None:
        """Delete ``used``; all, if none is named."""
        for df in used or self.made:
            drop_stage(df.sparkSession, df)
        self.made = [d for d in self.made if used and all(d is not u for u in used)]


#: Bytes of an Arrow batch, about: whole texts can be very long.
BATCH_BYTES = 4 << 20
#: What Spark itself has set.
SPARKS_BYTES = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by its bytes, and let Python workers import this
    package from where the driver has it.  A limit that the caller has set stays;
    ours stays set, since plans are only made when the caller asks for rows."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, SPARKS_BYTES) == SPARKS_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds
