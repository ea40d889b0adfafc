"""A versioned store of tables: every change writes new folders, then a numbered
manifest that names the current folder of every table.  A manifest is never
changed or replaced, so readers see the tables of one manifest or of the one
before, and a crash leaves the last one that is whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane import schemas


class Store:
    """Tables under a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """(number, folder of each table) of the last manifest; (0, none) before."""
        fs, p = self._fs(f"{self.root}/manifests")
        found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")] if fs.exists(p) else []
        if not found:
            return 0, {}
        last = max(found, key=lambda f: f.getName())
        stream = fs.open(last)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(last.getName().split(".")[0]), json.loads(text)

    def _commit(self, fresh: dict[str, str]) -> None:
        """The next manifest, with ``fresh`` folders: written under another name
        and renamed, which fails if somebody else has made it meanwhile; then
        the one after that is tried, on top of theirs."""
        for _ in range(10):
            n, tables = self._manifest()
            fs, target = self._fs(f"{self.root}/manifests/{n + 1:010}.json")
            _, written = self._fs(f"{self.root}/manifests/.{uuid.uuid4().hex}")
            out = fs.create(written, True)
            out.write(bytearray(json.dumps(tables | fresh).encode()))
            out.close()
            if not fs.exists(target) and fs.rename(written, target):
                return
            fs.delete(written, False)
        raise RuntimeError(f"{self.root}: others change the store all the time")

    def _current(self, table: str) -> str | None:
        return self._manifest()[1].get(table)

    def read(self, table: str, schema: str) -> DataFrame:
        """The current version; an empty table if there is none.  Columns of a
        newer schema that the version lacks are null."""
        at = self._current(table)
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{at}")

    def replace(self, table: str, rows: DataFrame, partition: tuple[str, ...] = ()) -> str:
        """Write a new version and make it current; the older ones stay until
        ``vacuum``.  A failure before the last step changes nothing."""
        name = self._write(table, rows, partition)
        self._commit({table: name})
        return name

    def replace_all(self, tables: dict[str, DataFrame]) -> None:
        """New versions of several tables, which become current at once."""
        self._commit({table: self._write(table, rows) for table, rows in tables.items()})

    def _write(self, table: str, rows: DataFrame, partition: tuple[str, ...] = ()) -> str:
        name = f"v{schemas.VERSION}-{uuid.uuid4().hex}"
        (rows.write.partitionBy(*partition) if partition else rows.write).parquet(f"{self.root}/{table}/{name}")
        return name

    def update(self, table: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> str:
        return self.replace(table, change(self.read(table, schema)))

    def append(self, table: str, rows: DataFrame) -> None:
        """For logs: rows added to the current version; it starts with them."""
        at = self._current(table)
        if at is None:
            self.replace(table, rows)
        else:
            rows.write.mode("append").parquet(f"{self.root}/{table}/{at}")

    def write_text(self, name: str, text: str) -> None:
        """A small file beside the tables."""
        fs, at = self._fs(f"{self.root}/{name}")
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def version(self, table: str) -> int:
        """The schema version a table was written with; 0 without a table."""
        at = self._current(table)
        return int(at[1:].split("-")[0]) if at else 0

    def vacuum(self, table: str) -> None:
        """Delete all but the current version of a table, and all manifests but
        the last."""
        number, tables = self._manifest()
        at = tables.get(table)
        fs, p = self._fs(f"{self.root}/{table}")
        for f in fs.listStatus(p) if fs.exists(p) else ():
            if f.isDirectory() and f.getPath().getName() != at:
                fs.delete(f.getPath(), True)
        fs, p = self._fs(f"{self.root}/manifests")
        for f in fs.listStatus(p) if fs.exists(p) else ():
            if f.getPath().getName().endswith(".json") and int(f.getPath().getName().split(".")[0]) < number:
                fs.delete(f.getPath(), False)
