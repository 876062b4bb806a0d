"""Tables that change together: staged writes and one manifest that a rename puts in place.

A table is a list of parts, each a folder of Parquet files; a manifest says which
folders count.  A transaction writes new folders, which nobody reads yet, and
then the next manifest.  If it fails before that, the old state stays; if a task
or a whole run is repeated, the parts it names are replaced, not added to.
Readers keep the state of the manifest they have read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Store:
    """The tables under a folder; schemas by name."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str]) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict[str, dict[str, str]]]:
        """(number, {table: {part: folder}}) of the last manifest."""
        found = self._files.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        names = sorted(f.getPath().getName() for f in found)
        if not names:
            return 0, {}
        stream = self._files.open(self._path(f"{self.root}/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1][9:-5]), json.loads(text)

    def read(self, name: str) -> DataFrame:
        folders = sorted(self._state()[1].get(name, {}).values())
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.root}/{f}" for f in folders))

    def parts(self, name: str) -> list[str]:
        return sorted(self._state()[1].get(name, {}))

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Staged parts of several tables, committed together."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.number, state = store._state()
        self.state = {name: dict(parts) for name, parts in state.items()}

    def put(self, name: str, part: str, rows: DataFrame) -> DataFrame:
        """Writes a part of a table, in place of an older one of the same name; gives the rows as they are written."""
        schema = self.store.schemas[name]
        empty = self.store.spark.createDataFrame([], schema)
        folder = f"{name}/{part}-{uuid.uuid4().hex}"
        rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in empty.schema)).write.parquet(f"{self.store.root}/{folder}")
        self.state.setdefault(name, {})[part] = folder
        return self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{folder}")

    def drop(self, name: str, part: str) -> None:
        self.state.get(name, {}).pop(part, None)

    def commit(self) -> None:
        """Puts the next manifest in place; raises if another transaction came first."""
        files, path = self.store._files, self.store._path
        if self.store._state()[0] != self.number:
            raise RuntimeError("the tables have changed meanwhile; begin again")
        hidden = path(f"{self.store.root}/.manifest-{uuid.uuid4().hex}")
        files.mkdirs(path(self.store.root))
        stream = files.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(self.state, sort_keys=True).encode()))
        finally:
            stream.close()
        at = path(f"{self.store.root}/manifest-{self.number + 1:09d}.json")
        if files.exists(at) or not files.rename(hidden, at):
            raise RuntimeError("the tables have changed meanwhile; begin again")
        self.number += 1
