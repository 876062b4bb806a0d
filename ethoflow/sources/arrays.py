"""Spark data sources: ``.npy`` files, read in row ranges and written slice by slice, and SQLite tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK_ROWS = 2_000_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1 << 16


class _Rows(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: int) -> None:
        self.path, self.block = path, block

    def partitions(self) -> list[_Rows]:
        n = len(np.load(self.path, mmap_mode="r"))
        return [_Rows(i, min(n, i + self.block)) for i in range(0, max(n, 1), self.block)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        data = np.load(self.path, mmap_mode="r")
        for start in range(part.start, part.stop, BATCH_ROWS):
            rows = np.asarray(data[start : min(part.stop, start + BATCH_ROWS)], dtype=float)
            rows = rows.reshape(len(rows), -1)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(rows))), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))], names=["row_index", "values"])


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _Writer(DataSourceArrowWriter):
    """Tasks write their rows at their places of one hidden file, which the commit renames.

    A place depends on the row's number alone, so a task that runs twice writes
    the same bytes twice.  A task that outlives a failed job may leave the hidden file.
    """

    def __init__(self, path: str, rows: int, width: int, kind: str) -> None:
        self.path, self.rows, self.width, self.kind = path, rows, width, np.dtype(kind)
        self.hidden = f"{os.path.dirname(path) or '.'}/.{os.path.basename(path)}.{uuid.uuid4().hex}"

    def _head(self) -> bytes:
        import io

        out = io.BytesIO()
        shape = (self.rows, self.width) if self.width else (self.rows,)
        np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(self.kind), "fortran_order": False, "shape": shape})
        return out.getvalue()

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        head, size, done = self._head(), self.kind.itemsize * max(1, self.width), 0
        file = os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            os.pwrite(file, head, 0)
            for batch in batches:
                at, values = batch.column(0).to_numpy(), batch.column(1)
                flat = values.flatten() if self.width else values
                rows = flat.to_numpy(zero_copy_only=False).astype(self.kind).reshape(len(at), -1)
                if self.width and rows.shape[1] != self.width:
                    raise ValueError(f"rows of {self.width} values are wanted")
                if len(at) and (at.min() < 0 or at.max() >= self.rows):
                    raise ValueError(f"row numbers from 0 to {self.rows - 1} are wanted")
                by = np.argsort(at, kind="stable")
                at, rows = at[by], rows[by]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(part):
                        os.pwrite(file, rows[part].tobytes(), len(head) + int(at[part[0]]) * size)
                done += len(at)
        finally:
            os.close(file)
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sum(m.rows for m in messages if m)
        if done != self.rows:
            self.abort(messages)
            raise ValueError(f"{done} rows instead of {self.rows}")
        if not os.path.exists(self.hidden):  # no task had rows
            with open(self.hidden, "wb") as f:
                f.write(self._head())
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: rows (row_index, values). The path must be on storage that every executor mounts."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_index long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("block", BLOCK_ROWS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options["rows"]), int(self.options.get("width", "0")), self.options.get("dtype", "<f8"))


class _SqliteReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.query, self.key, self.parts = options["path"], options["query"], options.get("key"), int(options.get("parts", "8"))

    def partitions(self) -> list[_Rows]:
        return [_Rows(i, self.parts) for i in range(self.parts)] if self.key else [_Rows(0, 1)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        import sqlite3

        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            where = f" where abs({self.key}) % {part.stop} = {part.start}" if self.key else ""
            yield from db.execute(f"select * from ({self.query}){where}")
        finally:
            db.close()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("query", ...).option("key", "trial_id").load(path)``: read-only, one task a key remainder."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


def write_npy(df: DataFrame, path: str, rows: int, width: int = 0, dtype: str = "<f8") -> None:
    """Rows (row_index, value), or (row_index, array of ``width`` values), as one ``.npy`` file; every number from 0 must be there once.

    The file appears whole or not at all; an older one stays until then.
    """
    register(df.sparkSession)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    df.write.format("npy").mode("append").option("rows", str(rows)).option("width", str(width)).option("dtype", dtype).save(path)


def shape_of(path: str) -> tuple[int, ...]:
    return np.load(path, mmap_mode="r").shape


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(SqliteSource)
