"""A text file for each video in its own folder, written and read by tasks: the driver lists no files.

The folders are those of ``partitionBy("video_stem")``, so Spark's readers find the same tables.  A table of many videos has as many
files, and Spark's writer and reader keep the name of each on the driver; here a task writes the files of its videos, and a reading
task walks through the folder's names and takes its share of them.  The path must be on storage that every executor mounts.
"""

from __future__ import annotations

import itertools
import os
import re
import shutil
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

KEY, MISSING, DONE = "video_stem=", "__HIVE_DEFAULT_PARTITION__", "_SUCCESS"
#: Rows of an Arrow batch.
BATCH_ROWS = 1 << 14
#: What Spark writes as %XX in a folder's name.
_SPECIAL = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def mounted(path: str) -> str | None:
    """The path as tasks open it; None for another store."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        return None
    return os.path.abspath(unquote(parts.path) if parts.scheme and "%" in parts.path else path.removeprefix("file://").removeprefix("file:"))


def folder(stem: str | None) -> str:
    return KEY + (_SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", stem) if stem else MISSING)


def stem_of(name: str) -> str | None:
    text = name.removeprefix(KEY)
    return None if text == MISSING else re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def _folders(path: str) -> Iterator[str]:
    with os.scandir(path) as found:
        yield from (e.name for e in found if e.name.startswith(KEY))


class _Share(InputPartition):
    def __init__(self, part: int, of: int) -> None:
        self.part, self.of = part, of


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: int) -> None:
        self.path, self.parts = path, parts

    def partitions(self) -> list[_Share]:
        if not os.path.isdir(self.path):
            raise FileNotFoundError(self.path)
        return [_Share(i, self.parts) for i in range(self.parts)]

    def _lines(self, share: _Share) -> Iterator[tuple[str | None, str]]:
        for name in _folders(self.path):
            if zlib.crc32(name.encode("utf-8", "surrogateescape")) % share.of != share.part:
                continue
            stem = stem_of(name)
            for file in sorted(os.listdir(f"{self.path}/{name}")):
                if file.startswith(("_", ".")):
                    continue
                with open(f"{self.path}/{name}/{file}", encoding="utf-8", errors="replace") as lines:
                    rows = (line.rstrip("\n") for line in lines)
                    yield from ((stem, row) for row in itertools.islice((r for r in rows if r.strip()), 1, None))  # after the heading

    def read(self, share: _Share) -> Iterator[pa.RecordBatch]:
        rows = self._lines(share)
        while held := list(itertools.islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.string()) for i in (0, 1)], names=["video_stem", "line"])


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceArrowWriter):
    """A file appears whole; its name depends on the task's number alone, so a task that runs twice writes it twice."""

    def __init__(self, path: str, heading: str, overwrite: bool) -> None:
        self.path, self.heading = path, heading
        if overwrite and os.path.isdir(path):
            with os.scandir(path) as found:  # one by one: the names of all are many
                for e in found:
                    shutil.rmtree(e.path) if e.is_dir(follow_symlinks=False) else os.remove(e.path)
        os.makedirs(path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        name, files = f"part-{context.partitionId():05d}.csv", 0
        rows = itertools.chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
        for stem, lines in itertools.groupby(rows, key=lambda r: r[0]):
            at = f"{self.path}/{folder(stem)}"
            os.makedirs(at, exist_ok=True)
            hidden = f"{at}/.{name}.{context.taskAttemptId()}"
            with open(hidden, "w", encoding="utf-8", newline="\n") as out:
                out.writelines(itertools.chain([self.heading, "\n"], itertools.chain.from_iterable((line, "\n") for _, line in lines)))
            os.replace(hidden, f"{at}/{name}")
            files += 1
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        with open(f"{self.path}/{DONE}", "w"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What tasks have put in place stays, without the mark of a whole table."""


class VideoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video_files"

    def schema(self) -> str:
        return "video_stem string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["parts"]))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["heading"], overwrite)


def write(lines: DataFrame, path: str, heading: str) -> None:
    """Rows (video_stem, line), a video's rows together in one task; what the path held before goes."""
    lines.sparkSession.dataSource.register(VideoFiles)
    lines.select("video_stem", "line").write.format("video_files").mode("overwrite").option("heading", heading).save(path)


def read(spark: SparkSession, path: str, parts: int) -> DataFrame:
    """Rows (video_stem, line) without headings, in so many tasks."""
    spark.dataSource.register(VideoFiles)
    return spark.read.format("video_files").option("parts", str(parts)).load(path)
