"""Spark data sources of this package: ``keys`` to read binary key files, ``report_log`` to write reports exactly once.

``register`` makes them known to a session. Files are reached through Arrow's file systems, by path
or URI, from the executors.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

#: Keys that are read at once, and keys of a partition.
BLOCK_KEYS, PARTITION_KEYS = 1 << 20, 1 << 25


def place(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa_fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def files_of(path: str) -> list[tuple[str, int]]:
    """(name, keys) of a file, or of a folder's files by name, without hidden ones."""
    fs, inner = place(path)
    info = fs.get_file_info(inner)
    if info.type == pa_fs.FileType.NotFound:
        return []
    found = [info] if info.type == pa_fs.FileType.File else fs.get_file_info(pa_fs.FileSelector(inner))
    return sorted((f.path, f.size // 8) for f in found if f.type == pa_fs.FileType.File and f.base_name[0] not in "._")


@dataclass
class KeyRange(InputPartition):
    """A stretch of a file's keys, and the place of the first."""

    name: str
    at: int
    n: int
    idx: int


class KeyFiles:
    """What the batch and the stream reader share: files into ranges, ranges into rows."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("partition_keys", PARTITION_KEYS))

    def ranges(self, files: list[tuple[str, int]], first: int) -> list[KeyRange]:
        out = []
        for name, n in files:
            out += [KeyRange(name, at, min(self.most, n - at), first + at) for at in range(0, n, self.most)]
            first += n
        return out

    def read(self, partition: KeyRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        fs, _ = place(self.path)
        with fs.open_input_file(partition.name) as f:
            for at in range(0, partition.n, BLOCK_KEYS):
                f.seek(8 * (partition.at + at))
                n = min(BLOCK_KEYS, partition.n - at)
                key = np.frombuffer(f.read(8 * n), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.idx + at), pa.array(key)], ["idx", "key"])


class KeyReader(KeyFiles, DataSourceReader):
    def partitions(self) -> list[KeyRange]:
        return self.ranges(files_of(self.path), 0)


class KeyStreamReader(KeyFiles, DataSourceStreamReader):
    """Files that appear in a folder, in order of their names; an offset is the last name and the keys up to it.

    New names must sort after those read: one with a smaller name is never seen.
    """

    def initialOffset(self) -> dict:
        return {"name": "", "keys": 0}

    def latestOffset(self) -> dict:
        found = files_of(self.path)
        return {"name": found[-1][0], "keys": sum(n for _, n in found)} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        return self.ranges([x for x in files_of(self.path) if start["name"] < x[0] <= end["name"]], start["keys"])

    def commit(self, end: dict) -> None:
        pass  # the files stay, and can be read again from any offset


class KeySource(DataSource):
    """(idx, key) of little-endian unsigned 64-bit keys in files; option ``path``, and ``partition_keys``."""

    @classmethod
    def name(cls) -> str:
        return "keys"

    def schema(self) -> str:
        return "idx long, key long"

    def reader(self, schema) -> KeyReader:
        return KeyReader(self.options)

    def streamReader(self, schema) -> KeyStreamReader:
        return KeyStreamReader(self.options)


@dataclass
class WrittenPart(WriterCommitMessage):
    name: str | None


class ReportLogWriter(DataSourceStreamWriter):
    """A log of which every batch is there once, whatever tasks or batches are repeated.

    Each task writes a file under a name of its own. The commit of a batch writes a list of its files,
    which appears at once, under the batch's number; a list that is there already stays, and what the
    repeated batch has written is deleted. Readers read the listed files only.
    """

    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns

    def write(self, rows: Iterator) -> WrittenPart:
        fs, inner = place(self.path)
        lines = (f"{row['value']}\n".encode() for row in rows)
        first = next(lines, None)
        if first is None:
            return WrittenPart(None)
        fs.create_dir(f"{inner}/parts", recursive=True)
        name = f"{uuid.uuid4().hex}.log"
        with fs.open_output_stream(f"{inner}/parts/{name}") as f:
            f.write(first)
            for line in lines:
                f.write(line)
        return WrittenPart(name)

    def commit(self, messages: list[WrittenPart | None], batchId: int) -> None:
        fs, inner = place(self.path)
        told = f"{inner}/batches/{batchId:012d}.json"
        if fs.get_file_info(told).type != pa_fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        fs.create_dir(f"{inner}/batches", recursive=True)
        aside = f"{inner}/batches/_{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps([m.name for m in messages if m and m.name]).encode())
        fs.move(aside, told)

    def abort(self, messages: list[WrittenPart | None], batchId: int) -> None:
        fs, inner = place(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{inner}/parts/{m.name}")


class ReportLog(DataSource):
    """Lines (value) to a log in the folder ``path``, each batch once."""

    @classmethod
    def name(cls) -> str:
        return "report_log"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> ReportLogWriter:
        return ReportLogWriter(self.options, [f.name for f in schema])


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session."""
    for source in (KeySource, ReportLog):
        spark.dataSource.register(source)


def read_report_log(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value): the lines of the batches that were committed."""
    listed = spark.read.option("pathGlobFilter", "*.json").text(f"{path}/batches", wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    parts = listed.select(F.regexp_extract(name, "[0-9]+", 0).cast("long").alias("batch"), F.explode(F.from_json("value", "array<string>")).alias("part"))
    lines = spark.read.text(f"{path}/parts", pathGlobFilter="*.log").select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"))
    return lines.join(parts, "part").select("batch", "value")
