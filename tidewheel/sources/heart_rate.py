"""Heart-rate logs as a Spark data source that cuts long JSON arrays at any byte.

A file is an array of flat records with keys in one order. A partition is a range of a file's bytes; it has the records that start in its range, reads on a little
beyond its end for the last of them, and finds its first one by the shape of a record. Bounds of bpm and confidence are checked while bytes are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .archive import moment

# Fixed value: the shape of a record.
RECORD = re.compile(rb'\{\s*"dateTime"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*\{\s*"bpm"\s*:\s*(\d+)\s*,\s*"confidence"\s*:\s*(\d+)\s*\}\s*\}')
#: Bytes of one read; the longest record, with its white space.
CHUNK, LONGEST = 1 << 20, 512
SCHEMA = "person string, at long, datetime string, bpm int, confidence int"
_ARROW = pa.schema([("person", pa.string()), ("at", pa.int64()), ("datetime", pa.string()), ("bpm", pa.int32()), ("confidence", pa.int32())])
_TESTS = {GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, EqualTo: lambda x, v: x == v}


class Range(InputPartition):
    def __init__(self, person: str, path: str, begin: int, end: int):
        self.person, self.path, self.begin, self.end = person, path, begin, end


class HeartRateSource(DataSource):
    """Options: root, a path or URI with folders p1, p2, ...; below, the file in each; split, bytes of a partition; push, whether filters are."""

    @classmethod
    def name(cls) -> str:
        return "heart_rate_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BoundedReader(self.options) if self.options.get("push") == "true" else HeartRateReader(self.options)


class HeartRateReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.below = options["root"], options.get("below", "fitbit/heart_rate.json")
        self.split = max(1, int(options.get("split", 32 << 20)))
        self.bounds: list[tuple[int, type, int]] = []

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        found = []
        for folder in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if folder.type == fs.FileType.Directory and re.fullmatch(r"p\d+", folder.base_name):
                info = system.get_file_info(f"{folder.path}/{self.below}")
                if info.type == fs.FileType.File:
                    found += [Range(folder.base_name, info.path, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
        return found or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.begin:
            return
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(partition.path) as file:
            file.seek(partition.begin)
            base, buffer, last = partition.begin, b"", False
            while not last:
                # Records that start before the end may run LONGEST bytes beyond it.
                chunk = file.read(min(CHUNK, max(0, partition.end + LONGEST - base - len(buffer))))
                buffer += chunk
                last = not chunk
                rows, used = [], 0
                for m in RECORD.finditer(buffer):
                    if base + m.start() >= partition.end:
                        last = True
                        break
                    used = m.end()
                    values = (m[1], base + m.start(), int(m[2]), int(m[3]))
                    if all(_TESTS[kind](values[column], bound) for column, kind, bound in self.bounds):
                        rows.append((partition.person, values[1], m[1].decode(), values[2], values[3]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                drop = used or max(0, len(buffer) - LONGEST)
                base, buffer = base + drop, buffer[drop:]


class BoundedReader(HeartRateReader):
    """Takes bounds of bpm and confidence over from Spark. A reader that does so is an error where pushing filters is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = {("bpm",): 2, ("confidence",): 3}.get(getattr(f, "attribute", None))
            if column and type(f) in _TESTS and isinstance(f.value, int):
                self.bounds.append((column, type(f), f.value))
            else:
                yield f


def samples(spark: SparkSession, root: str, split: int = 32 << 20, low: int = 30, high: int = 220, confidence: int = 1) -> DataFrame:
    """(person, event_id, ts, bpm, confidence) of samples within bounds, as the interval join takes them; event_id is a record's place in its file.

    Without any file there are no rows. Where Spark pushes filters to Python sources, the bounds are checked in the reader, else after it.
    """
    spark.dataSource.register(HeartRateSource)
    found = spark.read.format("heart_rate_log").options(root=root, split=str(split), push=spark.conf.get("spark.sql.python.filterPushdown.enabled")).load()
    rows = found.where((F.col("bpm") >= low) & (F.col("bpm") <= high) & (F.col("confidence") >= confidence))
    return rows.select("person", F.col("at").alias("event_id"), moment(F.col("datetime")).alias("ts"), "bpm", "confidence").where("ts IS NOT NULL")
