"""Mbox files and loose messages.

``read_mbox`` reads files of any size from any store that Spark knows. The data source ``mbox`` reads them from
a file system that all machines mount. Either cuts a file into ranges, and a range owns the messages that begin in it.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..kernel import mailbox
from .files import read_files

#: What ends a record: a newline and the From_ line behind it. So many files at most are read at once, as a row of each is broadcast.
MARK, MOST_FILES = "\nFrom ", 1 << 20
SCHEMA = "path string, seq long, internal_date long, envelope_from string, raw binary, error string"


def split_mbox(df: DataFrame, column: str, flush: int = 4 << 20) -> DataFrame:
    """One row for each message in the mboxes of a binary column; other columns are repeated.

    Adds seq (from 0), internal_date (UTC seconds, 0 if not valid), envelope_from and raw. Null and
    text without a From_ line give no rows.
    """
    kept = [c for c in df.columns if c != column]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("binary").alias("__mbox"))
    out = source.drop("__mbox").withColumns({"seq": F.lit(0).cast("long"), "internal_date": F.lit(0).cast("long"), "envelope_from": F.lit(""), "raw": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(b.num_columns - 1)[i]
                held, size, seq = [], 0, 0
                for message in mailbox.split_mbox(data.as_buffer() if data.is_valid else b""):
                    held.append((seq, *message))
                    size += len(message[2])
                    seq += 1
                    if size >= flush:
                        yield _rows(b, i, held, [*kept, "seq", "internal_date", "envelope_from", "raw"])
                        held, size = [], 0
                if held:
                    yield _rows(b, i, held, [*kept, "seq", "internal_date", "envelope_from", "raw"])

    return source.mapInArrow(run, out)


def _rows(batch: pa.RecordBatch, i: int, held: list[tuple], names: list[str]) -> pa.RecordBatch:
    again = pa.array([i] * len(held))
    seq, date, sender, raw = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([*(c.take(again) for c in batch.columns[:-1]), pa.array(seq, pa.int64()), pa.array(date, pa.int64()), pa.array(sender, pa.string()), pa.array(raw, pa.binary())], names)


def read_mbox(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Messages of mbox files of any size on any store that Spark reads: path, seq, internal_date, envelope_from, raw.

    Spark's text reader cuts files behind each newline that a From_ line follows, so that a record is a message, whole
    even where it goes on in the next range. ``seq`` grows with the place of the message in its file.
    """
    reader = spark.read.option("lineSep", MARK).option("recursiveFileLookup", recursive)
    records = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("data"))
    # The last record of a file has no mark behind it, and so no newline that the mark took. It is in the last range that has any.
    last = records.groupBy("path").agg(F.max("start").alias("last"))
    if last.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files at once")
    return records.join(F.broadcast(last), "path").mapInArrow(_messages, SCHEMA.replace(", error string", ""))


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, at, held, out = None, 0, None, []

    def flush(final: bool) -> None:
        nonlocal held
        if held is not None:
            out.extend((*held[:2], *m) for m in mailbox.split_mbox(held[2] + (b"" if final else b"\n")))
            held = None

    def send() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["path", "seq", "internal_date", "envelope_from", "raw"])
        out.clear()
        return batch

    for b in batches:
        size = 0
        for path, start, last, data in zip(*(b.column(n) for n in ("path", "start", "last", "data")), strict=True):
            here = (path.as_py(), start.as_py(), last.as_py())
            if here != key:
                flush(key is not None and key[1] == key[2])
                key, at = here, 0
            flush(False)
            raw = data.as_py()
            # only the head of a file has its first From_ whole
            head = b"" if here[1] == 0 and at == 0 else b"From "
            # in a range that is not the first, a whole mark lies before the first record
            held = (here[0], here[1] + at + len(MARK) * (here[1] > 0), head + raw)
            at += len(raw) + len(MARK)
            size += len(raw)
            if size > 4 << 20:
                if out:
                    yield send()
                size = 0
    flush(key is not None and key[1] == key[2])
    if out:
        yield send()


def read_eml(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """One message a file: path, internal_date (modification time), raw."""
    return read_files(spark, path, recursive).select("path", "internal_date", "raw")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _MboxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"].removeprefix("file://"), int(options.get("splitbytes", 128 << 20))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[_Range]:
        names = sorted(f for p in glob.glob(self.path) for f in ([p] if os.path.isfile(p) else glob.glob(os.path.join(glob.escape(p), "*"))) if os.path.isfile(f))
        return [_Range(f, lo, min(lo + self.size, n)) for f in names for n in [os.path.getsize(f)] for lo in range(0, n, self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as f:
                for row in self._messages(f, partition):
                    yield *row, None
        except OSError as e:
            if self.strict:
                raise
            yield partition.path, None, None, None, None, str(e)

    @staticmethod
    def _messages(f, part: _Range) -> Iterator[tuple]:
        """Messages whose From_ line begins in the range; ``seq`` is that line's offset, in order within a file."""
        at = max(0, part.start - 1)
        f.seek(at)
        if part.start:
            at += len(f.readline())  # the line that the range before owns
        begin = None

        def lines() -> Iterator[bytes]:
            nonlocal at, begin
            for line in f:
                if line.startswith(b"From "):
                    if at >= part.end:
                        return
                    begin = begin or []
                    begin.append(at)
                at += len(line)
                yield line

        for i, (date, sender, raw) in enumerate(mailbox.split_lines(lines())):
            yield part.path, begin[i], date, sender, raw


class MboxDataSource(DataSource):
    """``spark.read.format("mbox").load(path or glob)``; options splitBytes and mode.

    Mode PERMISSIVE gives a row with ``error`` and no message where a range can't be read to its end, FAILFAST ends the job.
    """

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _MboxReader({k.lower(): v for k, v in dict(self.options).items()})
