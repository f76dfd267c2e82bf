"""Maildir folders, in batch and as a stream."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..kernel import mailbox

SCHEMA = "folder string, path string, internal_date long, flags array<string>, raw binary, error string"
_SKIPPED = ("cur", "new", "tmp")


def maildir_flags(name: Column | str) -> Column:
    """Flags behind the last "2," of a file name, in order, up to the first character that is no letter or digit."""
    n = F.col(name) if isinstance(name, str) else name
    letters = F.split(F.regexp_extract(n, r"(?s)^.*2,([A-Za-z0-9]*)", 1), "")
    table = F.create_map(*[F.lit(x) for pair in mailbox.MBOX_FLAGS.items() for x in pair])
    return F.filter(F.transform(letters, lambda c: table[c]), lambda f: f.isNotNull())


def folders(path: str, prefix: str | None = ".") -> Iterator[tuple[str | None, str]]:
    """(name, directory) of a mailbox and its folders, depth first; the inbox has no name.

    ``prefix`` "." is Maildir++; None means plain nested directories, whose names are joined by "/".
    Directories without both cur and new are no folders but are searched further.
    """
    whole = lambda d: all(os.path.isdir(os.path.join(d, x)) for x in ("cur", "new"))
    if whole(path):
        yield None, path

    def walk(top: str, names: list[str]) -> Iterator[tuple[str, str]]:
        for entry in sorted(os.scandir(top), key=lambda e: e.name):
            if not entry.is_dir() or entry.name in _SKIPPED or prefix is not None and not entry.name.startswith(prefix):
                continue
            here = [*names, entry.name.removeprefix(prefix or "")]
            if whole(entry.path):
                yield (prefix or "/").join(here), entry.path
            yield from walk(entry.path, here)

    yield from walk(path, [])


class _Files(InputPartition):
    def __init__(self, folder: str | None, names: list[str]):
        super().__init__((folder, len(names)))
        self.folder, self.names = folder, names


class _MaildirReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.prefix = None if options.get("layout", "maildir++") == "fs" else "."
        self.files = int(options.get("filesperpartition", 2000))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[_Files]:
        out = []
        for folder, top in folders(self.path, self.prefix):
            names = [e.path for sub in ("cur", "new") for e in sorted(os.scandir(os.path.join(top, sub)), key=lambda e: e.name) if e.is_file() and not e.name.startswith(".")]
            out += [_Files(folder, names[i : i + self.files]) for i in range(0, len(names), self.files)]
        return out or [_Files(None, [])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for listed in partition.names:
            name = listed if os.path.exists(listed) else self._moved(listed)
            flags = mailbox.maildir_flags(os.path.basename(name))
            try:
                with open(name, "rb") as f:
                    yield partition.folder, name, int(os.fstat(f.fileno()).st_mtime), flags, f.read(), None
            except OSError as e:
                if self.strict:
                    raise
                yield partition.folder, name, None, flags, None, str(e)

    @staticmethod
    def _moved(listed: str) -> str:
        """Where a mail is now that its reader has seen it or changed its flags since the listing."""
        top, unique = os.path.dirname(os.path.dirname(listed)), os.path.basename(listed).partition(":2,")[0]
        return next(iter(sorted(glob.glob(os.path.join(glob.escape(top), "cur", glob.escape(unique) + ":2,*")))), listed)


class MaildirDataSource(DataSource):
    """``spark.read.format("maildir").load(path)`` of a mounted file system; options layout (maildir++ or fs), filesPerPartition and mode.

    Mode PERMISSIVE gives a row with ``error`` and no bytes for a mail that can't be read, FAILFAST ends the job.
    """

    @classmethod
    def name(cls) -> str:
        return "maildir"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _MaildirReader({k.lower(): v for k, v in dict(self.options).items()})


def _shape(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~name.startswith(".")).select("path", F.unix_seconds("modificationTime").alias("internal_date"), maildir_flags(name).alias("flags"), F.col("content").alias("raw"))


def read_maildir(spark: SparkSession, path: str, prefix: str | None = ".") -> DataFrame:
    """A mailbox on any store that Spark knows: folder, path, internal_date, flags, raw.

    Directories are listed through Hadoop on the driver; the messages are read by Spark. Files whose
    names begin with "_" are hidden from Spark's readers; the data source ``maildir`` reads them too.
    A mounted file system is read by that data source, as Hadoop's own can't open names with colons.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        spark.dataSource.register(MaildirDataSource)
        return spark.read.format("maildir").option("layout", "fs" if prefix is None else "maildir++").load(path)
    found: list[tuple[str | None, str]] = []

    def walk(top, names: list[str]) -> None:
        subs = {s.getPath().getName(): s.getPath() for s in fs.listStatus(top) if s.isDirectory()}
        if "cur" in subs and "new" in subs:
            found.append(((prefix or "/").join(names) if names else None, str(top.toString())))
        for n in sorted(subs):
            if n not in _SKIPPED and (prefix is None or n.startswith(prefix)):
                walk(subs[n], [*names, n.removeprefix(prefix or "")])

    walk(p, [])
    if not found:
        return spark.createDataFrame([], SCHEMA)
    names = spark.createDataFrame([(fs.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)).toString(), name) for name, top in found], "top string, folder string")
    rows = _shape(spark.read.format("binaryFile").load([f"{top}/{sub}" for _, top in found for sub in ("cur", "new")]))
    rows = rows.withColumn("top", F.regexp_extract("path", "^(.*)/[^/]*/[^/]*$", 1)).join(F.broadcast(names), "top", "left")  # a row a folder, listed on the driver
    return rows.select("folder", "path", "internal_date", "flags", "raw", F.lit(None).cast("string").alias("error"))


def stream_maildir(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the messages that arrive in ``path/new``; files there never change."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _shape(spark.readStream.format("binaryFile").schema(schema).load(f"{path.rstrip('/')}/new"))
