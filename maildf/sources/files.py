"""Whole files, many and small: on mounted file systems listed by names alone and read by the thousand."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, internal_date long, size long, raw binary"


def read_files(spark: SparkSession, path: str | list[str], recursive: bool = False, contents: bool = True) -> DataFrame:
    """One row a file: path, internal_date (modification time), size, raw; without ``contents`` raw is null and nothing is opened.

    Spark's ``binaryFile`` reads stores that are not mounted. It lists each file of a glob on its own and counts each
    file as 4 MB, which makes a task of some 32; here a task reads a thousand.
    """
    roots = _mounted(spark, path)
    if roots is None:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        raw = F.col("content") if contents else F.lit(None).cast("binary")
        return rows.select("path", F.unix_seconds("modificationTime").alias("internal_date"), F.col("length").alias("size"), raw.alias("raw"))
    spark.dataSource.register(FilesDataSource)
    return spark.read.format("maildf_files").option("roots", json.dumps(roots)).option("recursive", recursive).option("contents", contents).load()


def _mounted(spark: SparkSession, path: str | list[str]) -> list[str] | None:
    """The files and folders that ``path`` names, if all are there and on a mounted file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for one in [path] if isinstance(path, str) else path:
        p = jvm.org.apache.hadoop.fs.Path(one)
        fs = p.getFileSystem(conf)
        if fs.getUri().getScheme() != "file":
            return None
        found = fs.globStatus(fs.makeQualified(p))
        if not found:
            return None  # Spark says what is missing
        job = jvm.org.apache.hadoop.mapred.JobConf(False)
        jvm.org.apache.hadoop.mapred.FileInputFormat.setInputPaths(job, jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
        joined = job.getRaw("mapreduce.input.fileinputformat.inputdir")  # all names in one call, with escaped commas
        out += [re.sub(r"\\(.)", r"\1", x, flags=re.S).removeprefix("file:") for x in re.findall(r"(?:[^\\,]|\\.)+", joined, re.S)]
    return out


def _hidden(name: str) -> bool:
    """As Spark's readers see it."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _walk(root: str, recursive: bool) -> Iterator[str]:
    """Files of a folder, and of those below it if asked or if they are named like partitions."""
    if not os.path.isdir(root):
        if not _hidden(os.path.basename(root)):
            yield root
        return
    for e in os.scandir(root):
        if _hidden(e.name):
            continue
        if e.is_dir():
            if recursive or "=" in e.name:
                yield from _walk(e.path, recursive)
        elif e.is_file():
            yield e.path


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(len(names))
        self.names = names


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.files = json.loads(options["roots"]), int(options.get("filesperpartition", 1000))
        self.recursive, self.contents = (options.get(n, "true") == "true" for n in ("recursive", "contents"))

    def partitions(self) -> list[_Names]:
        names = [x for r in self.roots for x in _walk(r, self.recursive)]
        return [_Names(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [_Names([])]

    def read(self, partition: _Names) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for name in partition.names:
            raw, stat = None, os.stat(name)
            if self.contents:
                with open(name, "rb") as f:
                    raw = f.read()
                size += len(raw)
            shown = "file:" + os.fsencode(name).decode("utf-8", "replace")
            held.append((shown, int(stat.st_mtime // 1), stat.st_size if raw is None else len(raw), raw))
            if size > 4 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["path", "internal_date", "size", "raw"])


class FilesDataSource(DataSource):
    """``read_files`` of mounted folders; options roots (JSON), recursive, contents, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "maildf_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader({k.lower(): v for k, v in dict(self.options).items()})
