"""Shared helpers: scratch tables, row numbers, skew-safe lookups, components, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from py4j.protocol import Py4JNetworkError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only characters that separate words or are dropped in normalised text.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_LOCAL: dict[str, str] = {}


class Scratch:
    """Tables written to the shared folder of ``spark.checkpoint.dir`` to cut lineage.

    A table outlives a lost executor, since every machine sees the folder. It stays until ``drop()`` or
    ``release()`` is called or the program ends: frames are lazy, so nobody but the caller knows when
    the last one that reads a table has been used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.tables: list[str] = []
        _OPEN.append(self)

    def _base(self) -> str:
        sc = self.spark.sparkContext
        base = self.spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:  # only where none is set, as in tests
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            if "dir" not in _LOCAL:
                _LOCAL["dir"] = tempfile.mkdtemp(prefix="maildf-")
            base = _LOCAL["dir"]
        return base.rstrip("/")

    def path(self, name: str = "t") -> str:
        p = f"{self._base()}/maildf-{name}-{uuid.uuid4().hex}"
        self.paths.append(p)
        return p

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and read it back."""
        p = self.path(name)
        df.write.option("compression", "zstd").parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def bucketed(self, df: DataFrame, key: str, buckets: int, name: str = "t") -> DataFrame:
        """Write ``df`` bucketed and sorted by ``key``, so that joins on it need not move it."""
        p = self.path(name)
        table = p.rsplit("/", 1)[1].replace("-", "_")
        df.write.option("compression", "zstd").option("path", p).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        paths, self.paths = self.paths, []
        tables, self.tables = self.tables, []
        _delete(self.spark, paths, tables)
        if self in _OPEN:
            _OPEN.remove(self)


_OPEN: list[Scratch] = []


@atexit.register
def release() -> None:
    """Delete all scratch tables; results that have not been computed yet can't be any more."""
    while _OPEN:
        _OPEN.pop().drop()


def _delete(spark: SparkSession, paths: list[str], tables: list[str]) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended
        return
    try:
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        for p in paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JNetworkError, ConnectionError):  # the JVM is gone
        return


#: More input files than this are rewritten before rows are numbered; so the list of files that is broadcast stays below 2**20 rows.
MOST_FILES = 1 << 20


def numbered(docs: DataFrame, scratch: Scratch, columns: list[Column], name: str) -> DataFrame:
    """``columns`` of ``docs`` and a long ``name`` that is the row's own: its file's number and its place in that file.

    The number does not depend on how files are split into tasks, so it is the same whenever the frame is
    evaluated again, after an executor is lost or on another number of cores. A frame that is no plain scan of
    Parquet files is written to ``scratch`` first.
    """
    found = _scanned(docs, columns)
    if found is None:
        stored = scratch.table(docs.select(*columns), "rows")
        found = _scanned(stored, [F.col(f"`{c}`") for c in stored.columns])
    rows, files = found
    number = docs.sparkSession.createDataFrame(list(enumerate(files)), "__no long, __file string")
    return rows.join(F.broadcast(number), "__file").withColumn(name, F.shiftleft("__no", 40) + F.col("__at")).drop("__no", "__file", "__at")


def _scanned(docs: DataFrame, columns: list[Column]) -> tuple[DataFrame, list[str]] | None:
    """Rows with file and place, and the files in order; None where ``docs`` is no plain scan or has too many files."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select(*columns, meta["file_path"].alias("__file"), meta["row_index"].alias("__at"))
    except AnalysisException:
        return None
    files = docs.select(meta["file_path"].alias("__file")).distinct()
    listed = [r[0] for r in files.limit(MOST_FILES + 1).collect()]
    return None if len(listed) > MOST_FILES else (rows, sorted(listed))


def lookup(left: DataFrame, facts: DataFrame, key: str, rows: str, share: int = 1000) -> DataFrame:
    """Left-join ``facts`` (one row a key) to ``left`` without gathering a hot key in one task.

    ``facts[rows]`` counts the rows of ``left`` with that key. Keys with more than 1/``share`` of all
    rows number fewer than ``share``, so they are broadcast under that proven bound; every other key
    goes through an ordinary shuffled join in which no key has more than 1/``share`` of the rows.
    Both inputs are read more than once and should be stored tables or cheap scans.
    """
    total = facts.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) * share > F.lit(max(total, share))
    hot = facts.filter(is_hot)
    warm = left.join(F.broadcast(hot), key, "inner")
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(~is_hot), key, "left")
    return warm.unionByName(cold)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of an edge list ``(u, v)``: rows ``(node, root)``, root the least node.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until no edge changes. Each
    round is a pre-aggregated minimum and a skew-safe lookup; nothing goes to the driver but the
    count and checksum of the edges.
    """
    held = Scratch(scratch.spark)
    e = held.table(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        before, held = held, Scratch(scratch.spark)
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        low = held.table(low, "stars")
        large = lookup(sym, low, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = held.table(large.distinct(), "large")
        low = held.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        small = lookup(large, low, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = held.table(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        before.drop()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    out = scratch.table(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root"))), "roots")
    held.drop()
    return out


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of a sorted partition that share ``key``, one table a run."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.concat_tables(held)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 2_000_000, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``most`` bytes of ``text``, at least one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        n = np.array([x or 0 for x in pa.compute.binary_length(col).to_pylist()], dtype=np.int64)
        start, held = 0, 0
        for i, x in enumerate(n):
            if i > start and (held + x > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += x
        if start < len(n):
            yield batch.slice(start)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of bytes that are no ASCII white space, as ``bytes.split`` has it."""
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same on every machine."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) on arrays of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
