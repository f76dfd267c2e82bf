"""Flat token files and the separator scan that counts their documents' tokens.

A flat file is a run of little-endian unsigned ids with the end-of-document id after each document
and no index. Files of any size are read in ranges: Spark's text reader cuts bytes at one value, the
separator's low byte, at whatever alignment, and any range of a file can start behind such a byte. A range's
pieces come as Arrow batches; in each, all places of the low byte are one running sum over the
pieces' lengths, and separators are those followed by the other bytes of the id. Only places at a multiple
of the id's width count, and that multiple, like a document that crosses batches or ranges, is known
from what came before: a prefix scan in window functions over one short row a batch stitches them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices
from .tokens import encode

NAME = np.dtype([("known", "u1"), ("doc_id", "<i8")])
#: A UTF-8 byte order mark, which Spark's text reader takes from the head of a file.
MARK_BYTES = 3
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_flat(docs: DataFrame, path: str, eod: int = 50256, chunk_bytes: int = 4 << 20, vocabulary: str = "byte_bpe_50k.tiktoken", width: int = 2) -> None:
    """Tokenise ``docs (doc_id, text)`` into flat files below ``path``, one a task.

    ``kind=tokens`` holds ids of ``width`` bytes, each document closed by ``eod``, which no text can
    produce; ``kind=names`` lists the doc_ids in order, nine bytes each behind their number, for naming results only. A task streams chunks of
    about ``chunk_bytes`` into its file, so files grow with ``spark.sql.files.maxPartitionBytes`` (about half
    of it) and memory does not. Spark's text writer puts the bytes down, so any file system of Spark will do and a
    failed task leaves nothing. Null text counts as empty. An id that ``width`` bytes can't hold is an error.
    """
    most = (1 << 8 * width) - 1
    end = eod.to_bytes(width, "little")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], [], 0

        def out() -> pa.RecordBatch:
            # the writer adds the last separator; a list of names gets one too, which is skipped when read
            listed = np.uint32(len(names)).tobytes() + np.array(names, NAME).tobytes()
            return pa.record_batch([pa.array(["tokens", "names"]), pa.array([end.join(held), listed], pa.binary())], ["kind", "raw"])

        for b in slices(batches, "text"):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text, vocabulary, special=False)
                if len(ids) and int(ids.max()) > most:
                    raise ValueError(f"id {ids.max()} needs more than {width} bytes")
                held.append(ids.astype(f"<u{width}").tobytes())
                names.append((doc_id is not None, doc_id or 0))
                size += len(held[-1]) + width
                if size >= chunk_bytes:
                    yield out()
                    held, names, size = [], [], 0
        if names:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(flat, "kind string, raw binary")
    held = docs.sparkSession.conf.get(WRITERS)
    docs.sparkSession.conf.set(WRITERS, "2")  # both kinds open at once, so that chunks are not sorted by kind first and keep their order
    try:
        rows.select("kind", F.col("raw").cast("string").alias("value")).write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(path)
    finally:
        docs.sparkSession.conf.set(WRITERS, held)


def _part() -> Column:
    """The number of the task that wrote a file: the same for its tokens and its names."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")


def pieces(spark: SparkSession, path: str, eod: int = 50256, file: Column | None = None) -> DataFrame:
    """Bytes of the flat files at ``path`` cut behind each low byte of ``eod``: file, file_size, range_start, value.

    ``file`` names a file, by default its path; a short name saves bytes.
    """
    low = bytes([eod & 0xFF]).decode("latin-1")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", low).text(path)
    name = F.col("_metadata.file_path") if file is None else file
    return lines.select(name.alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("range_start"), F.col("value").cast("binary").alias("value"))


def scan(cut: DataFrame, eod: int = 50256, width: int = 2) -> DataFrame:
    """Documents of flat files cut into ``pieces``: file, ordinal, start, n_tokens, terminated.

    ``start`` and ``n_tokens`` count ids within the file, without the separator. Ids behind the last
    separator form a document that is not terminated; empty documents count; an empty file has
    none. Bytes beyond a multiple of ``width`` raise an error.
    """
    low, *others = eod.to_bytes(width, "little")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            if not b.num_rows:
                continue
            file, begin = b.column("file"), b.column("range_start").to_numpy()
            new = np.append(True, (begin[1:] != begin[:-1]) | pa.compute.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False))
            cuts = np.append(np.flatnonzero(new), b.num_rows)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield _summary(b.slice(lo, hi - lo), turn, low, others)
                turn += 1

    schema = f"file {cut.schema['file'].dataType.simpleString()}, file_size long, range_start long, turn int, bytes long, head binary, tail binary, hits array<long>, open array<long>"
    ranges = cut.mapInArrow(search, schema)
    earlier = Window.partitionBy("file").orderBy("range_start", "turn")
    before, whole = earlier.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    # The reader ends a last piece that had no end of its own, and takes a mark away: the file's size tells.
    total = F.sum("bytes").over(whole)
    marked = F.when(F.col("file_size") - total >= MARK_BYTES - 1, MARK_BYTES).otherwise(0)
    base = F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("long")) + marked
    seen = ranges.withColumns({"base": base, "size": F.col("file_size"), "next": F.concat(*[F.coalesce(F.lead("head", k).over(earlier), F.lit(b"")) for k in range(1, max(width, 2))])})
    # A low byte near the end of a batch is a separator if the next batches go on with the other bytes.
    from_there = lambda at: F.substring(F.concat("tail", "next"), F.length("tail") - (F.col("bytes") - at).cast("int") + 1, F.lit(width))
    late = F.filter("open", lambda at: from_there(at) == F.lit(eod.to_bytes(width, "little")))
    places = F.transform(F.concat("hits", late), lambda at: at + F.col("base"))
    aligned = F.filter(places, lambda at: (at % width == 0) & (at < F.col("size")))
    found = seen.withColumn("ends", F.transform(aligned, lambda at: F.floor(at / width))).withColumn("ids", F.floor(F.col("size") / width))
    sound = F.when(F.col("size") % width != 0, F.raise_error(F.format_string("%s: bytes beyond a multiple of the width", "file"))).otherwise(F.col("ids"))
    found = found.withColumn("ids", sound)
    last = F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1))
    found = found.withColumns({"count": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0).cast("long")), "since": F.coalesce(last.over(before), F.lit(-1).cast("long")), "final": F.coalesce(last.over(whole), F.lit(-1).cast("long")), "is_last": F.lead("turn").over(earlier).isNull()})
    rest = F.when(F.col("is_last") & (F.col("final") < F.col("ids") - 1), F.array("ids")).otherwise(F.array().cast("array<long>"))
    rows = found.withColumn("ends", F.concat("ends", rest)).select("file", "count", "ids", F.concat(F.array("since"), "ends").alias("marks"), F.posexplode("ends").alias("i", "end"))
    start = F.element_at("marks", F.col("i") + 1) + 1
    return rows.select("file", (F.col("count") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("ids")).alias("terminated"))


def _summary(b: pa.RecordBatch, turn: int, low: int, others: list[int]) -> pa.RecordBatch:
    """One row for the pieces of a batch: its bytes, its first bytes, separators within it, and low bytes too near its end to tell."""
    value = b.column("value")
    offsets = np.frombuffer(value.buffers()[1], "<i4")[value.offset : value.offset + len(value) + 1].astype(np.int64)
    data = np.frombuffer(value.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    places = np.cumsum(np.diff(offsets) + 1) - 1  # of the low byte behind each piece
    size = int(places[-1]) + 1
    raw = np.full(size, low, np.uint8)
    stay = np.ones(size, bool)
    stay[places] = False
    raw[stay] = data
    near = places + len(others) >= size
    sure = places[~near]
    for i, x in enumerate(others):
        sure = sure[raw[sure + 1 + i] == x]
    first = b.slice(0, 1)
    return pa.record_batch(
        [first.column("file"), first.column("file_size"), first.column("range_start"), pa.array([turn], pa.int32()), pa.array([size], pa.int64()), pa.array([raw[: len(others)].tobytes()], pa.binary()), pa.array([raw[max(0, size - len(others)) :].tobytes()], pa.binary()), pa.array([sure.tolist()], pa.list_(pa.int64())), pa.array([places[near].tolist()], pa.list_(pa.int64()))],
        ["file", "file_size", "range_start", "turn", "bytes", "head", "tail", "hits", "open"],
    )


def _listed(raw: pa.Buffer, width: int) -> np.ndarray:
    at, parts = 0, [np.empty(0, NAME)]
    while at < len(raw):
        n = int(np.frombuffer(raw, "<u4", 1, at)[0])
        parts.append(np.frombuffer(raw, NAME, n, at + 4))
        at += 4 + n * NAME.itemsize + width
    return np.concatenate(parts)


def names(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """The order of doc_ids that ``write_flat`` notes beside each file: file_no, ordinal, doc_id. A file of names is read whole: 9 bytes a document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, raw in zip(b.column("file_no").to_pylist(), b.column("content"), strict=True):
                listed = _listed(raw.as_buffer(), width)
                for lo in range(0, len(listed), 100_000):
                    part = listed[lo : lo + 100_000]
                    yield pa.record_batch([pa.array([no] * len(part), pa.int64()), pa.array(np.arange(lo, lo + len(part))), pa.array(part["doc_id"], mask=part["known"] == 0)], ["file_no", "ordinal", "doc_id"])

    content = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{path}/kind=names")
    return content.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file_no"), "content").mapInArrow(read, "file_no long, ordinal long, doc_id long")


def count_tokens(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write ``docs`` as flat files at ``path``, scan them and name the documents found.

    Rows: doc_id, file_no, ordinal, start, n_tokens. One row for each row of ``docs``, repeated rows
    and rows of null text (no tokens) or null doc_id among them; texts of any length are tokenised whole and
    their ids may cross any number of ranges; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    write_flat(docs, path, **options)
    if "kind=tokens" not in _listing(spark, path):
        return spark.createDataFrame([], "doc_id long, file_no long, ordinal long, start long, n_tokens long")
    eod, width = options.get("eod", 50256), options.get("width", 2)
    found = scan(pieces(spark, f"{path}/kind=tokens", eod, _part()), eod, width).withColumnRenamed("file", "file_no")
    # Never a broadcast: Spark takes what is read from few files for small.
    return found.hint("merge").join(names(spark, path, width), ["file_no", "ordinal"]).select("doc_id", "file_no", "ordinal", "start", "n_tokens")


def _listing(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(s.getPath().getName()) for s in fs.listStatus(p)]
