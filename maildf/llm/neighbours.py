"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order and posted in their files. Within a block of vectors
an inverted file holds, for each pivot, the place it takes in each vector's order (the prefix length where it
takes none). A query reads the files of its own nearest pivots, fewer than a vector is posted in, sums the
footrule distance over them, takes the share of the block with the least sums, and reranks these by exact
inner product in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, runs


def usable(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """Rows ``(vec_id, v)`` that take part: id not null, components finite, not all zero."""
    v = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.filter(fine)


def _prefix(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]


class InvertedFile:
    """Pivot files of one block of vectors."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int):
        self.x, self.pivots, self.prefix = x, pivots, min(prefix, len(pivots))
        order = _prefix(x, pivots, self.prefix)
        self.files = np.full((len(pivots), len(x)), self.prefix, np.int16)
        self.files[order.ravel(), np.repeat(np.arange(len(x)), self.prefix)] = np.tile(np.arange(self.prefix, dtype=np.int16), len(x))

    def search(self, q: np.ndarray, read: int, take: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the candidates' rows and exact inner products; ``read`` files are read."""
        orders = _prefix(q, self.pivots, min(read, self.prefix))
        places = np.arange(orders.shape[1], dtype=np.int16)[:, None]
        for one, order in zip(q, orders, strict=True):
            if take < len(self.x):
                footrule = np.abs(self.files[order] - places).sum(axis=0, dtype=np.int32)
                near = np.argpartition(footrule, take - 1)[:take]
            else:
                near = np.arange(len(self.x))
            yield near, (self.x[near] * one).sum(axis=1)


def search(vectors: DataFrame, asked: Column, scratch: Scratch, k: int = 20, pivots: int = 256, prefix: int = 128, read: int = 48, share: float = 0.12, block: int = 4096, most_lengths: int = 100) -> DataFrame:
    """The ``k`` nearest rows of each query row by inner product: query_id, rank, vec_id, score.

    ``asked`` is a condition on vec_id that marks queries. Queries and vectors meet in blocks of at
    most about ``block`` distinct vectors and 4096 queries; a block gives up at least ``share`` of
    itself, and never fewer than 16 * k vectors, to the exact rerank. Equal vectors are held once, with their
    k + 1 least ids, which is all that an answer of k can show. Pivots are the ``pivots`` distinct
    vectors of least hash, which is the only sample: every vector is posted in the files of its ``prefix`` nearest, and
    a query reads ``read`` files.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with null
    vec_id. Vectors of different lengths have no inner product: each length is an index of its own, and more
    than ``most_lengths`` of them are an error. Ties go to the smaller vec_id. Repeated rows of one
    vec_id answer as one candidate; a query never meets its own id. Other columns are not read; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = scratch.table(usable(vectors).distinct(), "vectors")
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    least = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = scratch.table(least.groupBy("v").agg(F.collect_list("vec_id").alias("ids")), "classes")
    lengths = [r[0] for r in classes.select(F.size("v")).distinct().limit(most_lengths + 1).collect()]
    if len(lengths) > most_lengths:
        raise ValueError(f"vectors of more than {most_lengths} lengths")
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("v"), "v"))
    chosen = classes.select(F.size("v").alias("d"), "v").withColumn("r", place).filter(F.col("r") <= pivots).collect()
    pivot = {d: np.array([r.v for r in sorted(chosen, key=lambda r: r.r) if r.d == d], dtype=float) for d in lengths}
    queries = rows.filter(asked)
    blocks, turns = max(1, -(-classes.count() // block)), max(1, -(-queries.count() // 4096))
    at = lambda i, j: F.concat_ws("/", F.size("v").cast("string"), i.cast("string"), j.cast("string")).alias("task")
    data = classes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).select(at(F.pmod(F.xxhash64("v"), F.lit(blocks)), F.col("j")), "v", "ids", F.lit(None).cast("long").alias("query_id"))
    query = queries.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(at(F.col("i"), F.pmod(F.xxhash64("vec_id"), F.lit(turns))), "v", F.lit(None).cast("array<long>").alias("ids"), F.col("vec_id").alias("query_id"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "task"):
            here, there = t.filter(pa.compute.is_valid(t.column("ids"))), t.filter(pa.compute.is_null(t.column("ids")))
            if not here.num_rows or not there.num_rows:
                continue
            matrix = lambda x: np.array(x.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(x.num_rows, -1)
            ids, x = here.column("ids").to_pylist(), matrix(here)
            take = min(len(x), max(int(np.ceil(share * len(x))), 16 * k))
            out: tuple[list, list, list] = ([], [], [])
            for own, (near, score) in zip(there.column("query_id").to_pylist(), InvertedFile(x, pivot[x.shape[1]], prefix).search(matrix(there), read, take), strict=True):
                if len(score) > k + 1:  # with ties, every class that may hold one of the k best
                    kept = score >= np.partition(score, -(k + 1))[-(k + 1)]
                    near, score = near[kept], score[kept]
                found = sorted((-s, i) for c, s in zip(near.tolist(), score.tolist(), strict=True) for i in ids[c] if i != own)[:k]
                out[0].extend([own] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(-s for s, _ in found)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    tasks = data.unionByName(query).repartition("task").sortWithinPartitions("task")
    found = tasks.mapInArrow(answer, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
