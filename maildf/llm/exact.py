"""Exact deduplication: static binary-fuse filters per immutable snapshot screen incoming digests.

A snapshot is written once: its distinct texts in exact buckets of their digests, and for each bucket
a binary-fuse filter of about 18 bits a digest. An incoming batch is grouped by itself; its digests are screened by
the filters, and only positives join the snapshot's buckets, where the bytes are compared. Negatives
are certain to be new. Within a group bytes are compared too, as its least and greatest text. Should
two texts share a digest, their keys are drawn out by the texts themselves and the work is done again.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, lookup, mix, numbered, runs


class BinaryFuse:
    """A static three-wise binary-fuse filter with 16-bit fingerprints (Graf and Lemire, 2022)."""

    def __init__(self, seed: int, length: int, segments: int, table: np.ndarray):
        self.seed, self.length, self.segments, self.table = seed, length, segments, table

    @staticmethod
    def _place(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask, slots = np.uint64(length - 1), []
        for i in range(3):
            inside = (h >> np.uint64(11 * i)) & mask if i < 2 else mix(h, 7) & mask
            slots.append((first + np.uint64(i)) * np.uint64(length) + inside)
        return np.stack(slots).astype(np.int64), (mix(h, 3) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        length = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))) + 1
        segments = max(1, -(-room // length) - 2)
        for seed in range(1, 1000):
            slots, mark = cls._place(keys, seed, length, segments)
            order = cls._peel(slots, (segments + 2) * length)
            if order is not None:
                table = np.zeros((segments + 2) * length, np.uint16)
                for k, at in reversed(order):  # keys of one round don't touch each other's slots
                    table[at] = mark[k] ^ table[slots[0, k]] ^ table[slots[1, k]] ^ table[slots[2, k]]
                return cls(seed, length, segments, table)
            if seed % 10 == 0:
                segments += segments // 8 + 1
        raise RuntimeError("no filter found")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        total = np.bincount(slots.ravel(), weights=np.tile(np.arange(n, dtype=float), 3), minlength=size).astype(np.int64)
        order, left = [], n
        at = np.flatnonzero(count == 1)
        while len(at):
            key, one = np.unique(total[at], return_index=True)
            order.append((key, at[one]))
            left -= len(key)
            gone = slots[:, key]
            np.subtract.at(count, gone.ravel(), 1)
            np.subtract.at(total, gone.ravel(), np.tile(key, 3))
            at = np.unique(gone.ravel())
            at = at[count[at] == 1]
        return order if not left else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, mark = self._place(keys.astype(np.uint64), self.seed, self.length, self.segments)
        return mark == self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]

    def dump(self) -> bytes:
        return struct.pack("<III", self.seed, self.length, self.segments) + self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> BinaryFuse:
        return cls(*struct.unpack_from("<III", raw), np.frombuffer(raw, "<u2", offset=12))


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE_CHARS, "")


def _groups(rows: DataFrame) -> DataFrame:
    """One row a key: its best row, its number of rows, its least text and whether all its texts are that one."""
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid")).alias("best")
    return rows.groupBy("key").agg(best, F.count(F.lit(1)).alias("size"), F.min("t").alias("t"), (F.min("t") == F.max("t")).alias("same"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter a bucket of a snapshot's keys: (bucket, filter)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "bucket"):
            keys = np.array(t.column("print").to_pylist(), dtype=np.int64).view(np.uint64)
            yield pa.record_batch([pa.array([t.column("bucket")[0].as_py()], pa.int32()), pa.array([BinaryFuse.build(keys).dump()], pa.binary())], ["bucket", "filter"])

    keyed = groups.select(_bucket(buckets), _print())
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(build, "bucket int, filter binary")


def _print() -> Column:
    return F.xxhash64("key").alias("print")


def _bucket(buckets: int) -> Column:
    """The bucket that Spark's bucketed tables give a key."""
    return F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Keys of ``groups`` that a filter lets through: all that the snapshot holds, and about 1 in 65,000 others."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, None
        for b in batches:  # a bucket's filter comes before its keys
            for i in np.flatnonzero(pa.compute.is_valid(b.column("filter")).to_numpy(zero_copy_only=False)).tolist():
                bucket, held = b.column("bucket")[i].as_py(), (held or {})
                held[bucket] = BinaryFuse.load(b.column("filter")[i].as_py())
            at, prints = b.column("bucket").to_numpy(), b.column("print").fill_null(0).to_numpy().view(np.uint64)
            asked, hit = pa.compute.is_valid(b.column("key")).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, bool)
            for k in np.unique(at[asked]).tolist():
                rows = np.flatnonzero(asked & (at == k))
                if held and k in held:
                    hit[rows] = held[k].contains(prints[rows])
            yield b.filter(pa.array(hit)).select(["key"])
            if held and b.num_rows:
                held = {k: f for k, f in held.items() if k >= at[-1]}

    none = F.lit(None)
    asked = groups.select(_bucket(buckets), F.lit(1).alias("turn"), _print(), "key", none.cast("binary").alias("filter"))
    known = filters.select("bucket", F.lit(0).alias("turn"), none.cast("long").alias("print"), none.cast("binary").alias("key"), "filter")
    return asked.unionByName(known).repartition("bucket").sortWithinPartitions("bucket", "turn").mapInArrow(probe, "key binary")


class Snapshot:
    """The stored texts of a corpus, written once: exact buckets of (key, best, size, t) and their filters."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.texts = scratch.bucketed(_groups(rows), "key", self.buckets, "snapshot")
        self.filters = scratch.table(snapshot_filters(self.texts, self.buckets), "filters")

    def known(self, batch: DataFrame, scratch: Scratch) -> DataFrame:
        """Groups of a batch whose key the snapshot holds: (key, new_best, new_size, equal); ``equal``: the bytes agree."""
        positive = scratch.table(screen(batch, self.filters, self.buckets), "positive")
        asked = batch.join(positive, "key", "left_semi").select("key", F.col("best").alias("new_best"), F.col("size").alias("new_size"), F.col("t").alias("new_t"))
        met = asked.hint("merge").join(self.texts.select("key", "t"), "key")  # only positives are moved
        return scratch.table(met.select("key", "new_best", "new_size", (F.col("t") == F.col("new_t")).alias("equal")), "known")


def dedup(docs: DataFrame, scratch: Scratch, incoming: Column | None = None, row: str | None = None, key_bytes: int = 16) -> DataFrame:
    """Groups of equal texts: uid, doc_id, keep_id, group_size, kept, text_sha256, one row a row of ``docs``.

    ``incoming`` marks the rows of the new batch, the rest are the snapshot; by default a quarter of
    all rows, chosen by a hash of doc_id. The answer does not depend on the choice, nor on
    ``key_bytes``, the bytes of SHA-256 that serve as key: bytes of texts decide.

    Texts are equal when they agree without the characters ``[\\x20\\x09-\\x0D]``; null counts as
    empty. The row with the most code points stays, then the smallest doc_id (null last), then the
    first row, so of repeated rows exactly one stays. ``uid`` is the column ``row`` of ``docs``, which must be
    each row's own and stored; without one, rows are numbered. Texts of any length are moved whole, once for each
    task that holds them. Other columns are not read; an empty table gives no rows.
    """
    if incoming is None:
        incoming = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(incoming, F.lit(False)).alias("incoming")]
    rows = docs.select(*columns, F.col(row).alias("uid")) if row else numbered(docs, scratch, columns, "uid")
    rows = rows.select("uid", "doc_id", "incoming", F.coalesce(F.length("text"), F.lit(0)).alias("n"), normalised(F.col("text")).alias("t"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("t", 256))).withColumn("key", F.substring("sha", 1, key_bytes))
    while True:
        facts = scratch.table(rows.select("uid", "doc_id", "sha", "key"), "digests")
        old = Snapshot(rows.filter(~F.col("incoming")), scratch)
        new = scratch.table(_groups(rows.filter("incoming")), "batch")
        known = old.known(new, scratch)
        mixed = old.texts.filter("NOT same").select("key").union(new.filter("NOT same").select("key")).union(known.filter("NOT equal").select("key"))
        if not mixed.head(1):
            break
        mixed = scratch.table(mixed.distinct().withColumn("mixed", F.lit(True)), "mixed")
        rows = rows.join(mixed, "key", "left").withColumn("key", F.when(F.col("mixed"), F.concat("sha", F.lit(b":"), F.col("t").cast("binary"))).otherwise(F.col("key"))).drop("mixed")
    merged = old.texts.select("key", "best", "size").join(known, "key", "left")
    merged = merged.select("key", F.least("best", "new_best").alias("best"), (F.col("size") + F.coalesce("new_size", F.lit(0))).alias("size"))
    fresh = new.select("key", "best", "size").join(known.select("key"), "key", "left_anti")
    groups = scratch.table(merged.unionByName(fresh), "groups")
    out = lookup(facts, groups, "key", "size")
    return out.select("uid", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("uid") == F.col("best.uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
