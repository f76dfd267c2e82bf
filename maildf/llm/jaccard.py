"""N-gram Jaccard join by MinHash banding.

1. One pass over the texts takes each row's set of word 5-grams, a digest of the set, and its MinHash
   bands. Rows of equal sets are one class from here on.
2. Classes are shuffled on their band hashes. Within a bucket, leaders stand for their surroundings:
   a member is compared to the leaders, by short signatures, instead of to every other member. Batches
   do the same before the shuffle, so a bucket receives few rows from each batch however many copies
   there are. A bucket that stays large, as leaders of unlike texts do, is split into blocks that meet in pairs, one
   task each. Of the edges found together only a spanning forest goes on. The result is a sparse graph whose
   components hold every candidate pair. Members are linked from an agreement of ``wide`` (0.35) on, far below the
   threshold, so that no pair is lost to its leaders; templated texts may therefore share a component and be verified.
3. The members of a component meet in blocks and every pair of a block is verified on the full n-gram
   sets. A block gives counts of links and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lookup, mix, numbered, runs, slices, word_hashes, words_of

BLOCK = 512
#: A band hash that more members than this share meets in pairs of blocks of about half as many.
CROWD = 20_000


def choose_bands(threshold: float, recall: float = 0.9999, hashes: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows a band, of at most ``hashes`` in all, that find a pair at the threshold with ``recall``."""
    for rows in range(hashes, 0, -1):
        miss = 1 - threshold**rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss)) if miss < 1 else hashes + 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def ngrams(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a whole text in lower case; of a shorter text, of all its words."""
    h = word_hashes(words_of((text or "").lower()))
    if not len(h):
        return h
    n_ = min(n, len(h))
    code = np.zeros(len(h) - n_ + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n_):
            code = mix(code * np.uint64(0x100000001B3) + h[i : len(h) - n_ + 1 + i])
    return np.unique(code)


def minhash(grams: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of each of ``hashes`` hash functions over a set."""
    base = mix(np.arange(hashes, dtype=np.uint64), 17)[:, None]
    times, flip = base | np.uint64(1), mix(base, 23)
    least = np.full(hashes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(grams), 1024):
            x = grams[None, lo : lo + 1024] ^ flip
            x *= times
            least = np.minimum(least, x.min(axis=1))
    return least >> np.uint64(32)


def _unpack(signatures: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def sketches(texts: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """row, doc_id, digest of the set (null without words), signature of four bits a hash, band hashes."""
    hashes = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            digest, signature, band = [], [], []
            for text in b.column("text").to_pylist():
                g = ngrams(text, n)
                if not len(g):
                    digest.append(None), signature.append(None), band.append(None)
                    continue
                m = minhash(g, hashes)
                code = np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    code = mix(code ^ m.reshape(bands, rows)[:, i], i)
                nibbles = (mix(m, 5) & np.uint64(15)).astype(np.uint8)
                nibbles = np.append(nibbles, np.zeros(hashes % 2, np.uint8))
                half = len(nibbles) // 2
                digest.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                signature.append((nibbles[:half] << 4 | nibbles[half:]).tobytes())
                band.append(code.view(np.int64))
            yield pa.record_batch([b.column("row"), b.column("doc_id"), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["row", "doc_id", "digest", "signature", "bands"])

    return texts.select("row", "doc_id", "text").mapInArrow(sketch, "row long, doc_id long, digest binary, signature binary, bands array<long>")


def lead(signatures: np.ndarray, near: float, wide: float) -> tuple[list[int], list[tuple[int, int]]]:
    """Leaders and edges of a bucket: members join a leader at ``near`` agreement and link to every leader at ``wide``.

    Two members agree to at least 1 - (1 - near) - (1 - agreement of both) with one another's
    leaders, since disagreement is a metric; so whenever that is at least ``wide``, both end up in
    one component though they were not compared. Edges within a component are left out, so there are
    fewer of them than members.

    That bound holds for one member dropped for a leader. Members are dropped twice, in a batch and
    after the shuffle, and on both sides of a pair; then each of up to four steps takes 1 - ``near``
    off, which is less than ``wide``, so a bucket may lose the edge of such a pair and the pair rests
    on its other bands. The recall that bands are chosen for is thus that of the bands alone.
    """
    n = len(signatures)
    leaders, edges, label = np.empty(n, np.int64), [], np.arange(n)
    count = 0
    for lo in range(0, n, 512):
        part = signatures[lo : lo + 512]
        before = count
        agreed = np.empty((before + len(part), len(part)), np.float32)  # with leaders so far, then with one another
        for k in range(before):
            agreed[k] = (part == signatures[leaders[k]]).mean(axis=1)
        for k in range(len(part)):
            agreed[before + k] = (part == part[k]).mean(axis=1)
        for i in range(len(part)):
            rows = np.append(np.arange(before), before + leaders[before:count] - lo)
            mine = agreed[rows, i]
            linked = leaders[:count][mine >= wide]
            for other, at in zip(*np.unique(label[linked], return_index=True), strict=True):
                if other != label[lo + i]:
                    edges.append((lo + i, int(linked[at])))
                    label[label == other] = label[lo + i]
            if not count or mine.max() < near:
                leaders[count] = lo + i
                count += 1
    return leaders[:count].tolist(), edges


def forest(edges: Iterable[tuple]) -> list[tuple]:
    """A spanning forest of an edge list: each node but the least of its component, with that least node."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _spans(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A sorted partition in tables that end where a run of ``key`` ends, with the runs' bounds."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        k = t.column(key).to_numpy()
        if not len(k):
            continue
        if held and held[-1].column(key)[-1].as_py() == k[-1]:
            held.append(t)
            continue
        last = int(np.flatnonzero(np.append(True, k[1:] != k[:-1]))[-1])
        full = pa.concat_tables([*held, t.slice(0, last)]).combine_chunks()
        held = [t.slice(last)]
        if full.num_rows:
            k = full.column(key).to_numpy()
            yield full, np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
    if held:
        full = pa.concat_tables(held).combine_chunks()
        k = full.column(key).to_numpy()
        yield full, np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))


def candidate_edges(classes: DataFrame, near: float, wide: float, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between digests of classes ``(digest, signature, bands)`` that share a bucket."""
    names = ["band", "u", "v", "signature"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            digest, signature = b.column("digest"), b.column("signature")
            code = b.column("bands").flatten().to_numpy().reshape(b.num_rows, -1)
            nibbles, found = _unpack(signature.to_pylist()), set()
            for band in code.T:
                order = np.argsort(band, kind="stable")
                cuts = np.append(np.flatnonzero(np.append(True, band[order][1:] != band[order][:-1])), len(band))
                gone = np.zeros(len(band), bool)
                for k in np.flatnonzero(np.diff(cuts) > 1):
                    members = order[cuts[k] : cuts[k + 1]]
                    leaders, edges = lead(nibbles[members], near, wide)
                    gone[members] = True
                    gone[members[leaders]] = False
                    found.update((int(members[i]), int(members[j])) for i, j in edges)
                kept = pa.array(np.flatnonzero(~gone))
                yield pa.record_batch([pa.array(band).take(kept), digest.take(kept), pa.nulls(len(kept), pa.binary()), signature.take(kept)], names)
            if found:
                i, j = (pa.array(x) for x in zip(*forest(found), strict=True))
                u, v = digest.take(i), digest.take(j)
                spread = pa.array([int.from_bytes(x.as_py()[:8], "little", signed=True) for x in u], pa.int64())
                yield pa.record_batch([spread, u, v, pa.nulls(len(u), pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _spans(batches, "task"):
            done = t.filter(pa.compute.is_valid(t.column("v"))).select(["u", "v"])
            yield from done.to_batches()
            out = []
            for k in np.flatnonzero(np.diff(cuts) > 1):
                run = t.slice(cuts[k], cuts[k + 1] - cuts[k])
                run = run.filter(pa.compute.is_null(run.column("v")))
                if run.num_rows > 1:
                    u = run.column("u").to_pylist()
                    out.extend((u[i], u[j]) for i, j in lead(_unpack(run.column("signature").to_pylist()), near, wide)[1])
            if out:
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*forest(out), strict=True)], ["u", "v"])

    dealt = classes.select("digest", "signature", "bands").mapInArrow(local, "band long, u binary, v binary, signature binary")
    dealt = scratch.table(dealt, "dealt")
    crowds = dealt.filter("v IS NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD)
    crowds = scratch.table(crowds, "crowds")
    plain = dealt.select(F.col("band").alias("task"), "u", "v", "signature")
    if crowds.head(1):
        blocks = F.ceil(F.col("n") / F.lit(CROWD / 2)).cast("int")
        met = dealt.join(crowds, "band").filter("v IS NULL").withColumn("mine", F.pmod(F.xxhash64("u"), blocks).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).filter("mine <> other")
        met = met.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "u", "v", "signature")
        found = dealt.filter("v IS NOT NULL")
        rest = dealt.filter("v IS NULL").join(crowds, "band", "left_anti").unionByName(found)
        plain = rest.select(F.col("band").alias("task"), "u", "v", "signature").unionByName(met)
    return plain.repartition("task").sortWithinPartitions("task").mapInArrow(meet, "u binary, v binary")


def verify(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, columns: int = 8192) -> np.ndarray:
    """Which pairs of sets reach the threshold: all sets against all (``right`` None), or left against right."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets], dtype=float)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(int))
    shared = times[code] > 1
    rank = np.cumsum(times > 1) - 1
    owner, code = owner[shared], rank[code[shared]]
    n = len(left)
    both = np.zeros((n, len(right) if right else n), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        a, b = np.searchsorted(code, [lo, lo + columns])
        m = np.zeros((len(sets), int(code[b - 1]) - lo + 1), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        both += m[:n] @ (m[n:] if right else m).T
    union = size[:n, None] + (size[n:] if right else size)[None, :] - both
    return both >= threshold * union - 1e-9


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric adjacency matrix."""
    edges, new = [], np.ones(len(adjacent), bool)
    for root in range(len(adjacent)):
        if not new[root]:
            continue
        new[root], front = False, [root]
        while front:
            x = front.pop()
            reached = np.flatnonzero(adjacent[x] & new)
            new[reached] = False
            edges.extend((x, int(y)) for y in reached)
            front.extend(reached.tolist())
    return edges


def links(texts: DataFrame, classes: DataFrame, roots: DataFrame, scratch: Scratch, threshold: float, n: int) -> DataFrame:
    """Verify all pairs of each candidate component: rows (u, count) of links and rows (u, v) of spanning forests."""
    per = scratch.table(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    members = lookup(roots, per, "root", "n").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.select(F.col("node").alias("digest"), "root", "blocks").join(classes.select("digest", "row", "size"), "digest")
    members = scratch.table(members, "members")
    # The same plan at every size: a broadcast of the members would work on small inputs only.
    found = members.hint("merge").join(texts.select("row", "text"), "row").select("digest", "root", "blocks", "size", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            out = []
            for digest, root, blocks, size, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = ngrams(text, n).tobytes()
                mine = int.from_bytes(digest[-4:], "little") % blocks
                out.extend((f"{root.hex()}/{min(mine, x)}/{max(mine, x)}", mine, digest, size, raw) for x in range(blocks))
            for lo in range(0, len(out), 256):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 256], strict=True), (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["task", "block", "digest", "size", "grams"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for t in runs(batches, "task"):
            _, a, b = t.column("task")[0].as_py().split("/")
            rows = {}
            for block, digest, size, raw in zip(*(t.column(c).to_pylist() for c in ("block", "digest", "size", "grams")), strict=True):
                rows.setdefault(digest, (block, size, np.frombuffer(raw, np.uint64)))
            names, (blocks, size, grams) = list(rows), zip(*rows.values(), strict=True)
            size = np.array(size)
            if a == b:
                adjacent = verify(list(grams), None, threshold)
                np.fill_diagonal(adjacent, False)
            else:
                split = [np.flatnonzero(np.array(blocks) == int(x)) for x in (a, b)]
                if not len(split[0]) or not len(split[1]):
                    continue
                adjacent = np.zeros((len(names), len(names)), bool)
                adjacent[np.ix_(*split)] = verify([grams[i] for i in split[0]], [grams[i] for i in split[1]], threshold)
                adjacent |= adjacent.T
            count = adjacent @ size
            held.extend((names[i], None, int(count[i])) for i in np.flatnonzero(count))
            held.extend((names[i], names[j], None) for i, j in _forest(adjacent))
            if len(held) > 10_000:
                yield _links(held)
                held = []
        if held:
            yield _links(held)

    dealt = found.mapInArrow(sets, "task string, block int, digest binary, size long, grams binary")
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(check, "u binary, v binary, count long")


def _links(held: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["u", "v", "count"])


def join(docs: DataFrame, scratch: Scratch, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, hashes: int = 128, row: str | None = None) -> DataFrame:
    """Similarity classes of rows whose sets of word n-grams have a Jaccard index of at least ``threshold``.

    Rows: doc_id, class_id, class_size, n_links. ``n_links`` counts the other rows that reach the
    threshold, copies included; ``class_id`` is the smallest doc_id of the connected component and
    ``class_size`` its number of rows. Words are cut at ASCII white space and compared in lower case.

    Null and empty texts have no n-grams: each such row is a class of its own without links. A text of
    fewer than ``n`` words has one n-gram, all its words. Texts of any length are compared whole. Rows that repeat
    a doc_id each count; a null doc_id is never the smallest unless there is no other. Rows are told apart
    by the column ``row`` of ``docs``, which must be each row's own and stored, or are numbered. Other columns are
    not read; an empty table gives no rows.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    texts = docs.select(*columns, F.col(row).alias("row")) if row else numbered(docs, scratch, columns, "row")
    bands, rows = choose_bands(threshold, recall, hashes)
    sigma = math.sqrt(threshold * (1 - threshold) / (bands * rows))
    near = 0.7
    wide = max(0.05, near + (threshold - 4 * sigma) - 1)
    all_rows = scratch.table(sketches(texts, bands, rows, n), "sketches")
    some = all_rows.filter("digest IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("size"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = scratch.table(classes, "classes")
    roots = components(candidate_edges(classes, near, wide, scratch), scratch)
    found = scratch.table(links(texts, classes, roots, scratch, threshold, n), "links")
    merged = components(found.filter("v IS NOT NULL").select("u", "v"), scratch)
    count = found.filter("v IS NULL").groupBy(F.col("u").alias("digest")).agg(F.sum("count").alias("links"))
    placed = classes.select("digest", "doc_id", "size").join(merged.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    placed = scratch.table(placed, "placed")
    per = scratch.table(placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("n")), "components")
    facts = lookup(placed.select("digest", "root", "size"), per, "root", "n").join(count, "digest", "left")
    facts = scratch.table(facts.select("digest", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "size"), "facts")
    out = lookup(all_rows.select("doc_id", "digest").filter("digest IS NOT NULL"), facts, "digest", "size").select("doc_id", "class_id", "class_size", "n_links")
    alone = all_rows.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)
