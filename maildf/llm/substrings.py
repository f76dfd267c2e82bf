"""Removal of repeated word windows, found by recompression.

Recompression names ever longer blocks of a text so that equal substrings get equal names inside.
Each round gives every symbol a side, left or right, by a hash of its name, and renames each pair of a
left and a right symbol that stand next to each other. A name is a fingerprint of what it stands
for, so it is the same in all documents and on all machines without a table of names. A run of
one symbol is never paired within itself (its members share a side): it keeps its letters, since
naming a run by its length would let the text outside a window change names deep inside it.

Pairs that lie inside a window are chosen alike wherever the window stands; only its outermost symbol
on each side may join a neighbour outside. So a round spoils at most one symbol on each side, and
after R rounds at most 1 + 2 + ... + 2^(R-1) = 2^R - 1 words. For a window of 35 words and R = 4
that leaves at least 5 words between the spoilt ends, hence a top symbol that begins in the first 15
words of every copy of the window, followed by at least 20 words of the window. Therefore:

1. each document gives, for each top symbol, a key of its name and the 20 words from its start;
   keys seen only once in the corpus end the matter for their places;
2. around shared keys, every window that may contain them is verified by a cryptographic digest of its
   words themselves (128 bits of BLAKE2b over their bytes); windows seen at two places or more are marked;
3. the words that marked windows cover are removed.

Names and keys of step 1 are short fingerprints: two that collide bring windows to step 2 for nothing, and no equal
windows ever miss each other. So words decide, and names only say where to look.

Steps 1 and 2 each are one shuffle of packed arrays. A task gathers several million keys, keeps for itself what
repeats within them and sends one token in its place, so no key brings more rows to a task than there are
such gatherings, and a gathering makes at most one row for each bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, mix, numbered, runs, slices, word_hashes, words_of

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PACKED = "bucket int, kind int, keys binary, rids binary, counts binary, places binary"
FOUND = "bucket int, rids binary, counts binary, places binary"
FIELDS = ["bucket", "kind", "keys", "rids", "counts", "places"]
#: Keys that a task gathers before it sends them: 20 or 28 bytes each.
GATHERED = 2_000_000


def rounds_for(window: int) -> int:
    """The most rounds that leave a top symbol inside every window: 2 * (2^R - 1) < window."""
    r = 0
    while 2 * (2 ** (r + 1) - 1) < window:
        r += 1
    return r


def recompress(names: np.ndarray, rounds: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and names of the top symbols after ``rounds`` rounds of pairing; ``first`` marks words that begin a document."""
    start = np.arange(len(names))
    first = np.zeros(len(names), bool) if first is None else first
    for r in range(rounds):
        right = mix(names, r) >> np.uint64(63) == 1
        left = np.flatnonzero(~right[:-1] & right[1:] & ~first[1:])
        with np.errstate(over="ignore"):
            joint = mix(names[left] * np.uint64(BASE) ^ mix(names[left + 1], 64 + r), 128 + r)
        names = names.copy()
        names[left] = joint
        stay = np.ones(len(names), bool)
        stay[left + 1] = False
        names, start, first = names[stay], start[stay], first[stay]
    return start, names


class Words:
    """The words of a batch of documents, one after another."""

    def __init__(self, texts: Iterable[tuple[int, bytes]], least: int):
        rids, counts, words = [], [], []
        for rid, text in texts:
            w = text.split()
            if len(w) >= least:
                rids.append(rid)
                counts.append(len(w))
                words += w
        self.rids, self.words, self.names = np.array(rids, np.int64), words, word_hashes(words)
        self.ends = np.cumsum(np.array(counts, np.int64))
        self.starts = self.ends - np.array(counts, np.int64)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def digests(self, at: np.ndarray, length: int) -> np.ndarray:
        """Digests of the words at ``at``: pairs of 64-bit numbers."""
        line, size = b" ".join(self.words), np.cumsum([0, *(len(w) + 1 for w in self.words)])
        blake = hashlib.blake2b
        out = b"".join([blake(line[a:b], digest_size=16).digest() for a, b in zip(size[at].tolist(), (size[at + length] - 1).tolist(), strict=True)])
        return np.frombuffer(out, "<u8").reshape(-1, 2)


class Prints:
    """Fingerprints of any stretch of one document's words."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        with np.errstate(over="ignore"):
            power = np.append(np.uint64(1), np.cumprod(np.full(n, BASE, np.uint64)))
            self.sums = np.append(np.uint64(0), np.cumsum(mix(names, 31) * power[:n]))
            self.undo = np.append(np.uint64(1), np.cumprod(np.full(n, INVERSE, np.uint64)))

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[at + length] - self.sums[at]) * self.undo[at], length)


def _runs(rids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row ids without repeats next to each other, and how often each stood there."""
    cuts = np.append(np.flatnonzero(np.append(len(rids) > 0, rids[1:] != rids[:-1])), len(rids))
    return rids[cuts[:-1]], np.diff(cuts).astype("<u4")


def _pack(keys: np.ndarray, rids: np.ndarray, places: np.ndarray, tokens: np.ndarray, here: tuple[np.ndarray, np.ndarray], buckets: int, turn: int) -> pa.RecordBatch:
    """Rows of one gathering: kind 0 asks about keys, kind 1 are keys known to repeat, kind 2 places already found."""
    out: list[list] = [[] for _ in FIELDS]

    def add(bucket: int, kind: int, keys: np.ndarray | None, rids: np.ndarray | None, places: np.ndarray | None) -> None:
        names, counts = (None, None) if rids is None else _runs(rids)
        for c, v in zip(out, (bucket, kind, *(None if a is None else a.tobytes() for a in (keys, names, counts, places))), strict=True):
            c.append(v)

    for kind, k, r, p in ((0, keys, rids, places), (1, tokens, None, None)):
        of = (k[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            i = order[cuts[b] : cuts[b + 1]]
            add(b, kind, k[i], None if r is None else r[i], None if p is None else p[i])
    if len(here[0]):
        add(turn % buckets, 2, None, *here)
    return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:])], FIELDS)


def _alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of numbers: the first of each distinct row, each row's class, and sizes of classes."""
    order = np.lexsort(keys.T)
    ranked = keys[order]
    new = np.append(len(keys) > 0, (ranked[1:] != ranked[:-1]).any(axis=1))[: len(keys)]
    code = np.empty(len(keys), np.int64)
    code[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return order[heads], code, np.diff(np.append(heads, len(keys)))


class _Asker:
    """Gathers (key, row, place) over batches, sorts out what repeats among them and packs the rest."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size, self.turn = buckets, [], 0, 7 * TaskContext.get().partitionId()

    def add(self, keys: np.ndarray, rids: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, rids, places.astype("<u4")))
        self.size += len(keys)
        if self.size >= GATHERED:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, rids, places = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size, self.turn = [], 0, self.turn + 1
            first, code, times = _alike(keys)
            again = times[code] > 1
            yield _pack(keys[~again], rids[~again], places[~again], keys[first[times > 1]], (rids[again], places[again]), self.buckets, self.turn)


def repeated(asked: DataFrame, buckets: int, words: int) -> DataFrame:
    """Places whose key, of ``words`` numbers, occurs twice or more: rows (bucket, rids, counts, places), dealt by row id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "bucket"):
            kinds = np.array(t.column("kind").to_pylist())
            part = lambda name, kind, dtype: np.frombuffer(b"".join(x for x, k in zip(t.column(name).to_pylist(), kinds, strict=True) if k == kind), dtype)  # noqa: B023, E731
            named = lambda kind: np.repeat(part("rids", kind, "<i8"), part("counts", kind, "<u4"))  # noqa: B023, E731
            keys, tokens = (part("keys", kind, "<u8").reshape(-1, words) for kind in (0, 1))
            rids, places = named(0), part("places", 0, "<u4")
            _, code, times = _alike(np.concatenate([keys, tokens, tokens]))  # a token stands for two places
            hit = times[code[: len(keys)]] > 1
            rids, places = np.append(named(2), rids[hit]), np.append(part("places", 2, "<u4"), places[hit])
            of = rids.view(np.uint64) % np.uint64(buckets)
            order = np.lexsort((places, rids, of))
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            if full:
                cut = [order[cuts[b] : cuts[b + 1]] for b in full]
                names = [_runs(rids[i]) for i in cut]
                yield pa.record_batch([pa.array(full, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in ([n for n, _ in names], [n for _, n in names], [places[i] for i in cut]))], ["bucket", "rids", "counts", "places"])

    return asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, FOUND)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as Zstandard blobs, so that shuffling them moves a third."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in slices(batches, "text"):
        yield pa.record_batch([b.column("bucket"), b.column("rid"), pa.array([squeeze(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], ["bucket", "rid", "blob"])


def _text(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _with_places(texts: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Both sides dealt by bucket, the places of a bucket before its texts."""
    none = F.lit(None).cast("binary")
    left = found.select("bucket", F.lit(0).alias("kind"), "rids", "counts", "places", F.lit(None).cast("long").alias("rid"), none.alias("blob"))
    right = texts.select("bucket", F.lit(1).alias("kind"), none.alias("rids"), none.alias("counts"), none.alias("places"), "rid", "blob")
    return left.unionByName(right).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(bucket, rid, blob, places) of texts that have places."""
    bucket, parts, places = None, [], None
    for b in batches:
        for i in range(b.num_rows):
            at, kind, rids, counts, where, rid, blob = (c[i].as_py() for c in b.columns)
            if at != bucket:
                bucket, parts, places = at, [], None
            if kind == 0:
                parts.append((np.repeat(np.frombuffer(rids, "<i8"), np.frombuffer(counts, "<u4")), np.frombuffer(where, "<u4")))
                continue
            if places is None:
                places = {}
                if parts:
                    r, p = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.lexsort((p, r))
                    r, p = r[order], p[order]
                    cuts = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r))
                    places = {int(r[i]): p[i:j] for i, j in zip(cuts, cuts[1:], strict=False)}
                parts = []
            if rid in places:
                yield bucket, rid, blob, places[rid].astype(np.int64)


def _cut(docs: DataFrame, scratch: Scratch, window: int, key_bits: int) -> tuple[DataFrame, DataFrame]:
    """Texts with row numbers, and for those that lose words: rid, n_removed, kept."""
    rounds = rounds_for(window)
    reach = 2**rounds - 1
    stretch = window - reach
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = numbered(docs, scratch, [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")], "rid")

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = _Asker(buckets)
        for b in slices(batches, "text", 6_000_000, 4096):
            w = Words(zip(b.column("rid").to_pylist(), (t.encode() for t in b.column("text").to_pylist()), strict=True), window)
            if len(w.names):
                first = np.zeros(len(w.names), bool)
                first[w.starts] = True
                at, name = recompress(w.names, rounds, first)
                doc = w.document(at)
                fits = at + stretch <= w.ends[doc]
                at, name, doc = at[fits], name[fits], doc[fits]
                keys = mix(name ^ Prints(w.names).of(at, stretch)) >> np.uint64(64 - key_bits)
                yield from asker.add(keys[:, None], w.rids[doc], at - w.starts[doc])
        yield from asker.send()

    shared = repeated(texts.select("rid", "text").mapInArrow(symbols, PACKED), buckets, 1)
    dealt = texts.select(_bucket_of("rid", buckets).alias("bucket"), "rid", "text").mapInArrow(_squeezed, "bucket int, rid long, blob binary")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "rid", "blob", "places"])

        for bucket, rid, blob, places in _matched(batches):
            held.append((bucket, rid, blob, places.astype("<u4").tobytes()))
            size += len(blob)
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    some = scratch.table(_with_places(dealt, shared, buckets).mapInArrow(candidates, "bucket int, rid long, blob binary, places binary"), "shared")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = _Asker(buckets)
        for b in slices(batches, "blob", 2_000_000, 4096):
            w = Words(zip(b.column("rid").to_pylist(), map(_text, b.column("blob").to_pylist()), strict=True), 0)
            found = [np.frombuffer(raw, "<u4").astype(np.int64) for raw in b.column("places").to_pylist()]
            start = np.repeat(w.starts, [len(p) for p in found])
            p = np.concatenate(found) + start
            near = np.bincount(np.maximum(p - reach, start), minlength=len(w.names) + 1) - np.bincount(p + 1, minlength=len(w.names) + 1)
            at = np.flatnonzero(np.cumsum(near) > 0)
            doc = w.document(at)
            fits = at + window <= w.ends[doc]
            at, doc = at[fits], doc[fits]
            yield from asker.add(w.digests(at, window), w.rids[doc], at - w.starts[doc])
        yield from asker.send()

    marked = repeated(some.select("rid", "blob", "places").mapInArrow(windows, PACKED), buckets, 2)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rid, blob, places in _matched(batches):
            words = _text(blob).split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, places, 1)
            np.add.at(edge, places + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x).decode()
            yield pa.record_batch([pa.array([rid], pa.int64()), pa.array([int(gone.sum())], pa.int64()), pa.array([kept], pa.string())], ["rid", "n_removed", "kept"])

    cut = _with_places(some, marked, buckets).mapInArrow(cover, "rid long, n_removed long, kept string")
    return texts, cut


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = 35, key_bits: int = 64) -> DataFrame:
    """Remove every word in a window of ``window`` words that also starts anywhere else.

    Rows: doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces). Words are
    runs of characters outside ``[\\x20\\x09-\\x0D]``; windows lie within one document, and all are
    judged on the input. Null and empty texts have no words; a text shorter than the window loses none;
    repeated rows count as places of their own, so a long enough text that occurs in two rows is
    removed from both; a null doc_id stays null; texts of any length are searched whole; other columns are not read;
    an empty table gives no rows. Windows are told apart by 128 bits of BLAKE2b over their words; ``key_bits`` is the
    length of the keys that say where to look, and changes the work alone.
    """
    texts, cut = _cut(docs, scratch, window, key_bits)
    kept = F.coalesce("kept", F.array_join(F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != ""), " "))
    words = texts.select("doc_id", "rid", "text").join(cut, "rid", "left")
    n = F.size(F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")).cast("long")
    return words.select("doc_id", n.alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), kept.alias("kept"))


def digests(docs: DataFrame, scratch: Scratch, window: int = 35, key_bits: int = 64) -> DataFrame:
    """``remove_repeats`` with the SHA-256 of the kept words in their place; only digests are shuffled, not whole texts."""
    texts, cut = _cut(docs, scratch, window, key_bits)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = [words_of(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("rid"), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])], ["doc_id", "rid", "n_words", "sha"])

    every = texts.select("doc_id", "rid", "text").mapInArrow(whole, "doc_id long, rid long, n_words long, sha string")
    less = cut.select("rid", "n_removed", F.sha2("kept", 256).alias("less"))
    return every.join(less, "rid", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("less", "sha").alias("kept_sha256"))


def _bucket_of(rid: str, buckets: int):
    """The row id as an unsigned number modulo ``buckets``, as numpy has it."""
    wrap = F.lit((1 << 64) % buckets)
    return F.pmod(F.pmod(F.col(rid), F.lit(buckets)) + F.when(F.col(rid) < 0, wrap).otherwise(F.lit(0)), F.lit(buckets)).cast("int")

