"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. Each round adds to a queue's credit its share of one window and
serves its next packets of ``quantum`` tokens as far as the credit reaches; what is left, the
deficit, is carried to the next round. The served tokens form one stream, cut into windows of
``window`` tokens, so a window holds each source in its target proportion to within one packet and
only the last window of all is short.

The credit after a round is a closed form of the round, so no task has to simulate earlier rounds:
a task that holds a document finds the round of each of its packets, and the tokens that every other
queue has served by then, from the queues' totals alone. Deficits thus carry over partitions exactly
as over windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices
from .tokens import encode

SCALE = 1 << 16
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])


class Schedule:
    """Closed form of the round-robin: totals and shares of all queues, in visiting order.

    Queues of share 0 take turns, by their tokens, when all others have run dry. Products are split into
    quotient and remainder, so that sums up to 10^14 tokens stay within 64 bits.
    """

    def __init__(self, totals: np.ndarray, shares: np.ndarray, window: int, quantum: int):
        self.totals, self.window, self.quantum = totals.astype(np.int64), window, quantum
        self.last = shares <= 0
        self.weights = np.ones(len(totals), np.int64)
        for turn, weight in ((~self.last, shares), (self.last, totals)):
            part = weight[turn].astype(float)
            self.weights[turn] = np.maximum(1, np.round(part / max(part.sum(), 1e-300) * SCALE))
        self.base = np.where(self.last, self.totals[~self.last].sum(), 0)

    def due(self, queue: np.ndarray, packet: np.ndarray) -> np.ndarray:
        """The round that serves a packet: the first in which the queue's credit covers it whole."""
        end, a_round = np.minimum((packet + 1) * self.quantum, self.totals[queue]), self.window * self.weights[queue]
        whole, rest = np.divmod(end, a_round)
        return whole * SCALE - (-rest * SCALE // a_round)

    def served(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Tokens that a queue has sent by the end of a round; the rest of its credit is its deficit."""
        total, a_round = int(self.totals[queue]), self.window * int(self.weights[queue])
        whole, rest = np.divmod(np.minimum(rounds, -(-total * SCALE // a_round)), SCALE)
        credit = whole * a_round + rest * a_round // SCALE
        return np.where(credit >= total, total, credit // self.quantum * self.quantum)

    def position(self, queue: np.ndarray, packet: np.ndarray) -> np.ndarray:
        """Place in the stream of a packet's first token."""
        rounds, at = self.due(queue, packet), self.base[queue] + packet * self.quantum
        for q in range(len(self.totals)):
            others = (queue != q) & (self.last[queue] == self.last[q])
            # a queue visited later in the same round has served only the rounds before
            at = at + np.where(others, self.served(q, rounds - (queue < q)), 0)
        return at

    def pieces(self, queue: np.ndarray, begin: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents at ``begin`` in their queues, cut at packets and windows: document, start, length, stream position."""
        first, last = begin // self.quantum, (begin + tokens - 1) // self.quantum
        n = last - first + 1
        doc = np.repeat(np.arange(len(n)), n)
        packet = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc]
        lo = np.maximum(packet * self.quantum, begin[doc])
        hi = np.minimum((packet + 1) * self.quantum, (begin + tokens)[doc])
        at = self.position(queue[doc], packet) + lo - packet * self.quantum
        lo -= begin[doc]
        hi -= begin[doc]
        room = self.window - at % self.window  # a packet is never longer than a window: one cut at most
        over = hi - lo > room
        keep = np.concatenate([np.arange(len(doc)), np.flatnonzero(over)])
        second = np.concatenate([np.zeros(len(doc), bool), np.ones(int(over.sum()), bool)])
        doc, at, room = doc[keep], at[keep], room[keep]
        begin_, end_ = np.where(second, lo[keep] + room, lo[keep]), np.where(second | ~over[keep], hi[keep], lo[keep] + room)
        at = np.where(second, at + room, at)
        order = np.lexsort((begin_, doc))
        doc, begin_, end_, at = doc[order], begin_[order], end_[order], at[order]
        if len(doc):  # neighbours in the document that are neighbours in one window are one piece
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (end_ - begin_)[:-1]) | (at[1:] % self.window == 0)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(doc)) - 1
            doc, begin_, end_, at = doc[head], begin_[head], end_[tail], at[head]
        return doc, begin_, end_ - begin_, at


def shares(total: dict[str, int], targets: dict[str, float] | None) -> np.ndarray:
    """Shares of queues (``=`` and a source's name, or others) of all tokens, in the order of ``total``."""
    aimed = {"=" + s: w for s, w in (targets or {}).items() if "=" + s in total}
    given = sum(aimed.values())
    free = sum(n for q, n in total.items() if q not in aimed)
    rest = max(0.0, 1.0 - given) / max(free, 1)
    return np.array([aimed[q] / max(given, 1.0) if q in aimed else n * rest for q, n in total.items()], dtype=float)


def pack(docs: DataFrame, scratch: Scratch, targets: dict[str, float] | None = None, window: int = 1024, quantum: int = 256, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0, max_queues: int = 1024) -> DataFrame:
    """Pack all rows of ``docs (doc_id, text, source)`` into windows; one row a piece.

    ``targets``: shares of sources. Where they come to less than 1, the other sources have the rest, in
    proportion to their tokens; else targets are scaled to 1. A source of share 0 is packed when the
    others have run dry. Without targets every source has its share of all tokens. When a queue runs
    dry the others go on in their proportions. A document is cut at packets of ``quantum`` tokens, so a smaller one
    holds proportions more closely and makes more pieces.
    With more than ``max_queues`` sources, those with a target and the largest (by bytes of text, half
    of ``max_queues``) keep queues of their own; only the rest share the other half by a hash, so that
    the table of queues that every task holds keeps a fixed bound. A shared queue weighs as many
    tokens as its sources have together and serves them in stored order: the queue keeps its
    proportion, its small sources keep theirs only as far as one packet can tell.

    Null text counts as empty (one end token), null source is a source of its own, a null doc_id
    stays null, repeated rows are packed once each, and other columns are not read. Texts of any length are
    tokenised whole and laid over as many windows as they fill. An empty table gives no rows.
    """
    if quantum > window:
        raise ValueError("quantum must not exceed window")
    if any(w < 0 for w in (targets or {}).values()):
        raise ValueError("a target is negative")
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    own = F.lit(True)
    if slim.select("source").distinct().limit(max_queues + 1).count() > max_queues:
        aimed = list(targets or {})
        size = slim.filter(F.col("source").isNotNull() & ~F.col("source").isin(aimed)).groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
        largest = [r[0] for r in size.orderBy(F.desc("size"), "source").limit(max_queues // 2).collect()]
        own = F.col("source").isin(aimed + largest)
    shared = F.pmod(F.xxhash64("source"), F.lit(max(1, max_queues - max_queues // 2)))
    queue = F.when(own, F.concat(F.lit("="), "source")).otherwise(F.concat(F.lit("#"), shared.cast("string")))
    slim = slim.withColumn("queue", F.when(F.col("source").isNull(), F.lit("")).otherwise(queue))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sent = TaskContext.get().partitionId(), {}
        for b in slices(batches, "text"):
            queues, at, count, ids = b.column("queue").to_pylist(), [], [], []
            for q, text in zip(queues, b.column("text").to_pylist(), strict=True):
                x = np.append(encode(text, vocabulary), np.uint32(end_id))
                at.append(sent.get(q, 0))
                sent[q] = at[-1] + len(x)
                count.append(len(x))
                ids.append((x.astype("<u2") if x.max() < 65536 else x.astype("<u4")).tobytes())
            yield pa.record_batch([b.column("doc_id"), b.column("source"), b.column("queue"), pa.array([chunk] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(count, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "queue", "chunk", "at", "tokens", "ids"])

    tok = scratch.table(slim.mapInArrow(tokenise, "doc_id long, source string, queue string, chunk int, at long, tokens long, ids binary"), "tokens")
    per = scratch.table(tok.groupBy("queue", "chunk").agg(F.sum("tokens").alias("tokens")), "chunks")
    # The prefix sum of each queue over chunks: one row for a task and queue.
    before = per.withColumn("base", F.sum("tokens").over(Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    before = scratch.table(before.select("queue", "chunk", F.coalesce("base", F.lit(0)).alias("base")), "prefix")
    total = dict(sorted((r[0], r[1]) for r in per.groupBy("queue").agg(F.sum("tokens")).collect()))  # at most max_queues + len(targets) + 1 rows
    names = list(total)
    plan = Schedule(np.array([total[q] for q in names], dtype=np.int64), shares(total, targets), window, quantum)
    rank = {q: i for i, q in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids"):
            col = {n: b.column(n) for n in b.schema.names}
            tokens = col["tokens"].to_numpy()
            queues = np.array([rank[q] for q in col["queue"].to_pylist()], dtype=np.int64)
            doc, start, length, at = plan.pieces(queues, col["base"].to_numpy() + col["at"].to_numpy(), tokens)
            raw = [memoryview((np.frombuffer(x, "<u2") if len(x) == 2 * n else np.frombuffer(x, "<u4")).astype("<u4").tobytes()) for x, n in zip(col["ids"].to_pylist(), tokens, strict=True)]
            crc = [zlib.crc32(raw[d][4 * s : 4 * (s + n)]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            take = pa.array(doc)
            yield pa.record_batch([col["doc_id"].take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc]), pa.array(at // window), pa.array(at % window), col["source"].take(take)], schema=PIECE)

    return tok.join(before, ["queue", "chunk"]).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
