"""Language identification by hierarchical discrimination.

A text's hashed letter n-grams go first to linear support vector machines that tell language
families apart, one versus one, and then to the one-versus-one machines of the languages within the
winning family. All machines are fitted on the driver from a bounded sample of labelled rows; every
text is scored whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Families of ISO 639-1 codes; languages in none of them are gathered by likeness.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi bn ur pa gu mr ne si".split(),
    "semitic": "ar he am mt".split(),
    "cjk": "zh ja ko".split(),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
LETTER = regex.compile(r"\p{L}")
DIMS = 1 << 13
#: ASCII bytes that are no lower-case letters count as a space; other bytes stay.
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint32)


def features(text: str, dims: int = DIMS, step: int = 1 << 20) -> np.ndarray:
    """Root counts of hashed byte n-grams (1 to 4) of a whole text, of unit length; worked off in blocks."""
    raw = text.lower().encode("utf-8", "replace")
    total = np.zeros(dims)
    for lo in range(0, len(raw), step):
        x = _FOLD[np.frombuffer(raw, np.uint8)[max(0, lo - 3) : lo + step]]
        skip = min(lo, 3)
        code = np.zeros(len(x), np.uint32)
        for n in range(1, 5):
            code = code[:-1] * np.uint32(0x01000193) + x[n - 1 :] if n > 1 else x.copy()
            fresh = code[max(0, skip - n + 1) :]  # n-grams that end in this block
            slot = ((fresh + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - dims.bit_length() + 1)
            total += np.bincount(slot, minlength=dims)
    total = np.sqrt(total)
    return (total / (np.linalg.norm(total) or 1.0)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 15) -> np.ndarray:
    """A linear machine with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, a = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    norm = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + a[i] * 0.5 / cost
            new = max(0.0, a[i] - g / norm[i])
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                a[i] = new
    return w


class Duel:
    """One-versus-one machines over the classes of one level."""

    def __init__(self, classes: list[str], x: np.ndarray, labels: np.ndarray):
        self.classes, self.pairs = classes, list(combinations(range(len(classes)), 2))
        self.weights = np.zeros((len(self.pairs), DIMS + 1), np.float32)
        for k, (a, b) in enumerate(self.pairs):
            of = np.isin(labels, [classes[a], classes[b]])
            self.weights[k] = fit_svm(x[of], np.where(labels[of] == classes[a], 1.0, -1.0))

    def winner(self, x: np.ndarray) -> tuple[str, float]:
        """Class of most wins, then largest sum of margins, and its least certain win as a probability."""
        if not self.pairs:
            return self.classes[0], 1.0
        margin = self.weights[:, :-1] @ x + self.weights[:, -1]
        wins, total, least = defaultdict(int), defaultdict(float), defaultdict(lambda: np.inf)
        for (a, b), m in zip(self.pairs, margin.tolist(), strict=True):
            for c, s in ((a, m), (b, -m)):
                wins[c] += s > 0
                total[c] += s
                least[c] = min(least[c], s)
        best = max(range(len(self.classes)), key=lambda c: (wins[c], total[c], -c))
        return self.classes[best], float(1 / (1 + np.exp(-np.clip(2 * least[best], -50, 50))))


def gather(x: np.ndarray, labels: np.ndarray, most: int = 12) -> dict[str, str]:
    """The family of each language; those that no table knows go with their nearest kin, ``most`` a family at most."""
    codes = sorted(set(labels))
    family, left = {c: FAMILY[c] for c in codes if c in FAMILY}, [c for c in codes if c not in FAMILY]
    centre = {c: x[labels == c].mean(axis=0) for c in left}
    while left:
        kin = sorted(left, key=lambda c: (c != left[0], -float(centre[c] @ centre[left[0]]), c))[:most]
        family |= dict.fromkeys(kin, f"like {left[0]}")
        left = [c for c in left if c not in family]
    return family


class Model:
    """Families first, then the languages of the winning family."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        of = gather(x, labels)
        family = np.array([of[c] for c in labels], dtype=object)
        names = sorted(set(family))
        self.top = Duel(names, x, family)
        self.within = {f: Duel(sorted(set(labels[family == f])), x[family == f], labels[family == f]) for f in names}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.top.classes:
            return "und", 0.0
        x = features(text)
        family, p = self.top.winner(x)
        lang, q = self.within[family].winner(x)
        return lang, p * q


def held_out() -> Column:
    """Rows that are never learned from: CRC-32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_bound(least: int, count: int, wanted: int) -> int:
    """A bound on 64-bit hashes below which about ``wanted`` of ``count`` rows lie, and always the least hash."""
    return max(least, min(-(1 << 63) + (1 << 64) * wanted // count, (1 << 63) - 1))


def fit(docs: DataFrame, rows: int = 4000, rows_a_language: int = 300, most_languages: int = 500) -> Model:
    """Fit on up to ``rows_a_language`` rows of each language, ``rows`` in all, the first by a hash of doc_id.

    These bounds are on the sample alone. Every language keeps a row; more than ``most_languages`` are an
    error, as machines for pairs of classes grow with the square of a level's classes: 500 languages in families of 12
    make about 4,000 machines of 32 KB. Held-out rows, null labels, null doc_ids and texts without a
    letter are not learned from.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").cast("string").rlike(r"\p{L}"))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    n = {r[0]: (r[1], r[2]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)), F.min("key")).limit(most_languages + 1).collect()}
    if len(n) > min(rows, most_languages):
        raise ValueError(f"more than {min(rows, most_languages)} languages")
    if not n:
        return Model(np.zeros((0, DIMS), np.float32), np.empty(0, dtype=object))
    each = min(rows_a_language, rows // len(n))
    # About 2 * each + 50 rows of a language stay below its bound, and always the least hash; the first of them are taken.
    bound = {lang: hash_bound(least, count, 2 * each + 50) for lang, (count, least) in n.items()}
    below = F.create_map(*[F.lit(v) for item in bound.items() for v in item])[F.col("lang")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", F.xxhash64("text")))
    taken = labelled.filter(F.col("key") <= below).withColumn("place", place).filter(F.col("place") <= each)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for lang, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("lang", "key", "text")), strict=True):
                if LETTER.search(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    out.append((lang, doc_id, at.astype("<u2").tobytes(), x[at].tobytes()))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["lang", "key", "at", "value"])

    got = sorted(taken.select("lang", "key", "text").mapInArrow(sparse, "lang string, key long, at binary, value binary").collect())
    if lost := set(n) - {r[0] for r in got}:
        raise ValueError(f"no row to learn from: {sorted(lost)}")
    x = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r[2], "<u2")] = np.frombuffer(r[3], "<f4")
    return Model(x, np.array([r[0] for r in got], dtype=object))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Predict the language of every row's whole text: doc_id, held_out, lang_pred, score.

    Null text, text without a letter and a model that learned nothing give ``und`` with score 0. A
    null doc_id is not held out; repeated rows are each predicted; texts of any length are scored whole, in blocks;
    only doc_id and text are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the classes and DIMS

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that get a language, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array([shared.value.predict(t)[0] != "und" for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
