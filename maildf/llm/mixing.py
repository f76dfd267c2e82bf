"""Mixing sources to target weights by Poisson replication, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup

UNIT = 1 << 52


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(UNIT))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= j) for j = 0, 1, ... far into the tail, summed in log space so that large rates do not underflow."""
    last = (rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("cdf"))

    def step(a: Column, j: Column) -> Column:
        log = a["log"] + F.ln(rate) - F.ln(j.cast("double"))
        return F.struct(log.alias("log"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(log))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))


def name_of() -> Column:
    """What a row draws by: its doc_id, or without one a hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text)))


def mix_sources(docs: DataFrame, scratch: Scratch, targets: dict[str, float] | None = None, exponent: float = 0.7, epochs: float = 1.0, seed: str = "mix", named: Column | None = None) -> DataFrame:
    """Replicate each row a Poisson number of times so that sources meet their target weights.

    The mean repetition rate of a source is its target weight times ``epochs`` times all rows, over
    the source's rows. ``targets`` gives weights; without it a source of n rows weighs n ** exponent.
    A row's count inverts the Poisson distribution at a number hashed from ``seed`` and doc_id, so a
    rerun or a retried task draws the same counts; ``named`` is a text that stands for doc_id there, by default
    ``name_of()``. The copies are then shuffled over the whole
    result: dealt to partitions by a hash of ``mix_key`` and sorted by it there.

    Added columns: ``copy`` (from 1), ``rate``, ``mix_key``; inputs of those names are replaced.
    Null source is a source of its own, a null doc_id draws by a hash of the text, repeated rows draw the same
    count, null or empty text changes nothing, texts of any length are carried whole, an empty table gives
    no rows.
    """
    added = ("copy", "rate", "mix_key", "_mix_source", "_mix_n")
    docs = docs.drop(*added).withColumn("_mix_source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    n = docs.groupBy("_mix_source").agg(F.count(F.lit(1)).alias("_mix_n"))
    if targets is None:
        weight = F.pow(F.col("_mix_n").cast("double"), F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("_mix_source") == "=" + name, F.lit(float(w))).otherwise(weight)
    n = scratch.table(n.withColumn("_w", weight), "sources")
    rows, all_w = n.agg(F.sum("_mix_n"), F.sum("_w")).first()
    rate = F.col("_w") / F.lit(float(all_w or 1.0)) * F.lit(float(epochs * (rows or 0))) / F.col("_mix_n")
    n = scratch.table(n.withColumn("rate", rate).withColumn("_cdf", poisson_cdf(F.col("rate"))).drop("_w"), "rates")
    id_ = name_of() if named is None else named
    drawn = lookup(docs, n, "_mix_source", "_mix_n").withColumn("_u", uniform(F.lit(seed), id_))
    count = F.size(F.filter("_cdf", lambda c: c < F.col("_u")))
    copies = drawn.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), id_, F.col("copy").cast("string")).cast("binary"))
    out = copies.withColumn("mix_key", key).drop("_mix_source", "_mix_n", "_cdf", "_u")
    return out.repartition("mix_key").sortWithinPartitions("mix_key")
