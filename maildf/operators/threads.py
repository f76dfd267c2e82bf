"""Relational operators over mail. These are extensions, plain Spark plans over parsed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_replies(mail: DataFrame) -> DataFrame:
    """Each message of ``(message_id, in_reply_to, ...)`` with its parent's columns as ``parent_*``; null for orphans.

    Mail that answers nothing, most of it, is dealt by a salt that no parent has, so that null is no key that
    one task gets.
    """
    parent = mail.select(*[F.col(c).alias(f"parent_{c}") for c in mail.columns]).filter("parent_message_id IS NOT NULL").withColumn("__none", F.lit(0))
    salt = F.when(F.col("in_reply_to").isNotNull(), 0).otherwise(F.pmod(F.xxhash64("message_id"), F.lit(4096)).cast("int") + 1)
    keyed = mail.withColumns({"__key": F.coalesce("in_reply_to", F.lit("")), "__salt": salt})
    return keyed.join(parent, (F.col("__key") == F.col("parent_message_id")) & (F.col("__salt") == F.col("__none")), "left").drop("__key", "__salt", "__none")


def daily_counts(mail: DataFrame) -> DataFrame:
    """Messages by sender and UTC day of ``(sender, ts)``."""
    return mail.groupBy("sender", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def deduplicate(mail: DataFrame, late: str | None = None) -> DataFrame:
    """One row a message_id. On a stream, ``late`` bounds how long ids are remembered, by the column ts."""
    if mail.isStreaming and late:
        return mail.withWatermark("ts", late).dropDuplicatesWithinWatermark(["message_id"])
    return mail.dropDuplicates(["message_id"])
