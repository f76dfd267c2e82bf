"""Structured Streaming over arriving mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import accessors as A
from ..functions import dates as D
from ..operators.threads import deduplicate
from ..parse import EmailParser
from ..sources import stream_maildir


def mail_stream(spark: SparkSession, path: str, parser: EmailParser | None = None, late: str = "1 day") -> DataFrame:
    """Messages as they arrive in a Maildir, each message id once within ``late``: message_id, ts, sender, subject, path.

    Without a Message-ID the path stands in; without a Date the arrival time.
    """
    parsed = (parser or EmailParser()).parse(stream_maildir(spark, path), headers_only=True)
    sent = F.timestamp_seconds(F.coalesce(D.to_timestamp(A.date("message")), F.col("internal_date")))
    sender = F.get(F.flatten(F.transform(A.from_("message")["groups"], lambda g: g["addresses"])), F.lit(0))["address"]
    rows = parsed.select(F.coalesce(A.message_id("message"), F.col("path")).alias("message_id"), sent.alias("ts"), sender.alias("sender"), A.subject("message").alias("subject"), "path")
    return deduplicate(rows, late)


def windowed_counts(mail: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Messages by sender in tumbling or sliding windows of event time."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return mail.withWatermark("ts", late).groupBy(window, "sender").agg(F.count(F.lit(1)).alias("n"))
