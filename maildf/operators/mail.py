"""Rows of parts, nested messages and attachments; JSON; the attachment writer."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import accessors as A


def explode_parts(df: DataFrame, message: str = "message") -> DataFrame:
    """One row a part, of nested messages too: the part's fields beside the other columns."""
    return df.withColumn("part", F.explode(F.col(message)["parts"])).drop(message).select("*", "part.*").drop("part")


def explode_messages(df: DataFrame, message: str = "message") -> DataFrame:
    """One row for the message and each one nested in it, with ``msg_path`` and a ``message`` of its own."""
    m = F.col(message)
    parts = F.filter(m["parts"], lambda p: p["msg_path"] == F.col("bodies.msg_path"))
    own = F.struct(F.array(F.col("bodies")).alias("messages"), parts.alias("parts"))
    out = df.withColumn("bodies", F.explode(m["messages"]))
    return out.withColumn("msg_path", F.col("bodies.msg_path")).withColumn(message, own).drop("bodies")


def attachments(df: DataFrame, message: str = "message") -> DataFrame:
    """One row an attachment that is no message, at any depth: name, media type and bytes."""
    rows = explode_messages(df, message).withColumn("part", F.explode(A.attachments(message))).filter(F.col("part.kind") != "message")
    p = F.col("part")
    ct = A.content_type(p)
    return rows.select(*[c for c in df.columns if c != message], "msg_path", p["part_id"].alias("part_id"), A.attachment_name(p).alias("attachment_name"), F.concat_ws("/", ct["c_type"], ct["c_subtype"]).alias("media_type"), A.contents(p).alias("bytes"))


def to_json(df: DataFrame, message: str = "message") -> DataFrame:
    """The message as JSON text; write it with ``df.write.text``."""
    return df.select(*[c for c in df.columns if c != message], F.to_json(message, {"ignoreNullFields": "true"}).alias("json"))


def from_json(df: DataFrame, json: str = "json", message: str = "message") -> DataFrame:
    """The message of JSON text as ``to_json`` writes it; null where the text is none."""
    return df.select(*[c for c in df.columns if c not in (json, message)], F.from_json(json, schema.MESSAGE).alias(message))


def write_attachments(rows: DataFrame, path: str, keep: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """Write each row's ``bytes`` below ``path`` under its ``attachment_name``: rows of (*keep, file, size).

    ``path`` is a folder that all machines mount; a store that only Spark reaches is an error. Names lose their directories and odd characters, and a digest
    of the bytes keeps equal names apart, so that writing again after a lost task changes nothing. ``spread`` deals files to 256 folders
    by their digest, since a folder takes one new name at a time, whoever writes. Files have hidden names until they are whole.
    """
    base = path.removeprefix("file://").removeprefix("file:")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", base):
        raise ValueError(f"{path} is no mounted folder")
    source = rows.select(*[F.col(f"`{c}`") for c in keep], F.col("attachment_name").alias("__name"), F.col("bytes").alias("__bytes"))
    out = source.drop("__name", "__bytes").withColumns({"file": F.lit(""), "size": F.lit(0).cast("long")}).schema
    os.makedirs(base, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        made = set()
        for b in batches:
            done = []
            for name, data in ((n.as_py(), d.as_py()) for n, d in zip(*b.columns[-2:], strict=True)):
                safe = re.sub(r"[^\w.-]+", "_", os.path.basename((name or "Untitled").replace("\\", "/"))).lstrip(".") or "Untitled"
                digest = hashlib.sha256(data or b"").hexdigest()[:16]
                folder = os.path.join(base, digest[:2]) if spread else base
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                target = os.path.join(folder, f"{digest}-{safe[-150:]}")
                part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
                with open(part, "wb") as f:
                    f.write(data or b"")
                os.replace(part, target)
                done.append((target, len(data or b"")))
            if done:
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(c) for c in zip(*done, strict=True))], [*keep, "file", "size"])

    return source.mapInArrow(run, out)
