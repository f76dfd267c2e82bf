"""A dictionary-compressed WARC writer and its reader.

An archive is one file of Zstandard frames: a skippable frame that holds the dictionary, then one
frame for each record, so a record can be read alone with the dictionary. The dictionary is built from
the archive's own records. Archives are put down by Spark's text writer, which adds an empty
skippable frame at the end of each; a failed task leaves nothing behind.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup, slices

#: Magic numbers of the dictionary's and of any skippable frame, of a plain frame and of a built dictionary.
DICTIONARY_FRAME, SKIPPABLE_FRAME, FRAME, BUILT = 0x184D2A5D, 0x184D2A50, 0xFD2FB528, 0xEC30A437
#: An empty skippable frame, as text in Latin 1.
TRAILER = struct.pack("<II", SKIPPABLE_FRAME, 0).decode("latin-1")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head with the full payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _uri(page_id), "WARC-Date": date}
    if url:
        head["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(sha1).decode()
    if revisit:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _uri(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = 32_768, sample: int = 2_000_000) -> bytes:
    """A dictionary from evenly spaced records of about ``sample`` bytes in all; of few or short ones, their bytes as they are.

    The first 128 KiB of a chosen record are learned from, so that training holds little; records are
    compressed whole, and a dictionary that fits badly costs bytes alone.
    """
    step = max(1, sum(map(len, records)) // sample)
    chosen = [r[:131_072] for r in records[::step]]
    try:
        return zstandard.train_dictionary(size, chosen, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chosen)[:size]


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict:
    built = raw[:4] == struct.pack("<I", BUILT)
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if built else zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> bytes:
    """The bytes of an archive, without the trailer."""
    raw = dictionary(records)
    c = zstandard.ZstdCompressor(level=level, dict_data=_dict(raw), write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(c.compress, records)])


def unarchive(data: bytes) -> Iterator[bytes]:
    """Records of an archive, in order."""
    at, d = 0, zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_FRAME:
            (n,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_FRAME:
                d = zstandard.ZstdDecompressor(dict_data=_dict(bytes(view[at + 8 : at + 8 + n])))
            at += 8 + n
            continue
        if magic != FRAME:
            raise ValueError(f"no Zstandard frame at {at}")
        o = d.decompressobj()
        yield o.decompress(view[at:])
        at = len(view) - len(o.unused_data)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def write(pages: DataFrame, path: str, scratch: Scratch, least: int = 1000, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Write one record for each row of ``pages (page_id, url, html)`` into archives below ``path``.

    Of pages with equal payloads of at least ``least`` bytes, the one with the largest page_id is the
    response and the others revisit it; shorter payloads are all responses. Null html is an empty
    payload; repeated rows of the winning page are each a response; a null page_id never wins unless
    the group has no other, and then each of its rows is a response; null url leaves the field out;
    other columns are not read; an empty table writes nothing. A payload of any length below 2 GiB is written
    whole. Payloads are equal by SHA-256 and length, since pairs of one SHA-1 can be made; SHA-1 is what
    records report.
    """
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("digest", F.struct(F.unhex(F.sha2("payload", 256)).alias("sha256"), F.octet_length("payload").alias("bytes")))
    groups = scratch.table(rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    shared = groups.filter(f"n > 1 AND digest.bytes >= {int(least)}")
    marked = lookup(rows, shared, "digest", "n")
    marked = marked.withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(True)) & F.col("n").isNotNull() & F.col("first").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, "payload"):
            for x in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "sha", "first", "revisit")), strict=True):
                held.append(record(*x, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.record_batch([pa.array([archive(held, level)], pa.binary())], ["raw"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([archive(held, level)], pa.binary())], ["raw"])

    packed = marked.select("page_id", "url", "payload", "sha", "first", "revisit").mapInArrow(pack, "raw binary")
    packed.select(F.col("raw").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", TRAILER).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives at ``path``: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from the payload as it was read; a digest that differs
    from the record's field raises an error.
    """
    import hashlib

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for data in b.column("content"):
                held, size = [], 0

                def out(held: list) -> pa.RecordBatch:
                    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

                for raw in unarchive(data.as_buffer()):
                    fields, http, payload = parse(raw)
                    noted = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = fields["WARC-Type"]
                    if kind == "response":
                        found, n = hashlib.sha1(payload).hexdigest(), len(payload)
                        if found != noted:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']} differs")
                    else:
                        found, n, payload = noted, int(re.search(rb"Content-Length: (\d+)", http)[1]), None
                    held.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload, n, found, kind, _page(fields.get("WARC-Refers-To"))))
                    size += len(raw)
                    if size > 2_000_000:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    return files.mapInArrow(unpack, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
