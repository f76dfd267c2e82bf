"""The parse operator: raw bytes to a typed message column, in one Arrow-batched pass.

Parsing is a ``mapInArrow`` and not a UDF on purpose: a deterministic UDF is evaluated again for every
expression that uses its result, this runs once a row. Filters on other columns are not pushed
through it, so filter first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import schema
from .kernel import mime

MIME_HEADERS = {"content-type": "content_type", "content-disposition": "content_type", "content-id": "id", "content-description": "text", "content-location": "text", "content-transfer-encoding": "text"}
DATE_HEADERS = {"date": "date", "resent-date": "date"}
ADDRESS_HEADERS = dict.fromkeys("from to cc bcc reply-to sender resent-to resent-from resent-bcc resent-cc resent-sender list-archive list-help list-id list-owner list-post list-subscribe list-unsubscribe".split(), "address")
ID_HEADERS = dict.fromkeys("message-id references in-reply-to return-path resent-message-id content-id".split(), "id")
MINIMAL_HEADERS = MIME_HEADERS | {"date": "date", "subject": "text"} | dict.fromkeys("from reply-to to cc bcc".split(), "address")
IDS = {n.lower(): i for i, n in enumerate(mime.NAMES)}
OTHER_ID = 37


def _value(v: tuple) -> dict:
    kind, x = v
    out = {"kind": kind}
    if kind == "Text":
        out["text"] = x
    elif kind == "TextList":
        out["texts"] = x
    elif kind == "Address":
        groups = x["Group"] if "Group" in x else [{"name": None, "addresses": x["List"]}]
        out["address"] = {"is_group": "Group" in x, "groups": groups}
    elif kind == "DateTime":
        out["date"] = x
    elif kind == "ContentType":
        out["content_type"] = x
    elif kind == "Received":
        host = lambda h: h and {"name": h.get("Name"), "ip": h.get("IpAddr")}
        out["received"] = {**x, "from": host(x.get("from")), "by": host(x.get("by")), "helo": host(x.get("helo"))}
    return out


def _header(h: mime.Header) -> dict:
    return {"name": h.name, "name_id": IDS.get(h.name.lower(), OTHER_ID), "value": _value(h.value), "offset_field": h.offset_field, "offset_start": h.offset_start, "offset_end": h.offset_end}


def flatten(message: mime.Message | None) -> dict | None:
    """The nested message as flat arrays, the root's parts first."""
    if message is None:
        return None
    out: dict = {"messages": [], "parts": []}
    todo = [(message, [], "outer")]
    while todo:
        m, path, base = todo.pop(0)
        out["messages"].append({"msg_path": path, "html_body": m.html_body, "text_body": m.text_body, "attachments": m.attachments})
        for i, p in enumerate(m.parts):
            row = {"msg_path": path, "part_id": i, "offset_base": base, "headers": [_header(h) for h in p.headers], "is_encoding_problem": p.problem, "encoding": p.encoding, "kind": p.kind, "offset_header": p.offset_header, "offset_body": p.offset_body, "offset_end": p.offset_end}
            if p.kind == "message":
                todo.append((p.body, [*path, i], "decoded" if p.encoding != "none" else base))
                row["bytes"] = p.body.raw if p.encoding != "none" else None
            else:
                row["children" if p.kind == "multipart" else "text" if p.kind in ("text", "html") else "bytes"] = p.body
            out["parts"].append(row)
    return out


@dataclass(frozen=True)
class EmailParser:
    """Immutable parser options. A fresh parser reads every standard header in its own form, others raw.

    As soon as one header is chosen, only chosen headers are typed and all others take the default
    form, so the ``with_*`` groups replace the standard forms rather than add to them. Bodies need
    ``with_mime_headers``.
    """

    forms: tuple[tuple[str, str], ...] = ()
    other: str = "raw"

    def _with(self, more: dict[str, str]) -> EmailParser:
        return replace(self, forms=tuple(sorted((dict(self.forms) | more).items())))

    def with_mime_headers(self) -> EmailParser:
        return self._with(MIME_HEADERS)

    def with_date_headers(self) -> EmailParser:
        return self._with(DATE_HEADERS)

    def with_address_headers(self) -> EmailParser:
        return self._with(ADDRESS_HEADERS)

    def with_message_ids(self) -> EmailParser:
        return self._with(ID_HEADERS)

    def with_minimal_headers(self) -> EmailParser:
        return self._with(MINIMAL_HEADERS)

    def header(self, name: str, form: str) -> EmailParser:
        """Read a header as raw, text, address, id, list, date, content_type, received or ignore."""
        if form not in mime.FORMS:
            raise ValueError(f"no form {form}")
        return self._with({name.lower(): form})

    def header_text(self, name: str) -> EmailParser:
        return self.header(name, "text")

    def header_date(self, name: str) -> EmailParser:
        return self.header(name, "date")

    def header_address(self, name: str) -> EmailParser:
        return self.header(name, "address")

    def header_id(self, name: str) -> EmailParser:
        return self.header(name, "id")

    def header_content_type(self, name: str) -> EmailParser:
        return self.header(name, "content_type")

    def header_comma_separated(self, name: str) -> EmailParser:
        return self.header(name, "list")

    def header_received(self, name: str) -> EmailParser:
        return self.header(name, "received")

    def header_raw(self, name: str) -> EmailParser:
        return self.header(name, "raw")

    def ignore_header(self, name: str) -> EmailParser:
        return self.header(name, "ignore")

    def without_header(self, name: str) -> EmailParser:
        return replace(self, forms=tuple((n, f) for n, f in self.forms if n != name.lower()))

    def default_header_text(self) -> EmailParser:
        return replace(self, other="text")

    def default_header_raw(self) -> EmailParser:
        return replace(self, other="raw")

    def default_header_ignore(self) -> EmailParser:
        return replace(self, other="ignore")

    def parse_bytes(self, raw: bytes | None, headers_only: bool = False) -> mime.Message | None:
        """One message outside Spark."""
        return None if raw is None else mime.parse(raw, mime.Forms(self.forms, self.other), headers_only)

    def parse(self, df: DataFrame, raw: str = "raw", into: str = "message", headers_only: bool = False, keep_raw: bool = False) -> DataFrame:
        """Add the column ``into`` with the parsed message; null where ``raw`` is null or has no header.

        ``headers_only`` stops behind the first header block. The raw bytes leave the frame unless
        ``keep_raw``; an input column named ``into`` is replaced.
        """
        kept = [c for c in df.columns if c != into and (keep_raw or c != raw)]
        source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{raw}`").cast("binary").alias("__raw"))
        out = T.StructType([*source.schema.fields[:-1], T.StructField(into, schema.MESSAGE)])
        arrow, parser = to_arrow_type(schema.MESSAGE), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, n in _cuts(batch.column(batch.num_columns - 1)):
                    b = batch.slice(lo, n)
                    parsed = [flatten(parser.parse_bytes(x, headers_only)) for x in b.column(b.num_columns - 1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(parsed, type=arrow)], [*kept, into])

        return source.mapInArrow(run, out)


def _cuts(raw: pa.Array, most: int = 8 << 20, rows: int = 1000) -> Iterator[tuple[int, int]]:
    """Slices of a batch of at most about ``most`` bytes, so that one task holds little at a time."""
    start = held = 0
    for i, x in enumerate(raw):
        size = len(x.as_buffer()) if x.is_valid else 0
        if i > start and (held + size > most or i - start >= rows):
            yield start, i - start
            start, held = i, 0
        held += size
    if len(raw) > start:
        yield start, len(raw) - start
