"""Text, decoding and header functions: native where SQL can say it, else Arrow-batched."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..kernel import charsets, decoders, fields, html, mime, threads
from ..parse import _value
from .accessors import _cut, _same, headers, html_part, subject, text_part


def _map(kind: T.DataType, fn: Callable) -> Callable[..., Column]:
    """A vectorised function of one or two columns; null in, null out."""

    @F.pandas_udf(kind)
    def one(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else fn(x))

    return one


def _limited(fn: Callable[[str, int], str]) -> Callable[[Column | str, int], Column]:
    def run(text: Column | str, limit: int) -> Column:
        return _map(T.StringType(), lambda x: fn(x, limit))(text)

    return run


html_to_text = _map(T.StringType(), html.html_to_text)
html_entity_decode = _map(T.StringType(), html.entity)
thread_name_of = _map(T.StringType(), threads.thread_name)
trim_trailing_fwd = _map(T.StringType(), threads.trim_trailing_fwd)
preview_html, truncate_html = _limited(html.preview_html), _limited(html.truncate_html)
_base64_decode = _map(T.BinaryType(), lambda x: decoders.base64_decode(bytes(x)))
quoted_printable_decode = _map(T.BinaryType(), lambda x: decoders.quoted_printable_decode(bytes(x)))


def base64_decode(data: Column | str) -> Column:
    """Bytes of Base64 with white space; null at any other byte. Whole groups are decoded in SQL; only other input goes to Python."""
    d = F.col(data) if isinstance(data, str) else data
    bare = F.translate(d.cast("string"), " \t\r\n", "")
    clean = (F.length(bare) % 4 == 0) & bare.rlike(r"^[A-Za-z0-9+/]*+={0,2}$")
    return F.when(clean, F.unbase64(bare)).otherwise(_base64_decode(F.when(~clean, d.cast("binary"))))


def text_to_html(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("<html><body>"), F.replace(F.replace(F.replace(t, F.lit("\r"), F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br/>")), F.lit("</body></html>"))


def preview_text(text: Column | str, limit: int) -> Column:
    """At most ``limit`` bytes, cut between characters. ASCII is cut in SQL; only other texts go to Python."""
    t = F.col(text) if isinstance(text, str) else text
    room, dots = (limit - 3, "...") if limit > 6 else (limit, "")
    cut = F.concat(F.substring(t, 1, room), F.lit(dots))
    return F.when(F.octet_length(t) <= limit, t).when(F.octet_length(t) == F.length(t), cut).otherwise(_limited(html.preview_text)(t, limit))


truncate_text = preview_text


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("bytes", T.BinaryType())]))
def percent_decode(data: pd.Series) -> pd.DataFrame:
    """Percent escapes: whether all were good, and the bytes up to the first bad one."""
    got = [decoders.percent_decode(bytes(x)) if x is not None else (None, None) for x in data]
    return pd.DataFrame(got, columns=["ok", "bytes"])


def quoted_printable_char(digits: Column | str) -> Column:
    """The byte of two hexadecimal digits; null of anything else."""
    d = F.col(digits) if isinstance(digits, str) else digits
    return F.when(d.rlike("^[0-9A-Fa-f]{2}$"), F.conv(d, 16, 10).cast("int"))


def charset_decode(data: Column | str, label: Column | str) -> Column:
    """Text of bytes in a charset; UTF-8 if the label is unknown."""

    @F.pandas_udf(T.StringType())
    def run(raw: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else charsets.decode(bytes(r), c.encode() if c else None) for r, c in zip(raw, labels, strict=True)], dtype=object)

    return run(data, label)


def charset_is_known(label: Column | str) -> Column:
    return _map(T.BooleanType(), lambda x: charsets.decoder(x.encode()) is not None)(label)


def header_value_of(text: Column | str, form: str) -> Column:
    """A field's value, with or without its newline, read in a form: a header value struct."""
    read = mime.FORMS[form]

    @F.pandas_udf(schema.VALUE)
    def run(texts: pd.Series) -> pd.DataFrame:
        names = [f.name for f in schema.VALUE.fields]
        rows = [_value(read(x.encode() if x.endswith("\n") else x.encode() + b"\n", 0)[0]) if x is not None else {} for x in texts]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return run(text)


def decode_header(text: Column | str) -> Column:
    """Unstructured header text with encoded words decoded."""
    return _map(T.StringType(), lambda x: fields.unstructured(x.encode() + b"\n", 0)[0][1])(text)


def header_as(raw: Column | str, message: Column | str, name: str, form: str) -> Column:
    """All headers of a name, read again from the raw bytes: an array of header values; raw ones trimmed."""
    read = mime.FORMS[form]
    r = F.col(raw) if isinstance(raw, str) else raw
    found = F.transform(F.filter(headers(message), _same(name)), lambda h: _cut(r, h["offset_start"], h["offset_end"]))

    @F.pandas_udf(T.ArrayType(schema.VALUE))
    def again(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [_value(read(bytes(x), 0)[0]) for x in v] for v in values], dtype=object)

    return again(found)


def header_name(text: Column | str) -> Column:
    """Canonical spelling of a header name; null if it has characters other than letters, digits, - and _."""
    t = F.col(text) if isinstance(text, str) else text
    known = F.create_map(*[F.lit(x) for low, shown in mime.KNOWN.items() for x in (low, shown)])
    return F.when(t.rlike("^[A-Za-z0-9_-]+$"), F.coalesce(known[F.lower(t)], t))


# -- bodies of a message -----------------------------------------------------------------------------


def body_text(message: Column | str, i: int = 0) -> Column:
    """The i-th text body; of HTML its text."""
    p = text_part(message, i)
    return F.when(p["kind"] == "text", p["text"]).when(p["kind"] == "html", html_to_text(F.when(p["kind"] == "html", p["text"])))


def body_html(message: Column | str, i: int = 0) -> Column:
    """The i-th HTML body; of plain text its HTML."""
    p = html_part(message, i)
    return F.when(p["kind"] == "html", p["text"]).when(p["kind"] == "text", text_to_html(p["text"]))


def body_preview(message: Column | str, limit: int) -> Column:
    """A preview of the first text body, else of the first HTML body."""
    return F.when(text_part(message)["kind"].isNotNull(), preview_text(body_text(message), limit)).otherwise(preview_html(body_html(message), limit))


def thread_name(message: Column | str) -> Column:
    """The base subject."""
    return thread_name_of(subject(message))
