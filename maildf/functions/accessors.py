"""Accessors of a ``message`` column, as native expressions that Catalyst can prune and fold.

All read the root message. ``part`` arguments are part structs, ``value`` arguments header values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.mime import KNOWN
from ..parse import IDS, OTHER_ID


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _same(name: str):
    shown = KNOWN.get(name.lower())
    return (lambda h: h["name"] == shown) if shown else (lambda h: F.lower(h["name"]) == name.lower())


def _last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def _at(a: Column, i: int | Column) -> Column:
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


# -- messages -------------------------------------------------------------------------------------


def is_empty(message: Column | str) -> Column:
    """No parts at all."""
    return F.coalesce(F.size(_col(message)["parts"]), F.lit(0)) <= 0


def root_part(message: Column | str) -> Column:
    return _at(_col(message)["parts"], 0)


def bodies(message: Column | str) -> Column:
    """Body and attachment ids of the root message."""
    return _at(_col(message)["messages"], 0)


def headers(message: Column | str) -> Column:
    return root_part(message)["headers"]


def header_struct(message: Column | str, name: str) -> Column:
    """The last header of that name, with its offsets."""
    return part_header_struct(root_part(message), name)


def header(message: Column | str, name: str) -> Column:
    """The value of the last header of that name."""
    return header_struct(message, name)["value"]


def header_values(message: Column | str, name: str) -> Column:
    """Values of all headers of that name, in order."""
    return F.transform(F.filter(headers(message), _same(name)), lambda h: h["value"])


def part_header_struct(part: Column, name: str) -> Column:
    return _last(F.filter(part["headers"], _same(name)))


def part_header(part: Column, name: str) -> Column:
    return part_header_struct(part, name)["value"]


def remove_header(message: Column | str, name: str) -> Column:
    """Headers without the first of that name, into whose place the last header moves."""
    h = headers(message)
    at = F.array_position(F.transform(h, _same(name)), True).cast("int")
    n = F.size(h)
    moved = F.concat(F.slice(h, 1, F.greatest(at - 1, F.lit(0))), F.slice(h, n, F.when(at < n, 1).otherwise(0)), F.slice(h, F.least(at + 1, n), F.greatest(n - at - 1, F.lit(0))))
    return F.when(at > 0, moved).otherwise(h)


def _cut(raw: Column, start: Column, end: Column) -> Column:
    return F.substring(raw, start + 1, end - start)


def _text_or_null(raw: Column) -> Column:
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def header_raw(raw: Column | str, message: Column | str, name: str) -> Column:
    """Raw text behind the colon up to and with the newline; null if it isn't UTF-8."""
    h = header_struct(message, name)
    return _text_or_null(_cut(_col(raw), h["offset_start"], h["offset_end"]))


def headers_raw(raw: Column | str, message: Column | str) -> Column:
    """(name, raw) of every header whose bytes are UTF-8."""
    r = _col(raw)
    pairs = F.transform(headers(message), lambda h: F.struct(h["name"].alias("name"), _text_or_null(_cut(r, h["offset_start"], h["offset_end"])).alias("raw")))
    return F.filter(pairs, lambda p: p["raw"].isNotNull())


def raw_message(raw: Column | str, message: Column | str) -> Column:
    p = root_part(message)
    return _cut(_col(raw), p["offset_header"], p["offset_end"])


# -- header values ----------------------------------------------------------------------------------


def as_text(value: Column) -> Column:
    """Text, or the last of a list."""
    return F.coalesce(value["text"], _last(value["texts"]))


def as_text_list(value: Column) -> Column:
    return F.coalesce(value["texts"], F.when(value["text"].isNotNull(), F.array(value["text"])))


def as_address(value: Column) -> Column:
    return value["address"]


def as_datetime(value: Column) -> Column:
    return value["date"]


def as_content_type(value: Column) -> Column:
    return value["content_type"]


def as_received(value: Column) -> Column:
    return value["received"]


def value_is_empty(value: Column) -> Column:
    return value["kind"] == "Empty"


def value_len(value: Column) -> Column:
    """Bytes of all texts in a value, without marks between them; 24 for a date, 1 for Received, 0 for an empty value."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)))
    addr = F.flatten(F.transform(value["address"]["groups"], lambda g: F.flatten(F.transform(g["addresses"], lambda a: F.array(a["name"], a["address"])))))
    ct = value["content_type"]
    named = F.aggregate(F.coalesce(ct["attributes"], F.array().cast("array<struct<name:string,value:string>>")), F.lit(0), lambda n, a: n + F.octet_length(a["name"]) + F.octet_length(a["value"]))
    media = F.octet_length(ct["c_type"]) + F.coalesce(F.octet_length(ct["c_subtype"]), F.lit(0)) + named
    kind = value["kind"]
    return F.when(kind == "Text", F.octet_length(value["text"])).when(kind == "TextList", total(value["texts"])).when(kind == "Address", total(addr)).when(kind == "DateTime", F.lit(24)).when(kind == "ContentType", media).when(kind == "Received", F.lit(1)).otherwise(F.lit(0))


# -- typed headers ------------------------------------------------------------------------------------


def _address_of(name: str):
    def get(message: Column | str) -> Column:
        return header(message, name)["address"]

    get.__doc__ = f"The address of the last {name} header, or null."
    return get


def _value_of(name: str):
    def get(message: Column | str) -> Column:
        return header(message, name)

    get.__doc__ = f"The value of the last {name} header."
    return get


from_, to, cc, bcc = (_address_of(n) for n in ("From", "To", "Cc", "Bcc"))
reply_to, sender = _address_of("Reply-To"), _address_of("Sender")
resent_from, resent_to, resent_cc, resent_bcc, resent_sender = (_address_of(f"Resent-{n}") for n in ("From", "To", "Cc", "Bcc", "Sender"))
comments, in_reply_to, keywords, references = (_value_of(n) for n in ("Comments", "In-Reply-To", "Keywords", "References"))
return_path, mime_version = _value_of("Return-Path"), _value_of("MIME-Version")
list_archive, list_help, list_id, list_owner, list_post, list_subscribe, list_unsubscribe = (_value_of(f"List-{n}") for n in ("Archive", "Help", "ID", "Owner", "Post", "Subscribe", "Unsubscribe"))


def _all(name: str):
    def get(message: Column | str) -> Column:
        return F.filter(F.transform(header_values(message, name), lambda v: v["address"]), lambda a: a.isNotNull())

    return get


all_to, all_cc, all_bcc = _all("To"), _all("Cc"), _all("Bcc")


def date(message: Column | str) -> Column:
    return header(message, "Date")["date"]


def resent_date(message: Column | str) -> Column:
    return header(message, "Resent-Date")["date"]


def message_id(message: Column | str) -> Column:
    return as_text(header(message, "Message-ID"))


def resent_message_id(message: Column | str) -> Column:
    return as_text(header(message, "Resent-Message-ID"))


def subject(message: Column | str) -> Column:
    return as_text(header(message, "Subject"))


def received(message: Column | str) -> Column:
    """The last Received header."""
    return header(message, "Received")["received"]


def received_all(message: Column | str) -> Column:
    return F.filter(F.transform(header_values(message, "Received"), lambda v: v["received"]), lambda r: r.isNotNull())


def return_address(message: Column | str) -> Column:
    """Return-Path, or the first address of From."""
    first = F.filter(F.flatten(F.transform(from_(message)["groups"], lambda g: g["addresses"])), lambda a: F.lit(True))
    return F.coalesce(as_text(return_path(message)), _at(first, 0)["address"])


# -- parts ----------------------------------------------------------------------------------------------


def part(message: Column | str, i: int | Column) -> Column:
    return F.when(F.size(_at(_col(message)["parts"], i)["msg_path"]) == 0, _at(_col(message)["parts"], i))


def _listed(message: Column | str, which: str, i: int) -> Column:
    return _at(_col(message)["parts"], _at(bodies(message)[which], i))


def text_part(message: Column | str, i: int = 0) -> Column:
    return _listed(message, "text_body", i)


def html_part(message: Column | str, i: int = 0) -> Column:
    return _listed(message, "html_body", i)


def attachment(message: Column | str, i: int = 0) -> Column:
    return _listed(message, "attachments", i)


def _count(which: str):
    def get(message: Column | str) -> Column:
        return F.size(bodies(message)[which])

    return get


def _each(which: str):
    def get(message: Column | str) -> Column:
        parts = _col(message)["parts"]
        return F.transform(bodies(message)[which], lambda i: F.get(parts, i))

    return get


text_body_count, html_body_count, attachment_count = _count("text_body"), _count("html_body"), _count("attachments")
text_bodies, html_bodies, attachments = _each("text_body"), _each("html_body"), _each("attachments")


def contents(part: Column) -> Column:
    """Bytes of a part, of a message that was encoded its decoded bytes; null for multiparts and messages in place."""
    return F.coalesce(part["text"].cast("binary"), part["bytes"])


def nested_raw(raw: Column | str, message: Column | str, part: Column) -> Column:
    """Raw bytes of a part's nested message, whether it was encoded or not."""
    first = _at(sub_message(message, part)["parts"], 0)
    return F.when(part["kind"] == "message", F.coalesce(part["bytes"], _cut(_col(raw), first["offset_header"], first["offset_end"])))


def text_contents(part: Column) -> Column:
    """Text of a text part, or binary contents that are UTF-8."""
    return F.coalesce(part["text"], _text_or_null(part["bytes"]))


def part_len(part: Column) -> Column:
    """Bytes of the contents, of a nested message its raw length, 0 for a multipart."""
    nested = F.coalesce(F.octet_length(part["bytes"]), part["offset_end"] - part["offset_body"])
    return F.when(part["kind"] == "multipart", 0).when(part["kind"] == "message", nested).otherwise(F.octet_length(contents(part)))


def part_is_empty(part: Column) -> Column:
    return part_len(part) == 0


def sub_parts(part: Column) -> Column:
    return part["children"]


def sub_message(message: Column | str, part: Column) -> Column:
    """The nested message of a part, with paths as they are; null for other parts."""
    m, path = _col(message), F.concat(part["msg_path"], F.array(part["part_id"]))
    inside = lambda p: F.slice(p["msg_path"], 1, F.size(path)) == path
    return F.when(part["kind"] == "message", F.struct(F.filter(m["messages"], inside).alias("messages"), F.filter(m["parts"], inside).alias("parts")))


def is_text(part: Column) -> Column:
    return part["kind"].isin("text", "html")


def is_text_html(part: Column) -> Column:
    return part["kind"] == "html"


def is_binary(part: Column) -> Column:
    return part["kind"].isin("binary", "inline_binary")


def is_multipart(part: Column) -> Column:
    return part["kind"] == "multipart"


def is_message(part: Column) -> Column:
    return part["kind"] == "message"


def raw_len(part: Column) -> Column:
    return part["offset_end"] - part["offset_header"]


def raw_header_offset(part: Column) -> Column:
    return part["offset_header"]


def raw_body_offset(part: Column) -> Column:
    return part["offset_body"]


def raw_end_offset(part: Column) -> Column:
    return part["offset_end"]


def display(part: Column) -> Column:
    return F.coalesce(text_contents(part), F.lit("[no contents]"))


# -- MIME headers of a part --------------------------------------------------------------------------------


def content_description(part: Column) -> Column:
    return as_text(part_header(part, "Content-Description"))


def content_disposition(part: Column) -> Column:
    return part_header(part, "Content-Disposition")["content_type"]


def content_id(part: Column) -> Column:
    return as_text(part_header(part, "Content-ID"))


def content_transfer_encoding(part: Column) -> Column:
    return as_text(part_header(part, "Content-Transfer-Encoding"))


def content_type(part: Column) -> Column:
    return part_header(part, "Content-Type")["content_type"]


def content_language(part: Column) -> Column:
    return part_header(part, "Content-Language")


def content_location(part: Column) -> Column:
    return as_text(part_header(part, "Content-Location"))


def attribute(ct: Column, name: str) -> Column:
    """The first attribute of exactly that name."""
    return _at(F.filter(ct["attributes"], lambda a: a["name"] == name), 0)["value"]


def has_attribute(ct: Column, name: str) -> Column:
    return F.coalesce(F.exists(ct["attributes"], lambda a: a["name"] == name), F.lit(False))


def remove_attribute(ct: Column, name: str) -> Column:
    """Attributes without the first of that name, into whose place the last one moves."""
    a = ct["attributes"]
    at, n = F.array_position(F.transform(a, lambda x: x["name"] == name), True).cast("int"), F.size(a)
    moved = F.concat(F.slice(a, 1, F.greatest(at - 1, F.lit(0))), F.slice(a, n, F.when(at < n, 1).otherwise(0)), F.slice(a, F.least(at + 1, n), F.greatest(n - at - 1, F.lit(0))))
    return F.when(at > 0, moved).otherwise(a)


def ctype(ct: Column) -> Column:
    return ct["c_type"]


def subtype(ct: Column) -> Column:
    return ct["c_subtype"]


def is_attachment(ct: Column) -> Column:
    return ct["c_type"] == "attachment"


def is_inline(ct: Column) -> Column:
    return ct["c_type"] == "inline"


def attachment_name(part: Column) -> Column:
    return F.coalesce(attribute(content_disposition(part), "filename"), attribute(content_type(part), "name"))


def is_content_type(part: Column, kind: str, sub: str) -> Column:
    ct = content_type(part)
    return F.coalesce((F.lower(ct["c_type"]) == kind.lower()) & (F.lower(ct["c_subtype"]) == sub.lower()), F.lit(False))


# -- spellings ---------------------------------------------------------------------------------------------


def tls_version_text(version: Column) -> Column:
    return F.replace(version, F.lit("_"), F.lit("."))


def greeting_text(greeting: Column) -> Column:
    return F.upper(greeting)


def host_text(host: Column) -> Column:
    return F.coalesce(host["name"], host["ip"])


def header_name_id(name: Column | str) -> Column:
    """The id of a header name; 37 for any that is not known."""
    ids = F.create_map(*[F.lit(x) for low, i in IDS.items() for x in (low, i)])
    return F.coalesce(ids[F.lower(_col(name))], F.lit(OTHER_ID))


def is_other_header(name: Column | str) -> Column:
    return header_name_id(name) == OTHER_ID


def is_mime_header(name: Column | str) -> Column:
    return F.lower(_col(name)).isin("content-description", "content-id", "content-language", "content-location", "content-transfer-encoding", "content-type", "content-disposition")
