"""The JSON form of parsed messages, for comparing with stored results."""

from __future__ import annotations

from .mime import KNOWN, Header, Message, Part
from .received import FIELDS as RECEIVED

_KIND = {"text": "Text", "html": "Html", "binary": "Binary", "inline_binary": "InlineBinary", "message": "Message", "multipart": "Multipart"}


def header(h: Header) -> dict:
    name = h.name.lower().replace("-", "_") if h.name.lower() in KNOWN and KNOWN[h.name.lower()] == h.name else {"other": h.name}
    kind, value = h.value
    if kind == "Received":
        value = {k: value.get(k) for k in RECEIVED if k != "id" or k in value}
    return {"name": name, "value": "Empty" if kind == "Empty" else {kind: value}, "offset_field": h.offset_field, "offset_start": h.offset_start, "offset_end": h.offset_end}


def part(p: Part) -> dict:
    body = message(p.body) if p.kind == "message" else list(p.body) if p.kind in ("binary", "inline_binary") else p.body
    return {"headers": [header(h) for h in p.headers], "is_encoding_problem": p.problem, "body": {_KIND[p.kind]: body}, "offset_header": p.offset_header, "offset_body": p.offset_body, "offset_end": p.offset_end}


def message(m: Message) -> dict:
    return {"html_body": m.html_body, "text_body": m.text_body, "attachments": m.attachments, "parts": [part(p) for p in m.parts]}
