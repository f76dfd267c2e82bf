"""Encoded words of header fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .charsets import decode, utf8
from .decoders import base64_groups

_HEAD = re.compile(rb"=\?([^?\n]*)\?([bBqQ])\?")
_BASE64 = re.compile(rb"((?:[A-Za-z0-9+/= \t\r]|\n[ \t])*)\?=")
_QUOTED = re.compile(rb"((?:[^?\n]|\?(?!=)|\n[ \t]+)*)\?=")
_FOLD = re.compile(rb"\r|\n[ \t]+")
_HEX = re.compile(rb"=([0-9A-Fa-f]{2})")


def encoded_word(data: bytes, at: int) -> tuple[str, int] | None:
    """The word that starts with "=?" at ``at``, and where it ends; None if it is malformed."""
    head = _HEAD.match(data, at)
    if head is None:
        return None
    charset = head[1].split(b"*", 1)[0] or head[1]
    if len(charset) < 2:
        return None
    quoted = head[2] in b"qQ"
    body = (_QUOTED if quoted else _BASE64).match(data, head.end())
    if body is None:
        return None
    if quoted:
        text = _FOLD.sub(b"", body[1]).replace(b"_", b" ")
        if text.count(b"=") != len(_HEX.findall(text)):
            return None
        raw = _HEX.sub(lambda m: bytes([int(m[1], 16)]), text)
    else:
        raw = base64_groups(body[1].translate(None, b" \t\r\n"))
    return decode(raw, charset), body.end()


def pieces(value: bytes, stops: bytes = b"", only_at_start: bool = False) -> Iterator[tuple[str, str]]:
    """Pieces of a field value: ("text", ...), ("word", ...) and ("stop", ...) for each byte of ``stops``.

    Text is cut at line folds and stripped; an encoded word is recognised anywhere, or only where a
    text begins.
    """
    find = re.compile(rb"=\?|[\n" + re.escape(stops) + rb"]")
    start = at = 0

    def text(end: int) -> Iterator[tuple[str, str]]:
        if bare := value[start:end].strip(b" \t\r"):
            yield "text", utf8(bare)

    while m := find.search(value, at):
        if m[0] == b"=?":
            before = value[start : m.start()].rstrip(b"\r")
            word = None if only_at_start and before and before[-1:] not in (b" ", b"\t") else encoded_word(value, m.start())
            if word is None:
                at = m.start() + 1
                continue
            yield from text(m.start())
            yield "word", word[0]
            start = at = word[1]
        else:
            yield from text(m.start())
            start = at = m.end()
            if m[0] != b"\n":
                yield "stop", m[0].decode()
    yield from text(len(value))


def joined(parts: list[tuple[str, str]]) -> str:
    """Pieces with single spaces, but none between two encoded words."""
    out = []
    for i, (kind, text) in enumerate(parts):
        if i and not (kind == "word" and parts[i - 1][0] == "word"):
            out.append(" ")
        out.append(text)
    return "".join(out)
