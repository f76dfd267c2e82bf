"""Transfer encodings: Base64, quoted-printable, percent escapes."""

from __future__ import annotations

import binascii
import re

BLANK = b" \t\r\n"
_B64_BODY = re.compile(rb"[A-Za-z0-9+/= \t\r\n-]*\Z")
_B64_STRICT = re.compile(rb"[A-Za-z0-9+/= \t\r\n]*\Z")
_QP_ESCAPE = re.compile(rb"=[ \t\x0c]*(?:([0-9A-Fa-f])([^=])|([0-9A-Fa-f]?=)|[0-9A-Fa-f]?\Z|([^=]))", re.S)
_QP_HALF = re.compile(rb"(=[ \t\x0c]*[0-9A-Fa-f])((?:\r*\n)+)")


def base64_groups(data: bytes, closed: bool = False) -> bytes:
    """Decode letters of the alphabet; "=" ends a group early, and a short group that nothing ends is dropped."""
    groups = data.split(b"=")
    if len(data) % 4 == 0 and (len(groups) == 1 or not any(groups[1:]) and len(groups) < 4):
        return binascii.a2b_base64(data)
    out = []
    for i, g in enumerate(groups):
        rest = len(g) % 4
        if i == len(groups) - 1 and not closed:
            g = g[: len(g) - rest]
        elif rest == 1:
            g += b"A"
        out.append(binascii.a2b_base64(g + b"=" * (-len(g) % 4)))
    return b"".join(out)


def base64_decode(data: bytes) -> bytes | None:
    """Strict alphabet, white space skipped, None at any other byte."""
    return base64_groups(data.translate(None, BLANK)) if _B64_STRICT.match(data) else None


def base64_body(data: bytes) -> bytes | None:
    """As ``base64_decode``; single dashes are skipped too."""
    return base64_groups(data.translate(None, BLANK + b"-")) if _B64_BODY.match(data) else None


_TRAIL = re.compile(rb"[ \t\x0c]+\n")
_CROWDED = re.compile(rb"=[^\n]?=")
_DOUBLED = re.compile(rb"=[ \t\x0c]*[0-9A-Fa-f]?=\Z")
_OPEN = re.compile(rb"=[ \t\x0c]*[0-9A-Fa-f]\Z")
_BYTES = {bytes([a, b]): bytes([int(chr(a) + chr(b), 16)]) for a in b"0123456789ABCDEFabcdef" for b in b"0123456789ABCDEFabcdef"}


def _regular(data: bytes) -> tuple[bytes, bytes] | None:
    """As ``_quoted`` for data with one kind of newline and good escapes alone; None for any other."""
    newline = b"\n"
    if b"\r" in data:
        newline = b"\r\n"
        if not data.count(b"\r") == data.count(newline) == data.count(b"\n"):
            return None
        data = data.replace(newline, b"\n")
    data = _TRAIL.sub(b"\n", data)
    if _CROWDED.search(data):
        return None
    data = data.replace(b"=\n", b"")
    if newline == b"\r\n":
        data = data.replace(b"\n", newline)
    plain, *escaped = data.split(b"=")
    try:
        return b"".join([plain, *[_BYTES[x[:2]] + x[2:] for x in escaped]]), newline
    except KeyError:
        return None


def _quoted(data: bytes, lenient: bool) -> tuple[bytes, bytes] | None:
    """Decoded bytes and the newline that was in use at the end."""
    if found := _regular(data):
        return found
    out, newline = [], b"\n"
    lines = _QP_HALF.sub(rb"\2\1", data).split(b"\n")  # half an escape waits behind the newline for its end
    bad = False

    def escape(m: re.Match) -> bytes:
        nonlocal bad
        if m[1]:
            return _BYTES.get(m[1] + m[2]) or _literal(m)
        if m[4]:
            return _literal(m)
        bad = bad or m[3] is not None
        return b""

    def _literal(m: re.Match) -> bytes:
        nonlocal bad
        bad = bad or not lenient
        return b"=" + (m[1] + m[2] if m[1] else m[4])

    for i, line in enumerate(lines):
        if b"\r" in line:
            newline, line = b"\r\n", line.replace(b"\r", b"")
        if i < len(lines) - 1:
            bare = line.rstrip(b" \t\x0c")
            if len(bare) < len(line) and _OPEN.search(bare):
                bare = line[: len(bare) + 1]  # this blank belongs to a bad escape
            soft = bare.endswith(b"=")
            bad = bad or soft and _DOUBLED.search(bare) is not None
            line = bare[:-1] if soft else bare
            out.append(_QP_ESCAPE.sub(escape, line) if b"=" in line else line)
            if not soft:
                out.append(newline)
        else:
            out.append(_QP_ESCAPE.sub(escape, line) if b"=" in line else line)
        if bad:
            return None
    return b"".join(out), newline


def quoted_printable_decode(data: bytes) -> bytes | None:
    """Soft breaks joined, white space at line ends removed, None at a bad escape; after a CR lines end in CRLF."""
    got = _quoted(data, lenient=False)
    return got[0] if got else None


def quoted_printable_body(data: bytes, boundary: bool) -> bytes | None:
    """As above, but bad escapes stay as they are; only a doubled "=" fails.

    Before a boundary the data include the boundary's first dash, which goes again together with
    the newline before it.
    """
    got = _quoted(data, lenient=True)
    if got is None:
        return None
    text, newline = got
    if boundary:
        drop = 1 + (len(newline) if data[-2:-1] in (b"\n", b"") else 0)
        text = text[: max(0, len(text) - drop)]
    return text


def quoted_printable_char(high: int, low: int) -> int | None:
    """The byte of two hexadecimal digits."""
    pair = bytes([high, low])
    return int(pair, 16) if re.fullmatch(rb"[0-9A-Fa-f]{2}", pair) else None


def percent_decode(data: bytes) -> tuple[bool, bytes]:
    """Percent escapes; at a bad one False and what came before it. A plus sign stays."""
    bad = re.search(rb"%(?![0-9A-Fa-f]{2})", data)
    good = data if bad is None else data[: bad.start()]  # every escape in it is whole
    if bad is not None and re.match(rb"%[0-9A-Fa-f]?\Z", data[bad.start() :]):
        bad = None  # an escape that the end cuts off is dropped
    plain, *escaped = good.split(b"%")
    return bad is None, b"".join([plain, *[_BYTES[x[:2]] + x[2:] for x in escaped]])
