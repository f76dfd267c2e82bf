"""Received fields: clauses, addresses in comments, protocol and TLS words, date."""

from __future__ import annotations

import ipaddress
import re

from . import dates

#: Spellings of protocols, greetings and clause words.
PROTOCOLS = {
    "SMTP": "smtp smtpd smtpsvc bsmtp localbsmtp",
    "ESMTP": "esmtp localesmtp",
    "ESMTPA": "esmtpa asmtp",
    "ESMTPS": "esmtps localesmtps esmtptls",
    "ESMTPSA": "esmtpsa",
    "LMTP": "lmtp lsmtp",
    "LMTPA": "lmtpa",
    "LMTPS": "lmtps",
    "LMTPSA": "lmtpsa",
    "MMS": "mms",
    "UTF8SMTP": "utf8smtp",
    "UTF8SMTPA": "utf8smtpa",
    "UTF8SMTPS": "utf8smtps",
    "UTF8SMTPSA": "utf8smtpsa",
    "UTF8LMTP": "utf8lmtp",
    "UTF8LMTPA": "utf8lmtpa",
    "UTF8LMTPS": "utf8lmtps",
    "UTF8LMTPSA": "utf8lmtpsa",
    "HTTP": "http httpu httprest",
    "HTTPS": "https",
    "IMAP": "imap",
    "POP3": "pop3",
    "Local": "local stdin socket",
}
GREETINGS = {"helo": "Helo", "ehlo": "Ehlo", "lhlo": "Lhlo"}
CLAUSES = ("by", "for", "from", "id", "via", "with", "ident")
CIPHERS = ("rsa", "ecd", "dhe", "psk", "srp", "aes", "des", "tls")
#: Words that may have dashes in them.
DASHED = ("localbsmtp", "localesmtp", "localesmtps", "esmtptls")

_PROTOCOL = {w: p for p, words in PROTOCOLS.items() for w in words.split()}
_TLS = re.compile(r"(?:(tls)[._-]*v?[._-]*(?:(1)[._]*([0-3])?)|(ssl)v?([23])|(dtls)[._]*v?[._]*1[._]*([023]))\Z", re.I)
_MONTH = {m: i + 1 for i, m in enumerate(dates.MONTHS)}
_BREAK = re.compile(rb"[ \t\r\n()<>\[\]=;/\",]")
_SEPARATORS = set("[]<>();:=/\",")


class _Word:
    __slots__ = ("brackets", "depth", "kind", "text", "value")

    def __init__(self, kind: str, text: str = "", value: object = None, depth: int = 0, brackets: int = 0):
        self.kind, self.text, self.value, self.depth, self.brackets = kind, text, value, depth, brackets

    def is_separator(self) -> bool:
        return self.kind in _SEPARATORS


def _classify(text: str) -> tuple[str, object]:
    """Kind and value of a word by its shape, then by its spelling."""
    digits = sum(c.isdigit() for c in text)
    plain = text.isascii()
    if plain and re.fullmatch(r"[0-9.]+", text) and text.count(".") == 3 and 4 <= digits <= 12:
        return _ip(ipaddress.IPv4Address, text)
    if plain and text.count(":") >= 2 and re.fullmatch(r"[0-9A-Fa-f:.]+", text):
        return _ip(ipaddress.IPv6Address, text)
    if re.fullmatch(r"(?:[0-9]+[+-]?[0-9]*|[+-][0-9]+)", text, re.A):
        return ("integer", int(text)) if re.fullmatch(r"[+-]?[0-9]{1,18}", text, re.A) else ("text", None)
    if text.count("@") == 1 and re.search(r"[A-Za-z]", text):
        return "email", None
    low = text.lower()
    if plain and low.isalnum():
        if low in CLAUSES:
            return low, None
        if low in _MONTH:
            return "month", _MONTH[low]
        if low in GREETINGS:
            return "greeting", GREETINGS[low]
        if low in _PROTOCOL and low not in DASHED[:2]:
            return "protocol", _PROTOCOL[low]
    bare = low.replace("-", "")
    if plain and bare in DASHED and bare.isalnum():
        return "protocol", _PROTOCOL[bare]
    if plain and (m := _TLS.match(text)):
        if m[4]:
            return "tls", f"SSLv{m[5]}"
        if m[6]:
            return "tls", f"DTLSv1_{m[7]}"
        if m[3] or text[3:].lower() in ("1", "v1"):
            return "tls", f"TLSv1_{m[3] or 0}"
    if "." in text and re.search(r"[A-Za-z]", text) and not re.search(r"[@+:_]|[!#$%&'*?^`{|}~\\]", text):
        return "domain", None
    if plain and len(text) > 6 and text == text.upper() and digits and re.search(r"[_-]", text) and re.fullmatch(r"[A-Z0-9_-]+", text) and re.sub(r"[_-]", "", low)[:3] in CIPHERS:
        return "cipher", None
    return "text", None


def _ip(kind, text: str) -> tuple[str, object]:
    try:
        return "ip", str(kind(text))
    except ValueError:
        return "text", None


def _words(value: bytes, closed: bool):
    """Words and separators of a field with the depths of comments and brackets they stand in."""
    at, depth, brackets, quoted, dated = 0, 0, 0, False, False
    while at < len(value):
        m = _BREAK.search(value, at)
        stop = m.start() if m else len(value)
        chunk = value[at:stop]
        colon = chunk.find(b":")
        if colon >= 0:  # part of an IPv6 address, or a separator
            run = re.match(rb"[0-9A-Fa-f:]*", chunk).end()
            keep = run == len(chunk) or chunk.count(b":", 0, run) >= 2 and re.fullmatch(rb"[0-9A-Fa-f:.]+", chunk)
            if dated or not keep or chunk.count(b":") > 7:
                stop, m = at + colon, re.compile(rb":").match(value, at + colon)
                chunk = chunk[:colon]
        here, inside = depth, brackets
        mark = m[0] if m else b""
        at = stop + len(mark)
        if mark == b"(" and not quoted:
            depth += 1
        elif mark == b")" and not quoted:
            depth = max(0, depth - 1)
        elif mark == b"[" and not quoted:
            brackets = depth + 1
        elif mark == b"]" and not quoted:
            brackets = max(0, depth - 1)
        elif mark == b'"':
            quoted = not quoted
        elif mark == b";" and depth == 0:
            dated = True
        if chunk:
            if not mark and not closed:
                chunk = chunk[:-1]
            try:
                text = chunk.decode()
            except UnicodeDecodeError:
                text = ""
            kind, x = _classify(text) if text else ("text", None)
            yield _Word(kind, text, x, here, inside)
        if mark and mark not in b" \t\r\n":
            yield _Word(mark.decode())


def parse_received(value: bytes, closed: bool = True) -> dict | None:
    """The parts of a Received field, None if it has none."""
    words = list(_words(value, closed))
    out: dict = {}
    date: list[int] = []
    state, i = "", 0

    def skip(marks: str) -> _Word | None:
        """The first word behind any of ``marks``."""
        nonlocal i
        while i < len(words) and words[i].kind in marks and len(words[i].kind) == 1:
            i += 1
        return words[i] if i < len(words) else None

    def host(marks: str, key: str) -> None:
        nonlocal i
        w = skip(marks)
        if w and w.kind == "ip":
            out[key] = {"IpAddr": w.value}
        elif w and not w.is_separator():
            out[key] = {"Name": w.text}
        else:
            return
        i += 1

    def word(marks: str, key: str) -> None:
        nonlocal i
        w = skip(marks)
        if w and not w.is_separator():
            out[key] = w.text
            i += 1

    while i < len(words):
        w = words[i]
        i += 1
        if w.kind == "from" and "from" not in out:
            host("[", "from")
            state = "from"
        elif w.kind == "by" and w.depth == 0:
            host("[<", "by")
            state = "by"
        elif w.kind == "for" and w.depth == 0:
            x = skip("=<")
            if x and x.kind == "email":
                out["for_"] = x.text
                i += 1
            state = "for"
        elif w.kind == ";":
            state = "date"
        elif w.kind == "id" and w.depth == 0:
            word("=<[:", "id")
            state = "id"
        elif w.kind == "with" and w.depth == 0:
            while i < len(words) and words[i].kind not in (";", "tls", "by", "for", "from", "id", "via", "with"):
                i += 1
                if words[i - 1].kind == "protocol":
                    out["with"] = words[i - 1].value
                    break
            state = "with"
        elif w.kind == "via" and w.depth == 0:
            word("=", "via")
            state = "via"
        elif w.kind == "ident" and w.depth > 0:
            word("=<[:", "ident")
        elif w.kind == "greeting" and state == "from" and w.depth > 0:
            out["helo_cmd"] = w.value
            host("=[:", "helo")
        elif w.kind == "ip" and state == "from" and (w.brackets > 0 or w.depth > 0 and "from_ip" not in out):
            out["from_ip"] = w.value
        elif w.kind == "domain" and state == "from" and w.depth > 0:
            out["from_iprev"] = w.text
        elif w.kind == "email" and state == "from":
            out["ident"] = w.text.removesuffix("@")
        elif w.kind in ("integer", "month") and state == "date":
            date.append(w.value)
        elif w.kind == "cipher" and (w.depth > 0 or "tls_cipher" not in out):
            out["tls_cipher"] = w.text
        elif w.kind == "tls" and w.depth > 0 and "tls_version" not in out:
            out["tls_version"] = w.value
    if len(date) >= 6:
        zone = date[6] if len(date) > 6 else 0
        year = date[2] + 1900 if 1 <= date[2] <= 99 else date[2]
        before = zone < 0 or len(date) < 7
        out["date"] = dates.make(year, date[1], date[0], date[3], date[4], date[5], before, abs(zone) // 100, abs(zone) % 100)
    return out or None


FIELDS = ("from", "from_ip", "from_iprev", "by", "for_", "with", "tls_version", "tls_cipher", "id", "ident", "helo", "helo_cmd", "via", "date")
