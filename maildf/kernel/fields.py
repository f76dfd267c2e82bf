"""Parsers of header field values.

Each takes the whole message and the offset behind the colon and returns (value, end). A value is a
pair of kind and content: ("Text", str), ("TextList", list), ("Address", dict), ("DateTime", dict),
("ContentType", dict), ("Received", dict) or EMPTY. A field ends at a newline that no space or tab
follows; text, id, list and content-type fields that the end of the data cuts off are empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .charsets import decode, utf8
from .dates import parse_date
from .decoders import percent_decode
from .words import encoded_word, joined, pieces

EMPTY = ("Empty", None)
Value = tuple[str, object]
Parser = Callable[[bytes, int], tuple[Value, int]]
_END = re.compile(rb"\n(?![ \t])")


def extent(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """Bytes of a field with its newline, where it ends, and whether a newline ends it."""
    m = _END.search(data, at)
    end = m.end() if m else len(data)
    return data[at:end], end, m is not None


def raw(data: bytes, at: int) -> tuple[Value, int]:
    """Trimmed text with its folds."""
    value, end, _ = extent(data, at)
    bare = value.strip(b" \t\r\n")
    return (("Text", utf8(bare)) if bare else EMPTY), end


def ignore(data: bytes, at: int) -> tuple[Value, int]:
    return EMPTY, extent(data, at)[1]


def unstructured(data: bytes, at: int) -> tuple[Value, int]:
    """Unfolded text with encoded words decoded."""
    value, end, closed = extent(data, at)
    if closed and b"=?" not in value and value.find(b"\n") == len(value) - 1:  # one plain line
        bare = value.strip(b" \t\r\n")
        return (("Text", utf8(bare)) if bare else EMPTY), end
    parts = list(pieces(value)) if closed else []
    return (("Text", joined(parts)) if parts else EMPTY), end


def _listed(items: list[str]) -> Value:
    return EMPTY if not items else ("Text", items[0]) if len(items) == 1 else ("TextList", items)


_ID = re.compile(rb"<([^>]*)>?")


def ids(data: bytes, at: int) -> tuple[Value, int]:
    """Contents of angle brackets; without any, the bare text."""
    value, end, closed = extent(data, at)
    if not closed:
        return EMPTY, end
    found = [m[1].strip(b"< \t\r\n") for m in _ID.finditer(value) if m[0][-1:] == b">"]
    found = [utf8(x) for x in found if x]
    if found:
        return _listed(found), end
    plain = _ID.sub(lambda m: b" " * len(m[0]), value)
    bare = plain.strip(b" \t\r\n")
    if not bare:
        return EMPTY, end
    start = len(plain) - len(plain.lstrip(b" \t\r\n"))
    return ("Text", utf8(value[start : start + len(bare)])), end


def comma_list(data: bytes, at: int) -> tuple[Value, int]:
    """Items between commas; encoded words count at the start of a word."""
    value, end, closed = extent(data, at)
    if not closed:
        return EMPTY, end
    items, parts = [], []
    for kind, text in [*pieces(value, b",", only_at_start=True), ("stop", ",")]:
        if kind != "stop":
            parts.append((kind, text))
        elif parts:
            items.append(joined(parts))
            parts = []
    return _listed(items), end


class _Mailboxes:
    """A recursive reader of address lists: names, angle addresses, quotes, comments and groups."""

    #: What ends a stretch of plain text in each context.
    STOPS = {
        "name": re.compile(rb'[\n,<"(:;]|=\?'),
        "angle": re.compile(rb"[\n>\\(]|=\?"),
        "quote": re.compile(rb'[\n"\\]|=\?'),
        "comment": re.compile(rb"[\n()\\]|=\?"),
    }

    def __init__(self, value: bytes, closed: bool):
        self.value, self.closed, self.at = value, closed, 0
        self.names, self.mails, self.comments = [], [], []
        self.glued = True  # the last thing was an encoded word, or nothing yet
        self.addresses, self.groups = [], []
        self.group_name = self.group_comment = None

    # -- gathering ---------------------------------------------------------------------------------

    def _add(self, context: str, token: bytes) -> None:
        if not token:
            return
        text, spaced = utf8(token), context in ("name", "comment")
        into = self.comments if context == "comment" else self.names
        if context == "angle" or context == "name" and b"@" in token:
            into, spaced = self.mails, False
        if spaced and into:
            into.append(" ")
        into.append(text)
        self.glued = False

    def _add_word(self, context: str, word: str) -> None:
        into = self.comments if context == "comment" else self.names
        if into and not self.glued and context != "quote":
            into.append(" ")
        into.append(word)
        self.glued = True

    @staticmethod
    def _take(parts: list[str]) -> str | None:
        text = "".join(parts) if parts else None
        parts.clear()
        return text

    def _close_address(self) -> None:
        mail, name, note = (self._take(x) for x in (self.mails, self.names, self.comments))
        if mail is not None:
            both = f"{name} ({note})" if name is not None and note is not None else name if name is not None else note
            self.addresses.append({"name": both, "address": mail})
        elif name is not None and note is not None:
            self.addresses.append({"name": note, "address": name})
        elif name is not None or note is not None:
            self.addresses.append({"name": name if name is not None else note, "address": None})

    def _open_group(self) -> None:
        self._close_group()
        name, note, mail = (self._take(x) for x in (self.names, self.comments, self.mails))
        self.group_name = self.group_name if name is None else name
        self.group_comment = self.group_comment if note is None else note
        if mail is not None:
            self.group_name = mail if self.group_name is None else f"{self.group_name} {mail}"

    def _close_group(self) -> None:
        name, note = self.group_name, self.group_comment
        if name is None and not self.addresses:
            return
        if self.addresses:
            label = f"{name} ({note})" if name is not None and note is not None else name if name is not None else note
            self.group_comment = None if name is None or note is not None else note
        else:
            label = name
        self.groups.append({"name": label, "addresses": self.addresses})
        self.addresses, self.group_name = [], None

    # -- reading -----------------------------------------------------------------------------------

    def _stretch(self, context: str, start: int, literal: bool) -> tuple[int, int, bytes]:
        """The next stop from the cursor: (its offset, its end, which). ``literal``: the first byte is no stop."""
        v, at = self.value, self.at + literal
        while m := self.STOPS[context].search(v, at):
            if m[0] == b"=?":
                before = v[start : m.start()].rstrip(b"\r")
                fresh = not before or before[-1:] in (b" ", b"\t")
                if m.start() == start and context == "quote" and literal:
                    fresh = False
                word = encoded_word(v, m.start()) if fresh else None
                if word is None:
                    at = m.start() + 1
                    continue
                self.word = word
                return m.start(), word[1], b"=?"
            return m.start(), m.end(), m[0]
        return len(v), len(v), b""

    def _read(self, context: str) -> None:
        """Read one context to its end; other contexts within are read by calls."""
        depth, literal = 0, False
        start = self.at
        while True:
            stop, end, what = self._stretch(context, start, literal)
            token = self.value[start:stop]
            if context == "quote":
                token = token.strip(b"\r") if literal or what == b"\n" else token.lstrip(b"\r")
                token = token if token.strip(b"\r") else b""
            else:
                token = token.strip(b" \t\r")
            literal = False
            if context == "comment" and what in (b"(", b")") and (what == b"(" or depth):
                depth += 1 if what == b"(" else -1
                self.at = end
                continue  # an inner parenthesis is text
            if what or self.closed:
                self._add(context, token)
            self.at = start = end
            if what == b"":
                self.ended = True
                return
            if what == b"\n":
                if end >= len(self.value):
                    self.ended = True
                    return
                if context == "quote":
                    pass  # the space behind the fold is text
                else:
                    start = self.at = end + 1
            elif what == b"=?":
                self._add_word(context, self.word[0])
            elif what == b"\\":
                literal = self.value[end : end + 1] not in (b"", b" ", b"\t", b"\n", b"\r")
            elif what == b"(" and context != "comment":
                self.glued = False
                self._read("comment")
                if self.ended:
                    return
                self.glued = False
                start = self.at
            elif context != "name":
                return  # its own closing character
            elif what == b",":
                self._close_address()
            elif what == b"<":
                self._read("angle")
                start = self.at
            elif what == b'"':
                self._read("quote")
                start = self.at
            elif what == b":":
                self._open_group()
            elif what == b";":
                self._close_address()
                self._close_group()
            if self.ended:
                return

    ended = False  # a newline that is no fold was met

    def result(self) -> Value:
        self._read("name")
        self._close_address()
        if self.group_name is not None or self.groups:
            self._close_group()
            return "Address", {"Group": self.groups}
        return ("Address", {"List": self.addresses}) if self.addresses else EMPTY


_ATOM = rb"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+"
_SPEC = rb"[^ \t\r\n<>\\()@,:;\"=]+@[^ \t\r\n<>\\()@,:;\"=]+"
_BOX = rb"[ \t]*(?:(?:\"([^\"\\\r\n= \t](?:[^\"\\\r\n=]*[^\"\\\r\n= \t])?)\"|(" + _ATOM + rb"(?: " + _ATOM + rb")*))[ \t]+)?<(" + _SPEC + rb")>[ \t]*|[ \t]*(" + _SPEC + rb")[ \t]*"
_BOXES = re.compile(rb"(?:(?:" + _BOX + rb"),)*(?:" + _BOX + rb")\r?\n\Z")
_EACH = re.compile(_BOX)


def address(data: bytes, at: int) -> tuple[Value, int]:
    value, end, closed = extent(data, at)
    if closed and len(value) < 4096 and b"=?" not in value and _BOXES.match(value):  # plain mailboxes, the common case
        found, i = [], 0
        while m := _EACH.match(value, i):
            quoted, name, mail, bare = m.groups()
            name = quoted if name is None else name
            found.append({"name": None if name is None else utf8(name), "address": utf8(bare if mail is None else mail)})
            i = m.end() + 1  # the comma
        return ("Address", {"List": found}), end
    return _Mailboxes(value, closed).result(), end


def date(data: bytes, at: int) -> tuple[Value, int]:
    found, end = parse_date(data, at)
    return (("DateTime", found) if found else EMPTY), end


_PLAIN_TYPE = re.compile(rb"[ \t]*([A-Za-z0-9.+_-]+)(?:/([A-Za-z0-9.+_-]+))?[ \t]*((?:;(?:[ \t]|\r?\n[ \t])*[A-Za-z0-9_-]+=(?:[A-Za-z0-9._+/:-]+|\"[^\"\\\r\n=]*\")[ \t]*)*);?[ \t]*\r?\n\Z")
_PLAIN_PARAM = re.compile(rb";(?:[ \t]|\r?\n[ \t])*([A-Za-z0-9_-]+)=(?:\"([^\"\\\r\n=]*)\"|([A-Za-z0-9._+/:-]+))")


def content_type(data: bytes, at: int) -> tuple[Value, int]:
    value, end, closed = extent(data, at)
    if not closed:
        return EMPTY, end
    m = _PLAIN_TYPE.match(value)
    if m:
        params = [{"name": utf8(p[1]).lower(), "value": utf8(p[3] if p[2] is None else p[2])} for p in _PLAIN_PARAM.finditer(m[3]) if p[2] != b""]
        return ("ContentType", {"c_type": utf8(m[1]).lower(), "c_subtype": utf8(m[2]).lower() if m[2] else None, "attributes": params or None}), end
    return _Parameters(value).result(), end


def _lower(b: bytes) -> str:
    """Lower case for ASCII alone."""
    return utf8(b.lower())


class _Parameters:
    """A reader of media types with parameters, continuations, comments and their malformed kin."""

    PLAIN = {
        "type": re.compile(rb"[\n/;(\"\\]"),
        "subtype": re.compile(rb"[\n;(\"\\]"),
        "name": re.compile(rb"[\n;*=(\"\\]"),
        "value": re.compile(rb"[\n;\"\\'(]|=\?"),
        "quoted": re.compile(rb"[\n\"\\']|=\?"),
        "comment": re.compile(rb"[\n()\\]"),
    }

    def __init__(self, value: bytes):
        self.value = value
        self.type = self.subtype = self.name = self.charset = None
        self.position, self.continued, self.encoded = 0, False, False
        self.parts: list[str] = []
        self.attributes: list[dict] = []
        self.later: list[tuple[str, int, str]] = []

    def _store(self, token: bytes) -> None:
        """End a value: the parts read so far and ``token``."""
        if self.name is None or not token and not self.parts:
            return
        text = "".join(self.parts) + utf8(token)
        self.parts = []
        name, self.name = self.name, None
        if self.continued:
            if self.encoded:
                fine, raw_ = percent_decode(text.encode())
                text = decode(raw_, self.charset.encode() if self.charset else None) if fine else text
            if self.position:
                self.later.append((name, self.position, text))
            else:
                self.attributes.append({"name": name, "value": text})
            self.position, self.continued, self.encoded, self.charset = 0, False, False, None
        else:
            self.attributes.append({"name": name, "value": text})

    def _keyword(self, state: str, token: bytes) -> bool:
        if token:
            setattr(self, state, _lower(token))
        return bool(token)

    def _number(self, token: bytes) -> bool:
        if token:
            self.position = int(token) if re.fullmatch(rb"\+?[0-9]+", token) and int(token) < 1 << 32 else 0
        return bool(token)

    def _language(self, token: bytes) -> None:
        if not token:
            return
        if self.charset is None:
            self.charset = utf8(token)
            return
        name = (self.name or "unknown") + "-language"
        if any(a["name"] == name for a in self.attributes):
            self.parts += ["'", utf8(token)]
        else:
            self.attributes.append({"name": name, "value": utf8(token)})

    def result(self) -> Value:
        v, at, start, state, back = self.value, 0, 0, "type", []
        literal = False
        while True:
            m = self.PLAIN[state].search(v, at + literal)
            if m is None:
                break
            stop, what, quoted = m.start(), m[0], state == "quoted"
            token = v[start:stop]
            if quoted:
                token = re.sub(rb"[\r\n]", b"", token) if b"\n" in token else token.strip(b"\r")
            else:
                token = token.strip(b" \t\r")
            literal, at = False, m.end()
            if what == b"=?":
                before = v[start:stop].rstrip(b"\r")
                fresh = not before or before[-1:] in b" \t"
                word = encoded_word(v, stop) if fresh else None
                if word is None:
                    at = stop + 1
                    continue
                if token:
                    self.parts.append(utf8(token) + ("" if quoted else " "))
                self.parts.append(word[0])
                start = at = word[1]
            elif what == b"\n":
                if quoted and at < len(v):
                    at += 1  # a fold inside quotes is part of the value
                    continue
                if state in ("type", "subtype", "name"):
                    self._keyword(state, token)
                elif state != "comment":
                    self._store(token)
                if at >= len(v):
                    break
                if state != "type":
                    state = "name"
                start = at = at + 1
            elif state == "comment":
                if what == b"\\":
                    literal = True
                    at = stop + 1
                    continue
                if what == b"(":
                    back.append("comment")
                else:
                    state = back.pop()
                start = at
            elif what == b"(":
                if state == "value":
                    self._store(token)
                else:
                    self._keyword(state, token)
                back.append(state)
                state, start = "comment", at
            elif what == b"\\":
                if state in ("value", "quoted"):
                    if token or quoted and v[start:stop]:
                        self.parts.append(utf8(token if not quoted else v[start:stop].strip(b"\r")) + ("" if quoted else " "))
                    start, literal = at, v[at : at + 1] != b"\n"
            elif what == b'"':
                if state == "value":
                    state, start = "quoted", at if not token else start
                elif quoted:
                    self._store(token)
                    state, start = "name", at
            elif what == b"'":
                if self.encoded:
                    self._language(token)
                    start = at
            elif what == b"/":
                self._keyword("type", token)
                state, start = "subtype", at
            elif what == b";":
                if state == "value":
                    self._store(token)
                else:
                    self._keyword(state, token)
                state, start = "name", at
            elif what == b"*":
                if not self.continued:
                    self.continued = self._keyword("name", token)
                    start = at
                elif not self.encoded:
                    self._number(token)
                    self.encoded, start = True, at
                else:
                    start = at
            elif what == b"=":
                if not self.continued:
                    start = at
                    if not self._keyword("name", token):
                        continue
                elif not self.encoded:
                    self.encoded = not self._number(token)
                state, start = "value", at
        for name, _, text in sorted(self.later):
            old = next((a for a in self.attributes if a["name"] == name), None)
            if old:
                old["value"] += text
            else:
                self.attributes.append({"name": name, "value": text})
        if self.type is None:
            return EMPTY
        return "ContentType", {"c_type": self.type, "c_subtype": self.subtype, "attributes": self.attributes or None}
