"""HTML to text and back, previews."""

from __future__ import annotations

import re
from html.entities import html5

_TEXT = re.compile(r"<|[ \t\r\n]+|[^< \t\r\n][^<&; \t\r\n]*;?")
_TAG = re.compile(r"[^<>]*")
_COMMENT = re.compile(r"[ \t\r\n/]*!(?=--)")
_COMMENT_END = re.compile(r"(?<!-)-->")
_BLANK = re.compile(r"[ \t\r\n]+")
HIDDEN = ("head", "style", "script", "template")
_NUMBER = re.compile(r"\+?[0-9]+\Z", re.A)
_HEX = re.compile(r"\+?[0-9A-Fa-f]+\Z")


def entity(token: str) -> str:
    """The character of ``&name;`` or ``&#n;``; anything else as it is. Of two characters the first counts."""
    if len(token) < 3 or token[0] != "&" or token[-1] != ";":
        return token
    name = token[1:-1]
    if name[0] != "#":
        return html5[name + ";"][0] if name + ";" in html5 else token
    digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
    if not (_HEX if base == 16 else _NUMBER).match(digits):
        return token
    code = int(digits, base)
    if code > 0xFFFFFFFF:
        return token
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"


def html_to_text(html: str) -> str:
    """Text of HTML: tags and comments dropped, white space collapsed, ``<br>`` and ``</p>`` as newlines.

    Tags count only without attributes, also within hidden elements; a word that a tag follows keeps the
    state of the line start before it.
    """
    out: list[str] = []
    hidden: set[str] = set()
    at, spaced, fresh = 0, False, True
    while m := _TEXT.match(html, at):
        token, at = m[0], m.end()
        if token[0] in " \t\r\n":
            spaced = spaced or not hidden
        elif token != "<":
            if hidden:
                continue
            before_tag = html[at : at + 1] == "<" and not (token[-1] == ";" and len(token) > 1)
            if spaced and (before_tag or not fresh):
                out.append(" ")
            out.append(entity(token) if token[-1] == ";" else token)
            spaced, fresh = False, fresh and before_tag
        elif c := _COMMENT.match(html, at):
            end = _COMMENT_END.search(html, c.end())
            if end is None:
                break
            at = end.end()
        else:
            tag = _TAG.match(html, at)
            at = tag.end()
            if at >= len(html):
                break
            if html[at] == "<":
                continue  # a tag begins within the tag
            at += 1
            names = [x for x in (t.strip("/") for t in _BLANK.split(tag[0])) if x]
            if len(names) == 1:
                name, closing = names[0].lower(), tag[0].lstrip(" \t\r\n").startswith("/")
                if name == "br" or name == "p" and closing:
                    out.append("\n")
                    spaced, fresh = False, True
                elif name in HIDDEN:
                    (hidden.discard if closing else hidden.add)(name)
    return "".join(out)


def text_to_html(text: str) -> str:
    return "<html><body>" + text.replace("\r", "").replace("<", "&lt;").replace("\n", "<br/>") + "</body></html>"


def _room(limit: int) -> tuple[int, str]:
    return (limit - 3, "...") if limit > 6 else (limit, "")


def preview_text(text: str, limit: int) -> str:
    """At most ``limit`` bytes of UTF-8, cut between characters; the last three are dots if there is room."""
    raw = text.encode()
    if len(raw) <= limit:
        return text
    room, dots = _room(limit)
    return raw[:room].decode("utf-8", "ignore") + dots


def preview_html(html: str, limit: int) -> str:
    return preview_text(html_to_text(html), limit)


def truncate_html(html: str, limit: int) -> str:
    """As ``preview_text`` but never within a tag: the cut moves back to where the last tag ended or this one began."""
    raw = html.encode()
    if len(raw) <= limit:
        return html
    room, dots = _room(limit)
    cut = len(raw[:room].decode("utf-8", "ignore"))
    edge, tag, comment, hit = 0, False, False, False
    for m in re.finditer("[<>]", html[: cut + 1]):
        at, mark = m.start(), -1
        if m[0] == "<" and not tag:
            tag, comment, mark = True, html.startswith("!--", at + 1), at
        elif m[0] == ">" and tag and (not comment or html[at - 2 : at] == "--"):
            tag, comment, mark = False, False, at + 1
        if at < cut:
            edge = mark if mark > 0 else edge
        else:
            hit = mark > 0
    return html[: edge if (tag or hit) and edge > 0 else cut] + dots
