"""Base subjects of threads.

A subject is a row of marks and a base: ``Re:``, ``Fwd:``, ``rv[2]:``, list names in brackets, or the whole
subject in brackets as ``[fwd: ...]``. Marks are peeled off the front, one match of the grammar each.
"""

from __future__ import annotations

import re

#: Reply and forward prefixes.
REPLY = frozenset("re res sv antw ref aw απ השב vá r rif bls odp ynt atb رد 回复 转发".split())
FORWARD = frozenset(["fwd", "fw", "rv", "enc", "vs", "doorst", "vl", "tr", "wg", "πρθ", "הועבר", "továbbítás", "i", "fs", "trs", "vb", "pd", "i̇lt", "yml", "إعادة توجيه", "回覆", "轉寄"])
LONGEST_PREFIX = 21
#: A mark: maybe a word with more text behind it, then the colon that ends it or the bracket that follows it.
_MARK = re.compile(r"\s*(?P<label>(?P<word>[^\[:\s]*)[^\[:]*)(?P<end>[\[:])")
_BRACKETED = re.compile(r"([^\[\]]*)\]")
_TAIL = re.compile(r"\(([^()]{2,})\)\Z", re.S)


def trim_trailing_fwd(text: str) -> str:
    """Without white space around it and without "(fwd)" at its end, however often."""
    text = text.rstrip()
    while (m := _TAIL.search(text)) and m[1].lower() in FORWARD:
        text = text[: m.start()].rstrip()
    return text.lstrip()


def _is_prefix(mark: re.Match) -> bool:
    return mark["word"].lower() in REPLY | FORWARD and len(mark["label"].rstrip()[:-1].encode()) <= LONGEST_PREFIX


def _forwarded(content: str) -> str | None:
    """The subject within ``[fwd: re: ...]``; None of other brackets."""
    *labels, rest = content.split(":")
    forward, taken = False, 0
    for label in labels:
        word = next(iter(label.split()), "").lower()
        forward = forward or word in FORWARD
        if not forward or word not in REPLY | FORWARD:
            taken += not word
            break
        taken += 1
    rest = content.split(":", taken)[-1]
    return rest.lstrip() if forward and rest.strip() else None


def thread_name(text: str) -> str:
    """The subject without reply and forward prefixes, list names in brackets and "(fwd)" at its end."""
    base, listed, inner = text, None, None  # behind the last prefix; behind list names since then; from [fwd: ...]
    at, numbered = 0, False
    while mark := _MARK.match(text, at):
        if mark["word"] and not _is_prefix(mark) or mark["end"] == ":" and numbered == bool(mark["word"]):
            break
        at = mark.end()
        if mark["end"] == ":":
            base, listed, inner, numbered = text[at:], None, None, False
            continue
        numbered = numbered or bool(mark["word"])
        brackets = _BRACKETED.match(text, at)
        if not brackets:
            break
        at = brackets.end()
        inner = _forwarded(brackets[1]) or inner
        listed = listed if numbered else text[at:]
    names = (trim_trailing_fwd(x) for x in (listed, inner, base) if x is not None)
    return next((n for n in names if n), "")
