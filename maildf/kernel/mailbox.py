"""Mbox splitting and Maildir names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from . import dates

MBOX_FLAGS = {"P": "Passed", "R": "Replied", "S": "Seen", "T": "Trashed", "D": "Draft", "F": "Flagged"}
_QUOTED = re.compile(rb">+From ")
_NUMBER = re.compile(r"\+?[0-9]+\Z", re.A)


def _number(text: str, top: int) -> int:
    n = int(text) if _NUMBER.match(text) else top
    return min(n, top) if n <= top else top


def envelope(line: bytes) -> tuple[int, str]:
    """Seconds since 1970 and sender of a From_ line; 0 where the date is not valid."""
    try:
        sender, found, rest = line.decode()[5:].partition(" ")
    except UnicodeDecodeError:
        return 0, ""
    if not found:
        return 0, ""
    words = [*rest.split(), "", "", "", "", ""][:5]
    clock = [*words[3].split(":"), "", "", ""][:3]
    month = {m: i + 1 for i, m in enumerate(dates.MONTHS)}.get(words[1].lower(), 255)
    d = dates.make(_number(words[4], 65535), month, _number(words[2], 255), *(_number(x, 255) for x in clock), False, 0, 0)
    return dates.timestamp(d) if dates.is_valid(d) else 0, sender.strip()


def unquote(line: bytes) -> bytes:
    """A body line without one of the marks before a quoted From_."""
    return line[1:] if _QUOTED.match(line) else line


def split_lines(lines: Iterable[bytes]) -> Iterator[tuple[int, str, bytes]]:
    """(date, sender, contents) of each message; lines before the first From_ line are dropped."""
    head, body = None, []
    for line in lines:
        if line.startswith(b"From "):
            if head is not None:
                yield *envelope(head), b"".join(body)
            head, body = line, []
        elif head is not None:
            body.append(unquote(line))
    if head is not None:
        yield *envelope(head), b"".join(body)


def split_mbox(data) -> Iterator[tuple[int, str, bytes]]:
    """Messages of a whole mbox in any buffer; one message at a time is copied."""
    data = memoryview(data)
    starts = [m.start() for m in re.finditer(rb"^From ", data, re.M)]
    for a, b in zip(starts, [*starts, len(data)][1:], strict=True):
        head, found, body = bytes(data[a:b]).partition(b"\n")
        yield *envelope(head + found), re.sub(rb"^>(>*From )", rb"\1", body, flags=re.M) if b">" in body else body


def maildir_flags(name: str) -> list[str]:
    """Flags behind the last "2," of a file name."""
    _, found, tail = name.rpartition("2,")
    return [MBOX_FLAGS[c] for c in re.match("[A-Za-z0-9]*", tail)[0] if c in MBOX_FLAGS] if found else []
