"""Dates of RFC 5322 and RFC 3339, read leniently by position."""

from __future__ import annotations

import re
from collections.abc import Iterator

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Obsolete zone names in hours; any other name is taken as UTC.
ZONES = {b"EDT": -4, b"EST": -5, b"CDT": -5, b"CST": -6, b"MDT": -6, b"MST": -7, b"PDT": -7, b"PST": -8}
FIELDS = ("year", "month", "day", "hour", "minute", "second", "tz_before_gmt", "tz_hour", "tz_minute")
#: Digits of day, month, year, hour, minute, second and zone, in the order of RFC 5322.
WIDTHS = (2, 2, 4, 2, 2, 2, 4)
CLOCK, ZONE = (3, 4), 6
_LEXEME = re.compile(rb"\n[ \t]?|[0-9]+|[A-Za-z]|[ \t]|[^\n0-9A-Za-z \t]")
_LETTERS = {m[1:]: i + 1 for i, m in enumerate(MONTHS)}


def make(year: int, month: int, day: int, hour: int, minute: int, second: int, before: bool, tz_hour: int, tz_minute: int) -> dict:
    return dict(zip(FIELDS, (year & 0xFFFF, month & 0xFF, day & 0xFF, hour & 0xFF, minute & 0xFF, second & 0xFF, before, tz_hour & 0xFF, tz_minute & 0xFF), strict=True))


class _Lexemes:
    """Lexemes of one field. A fold counts as a blank, a comment as its opening bracket."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def _raw(self) -> Iterator[bytes]:
        while m := _LEXEME.match(self.data, self.at):
            self.at = m.end()
            if m[0] == b"\n":
                return
            yield m[0]

    def __iter__(self) -> Iterator[bytes]:
        raw = self._raw()
        for x in raw:
            yield b" " if x[:1] == b"\n" else x
            if x == b"(":
                self._comment(raw)

    def _comment(self, raw: Iterator[bytes]) -> None:
        depth = 1
        for x in raw:
            if x == b"\\" and self.data[self.at : self.at + 1] == b")":
                self.at += 1
            depth += (x == b"(") - (x == b")")
            if not depth:
                return

    def take(self, n: int) -> bytes:
        """The next bytes as they are, a newline among them."""
        lo, self.at = self.at, min(len(self.data), self.at + n)
        return self.data[lo : self.at]


def _cells(lex: _Lexemes) -> tuple[list[bytes], bytes, int | None]:
    """Numbers in the order of WIDTHS, letters at the month's place, and the zone as signed hours * 100 + minutes, None for "-0"."""
    cells, month, sign, named = [b""], b"", 1, None
    text = digits = False  # since the last break; at all
    for x in lex:
        place = len(cells) - 1
        if x == b";":
            cells, month, sign, named, text, digits = [b""], b"", 1, None, False, False
        elif x == b"(":
            text = False
        elif x in b"+-":
            sign = -1 if x == b"-" or sign < 0 else 1
            if place < ZONE:
                cells[place:] = [cells[place] and cells[place].ljust(WIDTHS[place], b"0"), *[b""] * (ZONE - place)]
            elif place > ZONE:
                cells[ZONE + 1 :] = []
                cells[ZONE] = cells[ZONE].rjust(4, b"0")  # full: takes no more digits
        elif x in b" \t" or x == b":" and place in CLOCK:
            if text and digits:
                cells.append(b"")
                text = False
        elif x.isdigit():
            if place <= ZONE and (more := x[: WIDTHS[place] - len(cells[place])]):
                cells[place] += more
                digits = True
            text = True
        elif x.isalpha():
            text = True
            if place == 1:
                month += x
            elif place == ZONE:
                named = 100 * ZONES.get(x + lex.take(2), 0)
                sign = -1 if named < 0 else 1
                cells.append(b"")
                text = False
    if cells[-1] and len(cells) <= len(WIDTHS):
        cells[-1] = cells[-1].ljust(WIDTHS[len(cells) - 1], b"0")
    zone = sign * (abs(named) if named is not None else int(cells[ZONE] or 0) if len(cells) > ZONE else 0)
    return cells, month, zone if zone or sign > 0 else None


_USUAL = re.compile(rb"[ \t]*(?:[A-Za-z]{3},[ \t]*)?([0-9]{1,2})[ \t]+[A-Za-z]([A-Za-z]{2})[ \t]+([0-9]{4})[ \t]+([0-9]{2}):([0-9]{2}):([0-9]{2})[ \t]+([+-])([0-9]{2})([0-9]{2})(?:[ \t]+\([^()\\\r\n]*\))?[ \t]*\r?\n(?![ \t])")


def _usual(m: re.Match) -> dict | None:
    """A date as the standard writes it."""
    day, month, year, hour, minute, second, sign, tz_hour, tz_minute = m.groups()
    number = _LETTERS.get(month.decode().lower())
    year = int(year)
    year += 2000 if year < 50 else 1900 if year < 100 else 0
    return number and make(year, number, int(day), int(hour), int(minute), int(second), sign == b"-", int(tz_hour) % 24, int(tz_minute) % 60)


def parse_date(data: bytes, at: int = 0) -> tuple[dict | None, int]:
    """The date in a field that starts at ``at``, and where the field ends.

    A zone letter takes the two bytes after it along, a newline among them: "Z" or "UT" at the end of
    a line pulls in the next line. A semicolon starts over. Comments nest and hide anything.
    """
    if m := _USUAL.match(data, at):
        return _usual(m), m.end()
    lex = _Lexemes(data, at)
    cells, name, zone = _cells(lex)
    if len(cells) <= ZONE:
        return None, lex.at
    day, number, year, hour, minute, second = (int(c or 0) for c in cells[:ZONE])
    month = _LETTERS.get(name[1:].decode().lower(), 0) if len(name) == 3 else number
    if not 1 <= month <= 12:
        return None, lex.at
    year += 2000 if year < 50 else 1900 if year < 100 else 0
    return make(year, month, day, hour, minute, second, zone is None or zone < 0, abs(zone or 0) // 100 % 24, abs(zone or 0) % 100 % 60), lex.at


def parse_rfc822(text: str) -> dict | None:
    return parse_date(text.encode())[0]


_RFC3339 = re.compile(r"(\d{0,4})-(\d{0,2})-(\d{0,2})T(\d{0,2}):(\d{0,2}):(\d{0,2})(?:(\.)\d*)?(?:([+-])(\d{0,2})(?::(\d{0,2}))?)?\Z", re.A)


def parse_rfc3339(text: str) -> dict | None:
    """Date and time with an optional zone; a fraction is skipped, characters without a meaning are ignored."""
    m = _RFC3339.match(re.sub(r"[^0-9\-T:+.]", "", text))
    if m is None:
        return None
    n = [int(m[i].ljust(w, "0")) if m[i] else 0 for i, w in ((1, 4), (2, 2), (3, 2), (4, 2), (5, 2), (6, 2), (9, 2), (10, 2))]
    return make(*n[:6], m[8] == "-", n[6], n[7])


def local_seconds(d: dict) -> int:
    """Seconds since 1970 of the wall clock, without range checks; months before March belong to the year before."""
    year, month = (d["year"], d["month"] - 3) if d["month"] > 2 else (d["year"] - 1, d["month"] + 9)
    days = 365 * year + year // 4 - year // 100 + year // 400 + (153 * month + 2) // 5 + d["day"] - 1 - 719468
    return ((days * 24 + d["hour"]) * 60 + d["minute"]) * 60 + d["second"]


def timestamp(d: dict) -> int:
    """Seconds since 1970 in UTC."""
    zone = d["tz_hour"] * 3600 + d["tz_minute"] * 60
    return local_seconds(d) + (zone if d["tz_before_gmt"] else -zone)


def is_valid(d: dict) -> bool:
    return 1900 <= d["year"] <= 3000 and 1 <= d["month"] <= 12 and 1 <= d["day"] <= 31 and d["hour"] < 24 and d["minute"] < 60 and d["second"] < 60 and d["tz_hour"] < 24 and d["tz_minute"] < 60
