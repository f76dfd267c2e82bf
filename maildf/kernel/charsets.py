"""Charset labels and their decoders."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable

from .decoders import base64_groups

Decoder = Callable[[bytes], str]

#: Labels that follow no rule, by codec ("-" is written "_", case does not matter).
NAMED = {
    "cp850": "850 cp850 ibm850 cspc850multilingual",
    "cp866": "866 cp866 ibm866 csibm866",
    "cp1252": "ansi_x3.4_1968 ascii us_ascii cp819 ibm819 iso88591 iso8859_1 iso_8859_1 iso_8859_1:1987 iso_ir_100 l1 latin1 csisolatin1",
    "iso8859_2": "iso_8859_2:1987 iso_ir_101",
    "iso8859_3": "iso_8859_3:1988 iso_ir_109",
    "iso8859_4": "iso_8859_4:1988 iso_ir_110",
    "iso8859_5": "cyrillic csisolatincyrillic iso_8859_5:1988 iso_ir_144",
    "iso8859_6": "arabic asmo_708 ecma_114 csiso88596e csiso88596i csisolatinarabic iso_8859_6:1987 iso_8859_6_e iso_8859_6_i iso_ir_127",
    "iso8859_7": "greek greek8 ecma_118 elot_928 sun_eu_greek csisolatingreek iso_8859_7:1987 iso_ir_126",
    "iso8859_8": "hebrew logical visual csiso88598e csiso88598i csisolatinhebrew iso_8859_8:1988 iso_8859_8_e iso_8859_8_i iso_ir_138",
    "iso8859_9": "iso_8859_9:1989 iso_ir_148",
    "iso8859_10": "iso_8859_10:1992 iso_ir_157",
    "iso8859_13": "csiso885913",
    "iso8859_14": "csiso885914 iso_8859_14:1998 iso_celtic iso_ir_199 l8 latin8",
    "iso8859_15": "csiso885915 csisolatin9 l9 latin_9",
    "iso8859_16": "csiso885916 iso_8859_16 iso_8859_16:2001 iso_ir_226 l10 latin10",
    "koi8_r": "koi koi8 koi8_r cskoi8r",
    "koi8_u": "koi8_ru koi8_u cskoi8u",
    "mac_roman": "mac macintosh csmacintosh x_mac_roman",
    "mac_cyrillic": "x_mac_cyrillic x_mac_ukrainian",
    "tis_620": "tis_620 cstis620 iso885911 iso8859_11 iso_8859_11",
    "cp874": "dos_874 windows_874 cswindows874",
    "big5hkscs": "big5 big5_hkscs cn_big5 csbig5 x_x_big5",
    "gbk": "chinese cp936 csgb2312 csgbk csiso58gb231280 gb_2312 gb_2312_80 gbk iso_ir_58 ms936 windows_936 x_gbk",
    "gb18030": "gb18030 gb2312 csgb18030",
    "cp949": "cseuckr csksc56011987 euc_kr iso_ir_149 korean ks_c_5601_1987 ks_c_5601_1989 ksc5601 ksc_5601 windows_949",
    "euc_jp": "cseucpkdfmtjapanese euc_jp extended_unix_code_packed_format_for_japanese x_euc_jp",
    "cp932": "csshiftjis ms932 ms_kanji shift_jis sjis windows_31j x_sjis",
    "iso2022_jp": "csiso2022jp iso_2022_jp",
    "utf_16": "csunicode csutf16 iso_10646_ucs_2 ucs_2 unicode unicodefeff utf_16",
    "utf_16_be": "csutf16be unicodefffe utf_16be",
    "utf_16_le": "csutf16le utf_16le",
    "utf_7": "csutf7 utf_7",
    "x_user_defined": "x_user_defined",
    "replacement": "csiso2022kr hz_gb_2312 iso_2022_cn iso_2022_cn_ext iso_2022_kr replacement",
}
#: Characters in which a table differs from the codec of its name.
OVERRIDES = {
    "iso8859_7": {0xA4: "�", 0xA5: "�", 0xAA: "�"},
    "iso8859_16": {0xA5: "«", 0xAB: "„"},
    "mac_roman": {0xC6: "Δ", 0xCD: "Ω", 0xDB: "¤", 0xF0: "", 0xF6: "�", 0xF7: "�"},
    "tis_620": dict.fromkeys(range(0x80, 0xA0), "�"),
}


def _labels() -> dict[str, str]:
    table = {label: codec for codec, labels in NAMED.items() for label in labels.split()}
    for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15):  # the parts of ISO 8859 in three spellings
        table |= dict.fromkeys((f"iso8859{n}", f"iso8859_{n}", f"iso_8859_{n}"), f"iso8859_{n}")
    for latin, n in ((2, 2), (3, 3), (4, 4), (5, 9), (6, 10)):  # "Latin" numbers of parts
        table |= dict.fromkeys((f"l{latin}", f"latin{latin}", f"csisolatin{latin}"), f"iso8859_{n}")
    for n in range(1250, 1259):
        table |= dict.fromkeys((f"cp{n}", f"x_cp{n}", f"windows_{n}", f"cswindows{n}"), f"cp{n}")
    return table


LABELS = _labels()
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ-", b"abcdefghijklmnopqrstuvwxyz_")
_DECODERS: dict[str, Decoder] = {}


def utf8(data: bytes) -> str:
    """UTF-8 in which each malformed sequence becomes U+FFFD."""
    return data.decode("utf-8", "replace")


def utf16(data: bytes, order: str = "") -> str:
    """UTF-16, little-endian without a byte order mark; an odd last byte is dropped, a lone surrogate is U+FFFD."""
    if not order:
        order = "be" if data[:2] == codecs.BOM_UTF16_BE else "le"
        data = data[2:] if data[:2] in (codecs.BOM_UTF16_BE, codecs.BOM_UTF16_LE) else data
    units = data[: len(data) // 2 * 2].decode(f"utf-16-{order}", "surrogatepass")
    return re.sub("[\ud800-\udfff]", "�", units)


def utf7(data: bytes) -> str:
    """A lenient UTF-7: a shifted run ends at any byte outside the alphabet, which is swallowed; an unended run is dropped.

    A run too short for one character is U+FFFD; an empty run gives a plus sign and the byte after.
    """

    def run(m: re.Match) -> str:
        if m[2] is None:
            return ""
        if not m[1]:
            return "+" + m[2].decode("latin-1")
        full = base64_groups(m[1], closed=True)
        return utf16(full, "be") if len(full) > 1 else "�"

    out, at = [], 0
    for m in re.finditer(rb"\+([A-Za-z0-9+/]*)([^A-Za-z0-9+/])?", data, re.S):
        out += [data[at : m.start()].decode("latin-1"), run(m)]
        at = m.end()
    return "".join([*out, data[at:].decode("latin-1")])


def _single(codec: str) -> Decoder:
    table = [bytes([b]).decode(codec, "replace") for b in range(256)]
    for b, c in OVERRIDES.get(codec, {}).items():
        table[b] = c
    joined = "".join(table)
    return lambda data: codecs.charmap_decode(data, "replace", joined)[0]


def _make(codec: str) -> Decoder:
    if codec == "utf_7":
        return utf7
    if codec.startswith("utf_16"):
        return lambda data: utf16(data, codec[7:])
    if codec == "replacement":
        return lambda data: "�" if data else ""
    if codec == "x_user_defined":
        return lambda data: "".join(chr(b if b < 128 else 0xF700 + b) for b in data)
    if codec in ("big5hkscs", "gbk", "gb18030", "cp949", "euc_jp", "cp932", "iso2022_jp"):
        return lambda data: data.decode(codec, "replace")
    return _single(codec)


def decoder(label: bytes) -> Decoder | None:
    """The decoder of a label, whatever its case and dashes; None if unknown (UTF-8 has no entry)."""
    codec = LABELS.get(label[:45].translate(_FOLD).decode("latin-1"))
    if codec is None:
        return None
    if codec not in _DECODERS:
        _DECODERS[codec] = _make(codec)
    return _DECODERS[codec]


def decode(data: bytes, label: bytes | None) -> str:
    found = decoder(label) if label else None
    return found(data) if found else utf8(data)
