"""Queries over the finer points of mail: damaged messages, charsets, presets, parts, stored mail."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as M
from ..operators import attachments, from_json, to_json, write_attachments
from ..parse import EmailParser
from ..sources import read_eml, read_files, read_maildir, read_mbox
from .queries import PARSER, document_mail, query, rendered, table

#: A charset's label, bytes in it and the text they stand for.
CHARSETS = [
    ("ISO-8859-2", "b1e6ea", "ąćę"),
    ("latin3", "a6b6bc", "Ĥĥĵ"),
    ("l4", "b1bee7", "ąžį"),
    ("iso_8859-5", "d0d1d2", "абв"),
    ("arabic", "c7c8ca", "ابت"),
    ("greek", "e1e2e3", "αβγ"),
    ("hebrew", "e0e1e2", "אבג"),
    ("latin5", "d0dde0", "Ğİà"),
    ("latin6", "a1aad7", "ĄŠŨ"),
    ("iso-8859-13", "e0fee2", "ąžā"),
    ("iso-8859-14", "a1a2a4", "ḂḃĊ"),
    ("latin-9", "a4a6a8", "€Šš"),
    ("l10", "a1a2a4", "Ąą€"),
    ("windows-1250", "8c9cb9", "Śśą"),
    ("cp1251", "c0c1ff", "АБя"),
    ("us-ascii", "8093e9", "€“é"),
    ("windows-1253", "e1dcf3", "αάσ"),
    ("x-cp1254", "d0f0fe", "Ğğş"),
    ("cp1255", "e0f9c0", "אשְ"),
    ("windows-1256", "c7e1", "ال"),
    ("windows-1257", "e0fec0", "ąžĄ"),
    ("cp1258", "d0f0fe", "Đđ₫"),
    ("koi8-r", "c1c2d7", "абв"),
    ("koi8_u", "a4a6b4", "єіЄ"),
    ("macintosh", "8ea5", "é•"),
    ("ibm850", "8285e1", "éàß"),
    ("tis-620", "a1a2b3", "กขณ"),
    ("shift_jis", "93fa967b", "日本"),
    ("big5", "a4a4a4e5", "中文"),
    ("euc-jp", "c6fccbdc", "日本"),
    ("euc-kr", "c7d1b1db", "한글"),
    ("gb18030", "d6d0cec4", "中文"),
    ("gbk", "d6d0cec4", "中文"),
    ("iso-2022-jp", "1b2442467c4b5c1b2842", "日本"),
    ("windows-874", "a1a2b3", "กขณ"),
    ("ibm866", "80a0e0", "Аар"),
    ("x-mac-cyrillic", "80e0df", "Аая"),
    ("x-user-defined", "80c0ff", ""),
    ("utf-7", "2b414f6b2d21", "é!"),
    ("unknown-8bit", "c3a9ff", "é�"),
]
_CASES = " ".join(f"WHEN {i} THEN p_name || '{t}'" for i, (_, _, t) in enumerate(CHARSETS))


@query(f"SELECT p_partkey, CASE p_partkey % {len(CHARSETS)} {_CASES} END AS text, p_partkey % {len(CHARSETS)} <> {len(CHARSETS) - 1} AS known FROM part")
def charset_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name in every charset that is a superset of ASCII, with letters of its own behind it."""
    i = F.col("p_partkey") % len(CHARSETS)
    label, tail = (F.get(F.array(*[F.lit(c[k]) for c in CHARSETS]), i.cast("int")) for k in (0, 1))
    p = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), F.concat(F.encode("p_name", "UTF-8"), F.unhex(tail)).alias("raw"))
    return p.select("p_partkey", M.charset_decode("raw", F.col("label")).alias("text"), M.charset_is_known(F.col("label")).alias("known"))


@query("""
SELECT p_partkey, chr(p_size + 64) AS decimal, chr(p_size + 912) AS hexadecimal,
       CASE p_partkey % 5 WHEN 0 THEN 'é' WHEN 1 THEN '≂' WHEN 2 THEN '&bogus;' WHEN 3 THEN '&' ELSE '�' END AS named,
       CASE WHEN strlen(p_name || ' & ' || p_type || chr(10)) <= 20 THEN p_name || ' & ' || p_type || chr(10) ELSE left(p_name || ' & ' || p_type, 17) || '...' END AS preview,
       'ab...' AS in_tag, left('<b>' || p_name || p_type || '</b>', 9) || '...' AS in_text
FROM part
""")
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = "CASE p_partkey % 5 WHEN 0 THEN '&eacute;' WHEN 1 THEN '&NotEqualTilde;' WHEN 2 THEN '&bogus;' WHEN 3 THEN '&AMP;' ELSE '&#xD800;' END"
    html = F.expr("concat('<p>', p_name, ' &amp; ', p_type, '</p>')")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        M.html_entity_decode(F.expr("concat('&#', p_size + 64, ';')")).alias("decimal"),
        M.html_entity_decode(F.expr("concat('&#x', lower(hex(p_size + 912)), ';')")).alias("hexadecimal"),
        M.html_entity_decode(F.expr(named)).alias("named"),
        M.preview_html(html, 20).alias("preview"),
        M.truncate_html(F.expr("concat('ab<span class=\"', p_brand, '\">', p_name, '</span>')"), 12).alias("in_tag"),
        M.truncate_html(F.expr("concat('<b>', p_name, p_type, '</b>')"), 12).alias("in_text"),
    )


@query("""
SELECT p_partkey, p_name || ' größe' AS decoded, p_size + 32 AS code, p_size % 2 = 0 AS code_is_null,
       CASE p_partkey % 4 WHEN 0 THEN 'Subject' WHEN 1 THEN 'x-own_1' WHEN 2 THEN NULL ELSE 'MIME-Version' END AS name,
       p_partkey % 4 IN (1, 2) AS other, p_partkey % 2 = 0 AS mime
FROM part
""")
def header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 words that a fold cuts, pairs of hexadecimal digits, names of headers."""
    coded = "base64(encode(concat(p_name, ' größe'), 'UTF-8'))"
    name = "CASE p_partkey % 4 WHEN 0 THEN 'subJECT' WHEN 1 THEN 'x-own_1' WHEN 2 THEN 'no name' ELSE 'MIME-version' END"
    code = M.quoted_printable_char(F.expr("lower(hex(p_size + 32))"))
    wrong = M.quoted_printable_char(F.expr("CASE p_size % 2 WHEN 0 THEN 'g1' ELSE '1f' END"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        M.decode_header(F.expr(f"concat('=?UTF-8*en?B?', left({coded}, 9), '\r\n ', substring({coded}, 10), '?=')")).alias("decoded"),
        code.cast("long").alias("code"),
        wrong.isNull().alias("code_is_null"),
        M.header_name(F.expr(name)).alias("name"),
        M.is_other_header(F.expr(name)).alias("other"),
        M.is_mime_header(F.expr("CASE p_partkey % 2 WHEN 0 THEN 'content-ID' ELSE 'Subject' END")).alias("mime"),
    )


_LISTS = ("Archive", "Help", "Owner", "Post", "Subscribe", "Unsubscribe")


@query(
    """
SELECT o_orderkey, 'ann@example.org' AS resent_from, 'b' || o_orderkey || '@example.org' AS resent_to, 'c@example.org' AS resent_cc, 'd@example.org' AS resent_bcc,
       'e@example.org' AS resent_sender, 883612810::BIGINT AS resent_date, 'r' || o_orderkey || '@x' AS resent_id, 'Orders' AS list_name, 'orders.example.org' AS list_id, """
    + ", ".join(f"'{n.lower()}' || o_orderkey || '@example.org' AS list_{n.lower()}" for n in _LISTS)
    + """,
       'bounce' || o_orderkey || '@example.net' AS return_address, 16::BIGINT AS n_headers, 'Return-Path,X-Raw,Resent-To' AS after_removal,
       'a  ' || chr(13) || chr(10) || ' b ' || o_orderkey AS raw FROM orders
"""
)
def resent_and_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of resent mail and of mailing lists, a raw header with its folds, a header taken out."""
    lists = [f"concat('List-{n}: <mailto:', '{n.lower()}', o_orderkey, '@example.org>')" for n in _LISTS]
    o = rendered(
        table(spark, sf_dir, "orders"),
        ["o_orderkey"],
        "concat('Return-Path: <bounce', o_orderkey, '@example.net>')",
        "'Resent-From: Ann <ann@example.org>'",
        "concat('Resent-To: b', o_orderkey, '@example.org')",
        "'Resent-Cc: c@example.org'",
        "'Resent-Bcc: d@example.org'",
        "'Resent-Sender: e@example.org'",
        "'Resent-Date: Thu, 1 Jan 1998 00:00:10 +0000'",
        "concat('Resent-Message-ID: <r', o_orderkey, '@x>')",
        "'List-ID: Orders <orders.example.org>'",
        *lists,
        "concat('X-Raw:  a  \r\n b ', o_orderkey, ' ')",
        "''",
        "''",
    )
    m = PARSER.parse(o, headers_only=True)
    one = lambda a: M.first_address(a)["address"]
    listed = {"archive": M.list_archive, "help": M.list_help, "owner": M.list_owner, "post": M.list_post, "subscribe": M.list_subscribe, "unsubscribe": M.list_unsubscribe}
    mailto = lambda get: F.replace(one(M.as_address(get("message"))), F.lit("mailto:"), F.lit(""))
    left = F.slice(F.transform(M.remove_header("message", "Resent-From"), lambda h: h["name"]), 1, 3)
    return m.select(
        "o_orderkey",
        *(one(get("message")).alias(n) for n, get in (("resent_from", M.resent_from), ("resent_to", M.resent_to), ("resent_cc", M.resent_cc), ("resent_bcc", M.resent_bcc), ("resent_sender", M.resent_sender))),
        M.to_timestamp(M.resent_date("message")).alias("resent_date"),
        M.resent_message_id("message").alias("resent_id"),
        M.first_address(M.as_address(M.list_id("message")))["name"].alias("list_name"),
        one(M.as_address(M.list_id("message"))).alias("list_id"),
        *(mailto(get).alias(f"list_{n}") for n, get in listed.items()),
        M.return_address("message").alias("return_address"),
        F.size(M.headers("message")).cast("long").alias("n_headers"),
        F.array_join(left, ",").alias("after_removal"),
        M.as_text(M.header("message", "X-Raw")).alias("raw"),
    )


def _kinds(spark: SparkSession, sf_dir: str, parsers: dict[str, EmailParser]) -> DataFrame:
    """Kinds of the same message's headers under several parsers."""
    out = None
    for name, parser in parsers.items():
        o = rendered(
            table(spark, sf_dir, "orders"),
            ["o_orderkey"],
            "concat('Subject: Order ', o_orderkey)",
            "'Date: Thu, 1 Jan 1998 00:00:10 +0000'",
            "'From: a@example.org'",
            "'Message-ID: <m@example.org>'",
            "'Content-Type: text/plain'",
            "'List-ID: <l.example.org>'",
            "'X-Other: value, other'",
            "''",
            "''",
        )
        m = parser.parse(o, headers_only=True).select("o_orderkey", F.lit(name).alias("parser"), F.array_join(F.transform(M.headers("message"), lambda h: h["value"]["kind"]), ",").alias("kinds"))
        out = m if out is None else out.unionByName(m)
    return out


@query("""
SELECT o_orderkey, parser, kinds FROM orders, (VALUES
('mime', 'Text,Text,Text,Text,ContentType,Text,Text'),
('groups', 'Empty,DateTime,Address,Text,Empty,Address,Empty'),
('minimal', 'Text,DateTime,Address,Text,ContentType,Text,Text')) AS v(parser, kinds)
""")
def parser_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = EmailParser().with_date_headers().with_address_headers().with_message_ids().default_header_ignore()
    return _kinds(spark, sf_dir, {"mime": EmailParser().with_mime_headers(), "groups": groups, "minimal": EmailParser().with_minimal_headers()})


@query("""
SELECT o_orderkey, parser, kinds FROM orders, (VALUES
('text', 'Text,Empty,Text,Text,Text,Text,TextList'),
('raw', 'Text,Text,Text,Text,Text,Text,Text'),
('ignore', 'Empty,Empty,Empty,Text,Empty,Address,Empty')) AS v(parser, kinds)
""")
def parser_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = EmailParser().header_comma_separated("X-Other").ignore_header("Date").default_header_text()
    raw = EmailParser().header_comma_separated("Message-ID").header_text("Subject").without_header("Subject").default_header_raw()
    ignore = EmailParser().header_id("Message-ID").header_address("List-ID").default_header_ignore()
    return _kinds(spark, sf_dir, {"text": text, "raw": raw, "ignore": ignore})


@query("""
SELECT doc_id, 2::BIGINT AS children, true AS multipart, true AS text, true AS html, true AS bin, '[no contents]' AS shown, '<p>' || doc_id || '</p>' AS shown_html,
       strlen(coalesce(text, ''))::BIGINT AS text_len, 0::BIGINT AS multipart_len, true AS whole, true AS offsets, 'Subject' AS first_name, 8::INTEGER AS first_start,
       CASE WHEN strlen(coalesce(text, '')) <= 50 THEN coalesce(text, '')
            ELSE left(text, list_max(list_filter(range(0, 48), lambda n: strlen(left(text, n)) <= 47))::BIGINT) || '...' END AS preview,
       true AS beyond, 3::INTEGER AS html_id, 4::INTEGER AS attached_id, false AS empty, true AS plain FROM documents
""")
def part_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by position and kind, their lengths and offsets, previews."""
    m = PARSER.parse(document_mail(spark, sf_dir), keep_raw=True)
    p = [M.part("message", i) for i in range(5)]
    first = F.get(M.headers("message"), F.lit(0))
    offsets = (M.raw_header_offset(p[0]) == 0) & (M.raw_end_offset(p[0]) == F.octet_length("raw")) & (M.raw_len(p[0]) == F.octet_length("raw")) & (M.raw_body_offset(p[0]) < M.raw_header_offset(p[1]))
    return m.select(
        "doc_id",
        F.size(M.sub_parts(p[0])).cast("long").alias("children"),
        M.is_multipart(p[1]).alias("multipart"),
        (M.is_text(p[2]) & ~M.is_text_html(p[2])).alias("text"),
        M.is_text_html(p[3]).alias("html"),
        (M.is_binary(p[4]) & ~M.is_message(p[4])).alias("bin"),
        M.display(p[1]).alias("shown"),
        M.display(p[3]).alias("shown_html"),
        M.part_len(p[2]).cast("long").alias("text_len"),
        M.part_len(p[0]).cast("long").alias("multipart_len"),
        (M.raw_message("raw", "message") == F.col("raw")).alias("whole"),
        offsets.alias("offsets"),
        first["name"].alias("first_name"),
        first["offset_start"].alias("first_start"),
        M.body_preview("message", 50).alias("preview"),
        (M.part("message", 9).isNull() & M.text_part("message", 1).isNull() & M.attachment("message", 1).isNull()).alias("beyond"),
        M.html_part("message")["part_id"].alias("html_id"),
        M.attachment("message")["part_id"].alias("attached_id"),
        M.is_empty("message").alias("empty"),
        M.is_content_type(p[2], "TEXT", "Plain").alias("plain"),
    )


_INNER = "'Subject: inner ' || p_partkey || chr(13) || chr(10) || chr(13) || chr(10) || p_name"


@query(f"SELECT p_partkey, true AS is_message, 'inner ' || p_partkey AS subject, {_INNER} AS raw, strlen({_INNER})::BIGINT AS len, p_name AS text FROM part")
def sub_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message in place within a message: its raw bytes, its length, its own parts."""
    inner = "concat('Subject: inner ', p_partkey, '\r\n\r\n', p_name)"
    m = PARSER.parse(rendered(table(spark, sf_dir, "part"), ["p_partkey"], "'Content-Type: multipart/digest; boundary=b'", "''", "'--b'", "'Content-Type: message/rfc822'", "''", inner, "'--b--'", "''"), keep_raw=True)
    part = M.part("message", 1)
    sub = M.sub_message("message", part)
    return m.select("p_partkey", M.is_message(part).alias("is_message"), M.subject(sub).alias("subject"), M.nested_raw("raw", "message", part).cast("string").alias("raw"), M.part_len(part).cast("long").alias("len"), M.text_contents(F.get(sub["parts"], F.lit(0))).alias("text"))


@query("""
SELECT p_partkey, v.n_parts::BIGINT AS n_parts, v.kind, CASE WHEN v.shown THEN p_name || v.tail ELSE v.tail END AS text, v.problem, v.texts::BIGINT AS texts, v.attached::BIGINT AS attached
FROM part JOIN (VALUES
(0, 2, 'text', true, ' *!*', true, 0, 1),
(1, 2, 'text', true, chr(13) || chr(10), true, 0, 1),
(2, 1, 'text', false, '', true, 0, 0),
(3, NULL, NULL, false, NULL, NULL, NULL, NULL),
(4, 2, 'text', true, ' =ZZ', false, 1, 0)) AS v(i, n_parts, kind, shown, tail, problem, texts, attached) ON p_partkey % 5 = v.i
""")
def damaged_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad Base64, a multipart that is never closed, headers alone, no message at all, a bad escape."""
    part = "'Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n'"
    raw = f"""encode(CASE p_partkey % 5
        WHEN 0 THEN concat({part}, 'Content-Type: application/pdf\r\nContent-Transfer-Encoding: base64\r\n\r\n', p_name, ' *!*\r\n--b--\r\n')
        WHEN 1 THEN concat({part}, 'Content-Type: text/plain\r\n\r\n', p_name, '\r\n')
        WHEN 2 THEN concat('Subject: ', p_name, '\r\n')
        WHEN 3 THEN ''
        ELSE concat({part}, 'Content-Transfer-Encoding: quoted-printable\r\n\r\n', p_name, ' =ZZ\r\n--b--\r\n') END, 'UTF-8') AS raw"""
    m = PARSER.parse(table(spark, sf_dir, "part").selectExpr("p_partkey", raw))
    last = F.try_element_at(F.col("message.parts"), F.lit(-1))
    count = lambda c: F.when(F.col("message").isNotNull(), c).cast("long")
    return m.select("p_partkey", count(F.size("message.parts")).alias("n_parts"), last["kind"].alias("kind"), last["text"].alias("text"), last["is_encoding_problem"].alias("problem"), count(M.text_body_count("message")).alias("texts"), count(M.attachment_count("message")).alias("attached"))


@query("""
SELECT n_nationkey, 2::BIGINT AS n, true AS has_first, false AS has_other, 'b@example.org' AS last_address, 2::BIGINT AS n_groups, 'Team' AS made_name, 'N' || n_nationkey || '@x' AS made_address, true AS made_contains
FROM nation
""")
def address_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PARSER.parse(rendered(table(spark, sf_dir, "nation"), ["n_nationkey"], "concat('To: \"', n_name, '\" <A', n_nationkey, '@Example.org>, b@example.org')", "''", "''"), headers_only=True)
    to = M.to("message")
    one = M.addr(F.lit("One"), F.concat(F.lit("N"), F.col("n_nationkey"), F.lit("@x")))
    made = M.to_address(F.array(M.group(F.lit("Team"), F.array(one))))
    return m.select(
        "n_nationkey",
        F.size(M.as_list(to)).cast("long").alias("n"),
        M.address_contains(to, F.concat(F.lit("a"), F.col("n_nationkey"), F.lit("@EXAMPLE.org"))).alias("has_first"),
        M.address_contains(to, "nobody@example.org").alias("has_other"),
        M.last_address(to)["address"].alias("last_address"),
        F.size(M.address_groups(to)).cast("long").alias("n_groups"),
        F.get(M.as_group(made), F.lit(0))["name"].alias("made_name"),
        M.first_address(made)["address"].alias("made_address"),
        M.address_contains(made, F.concat(F.lit("n"), F.col("n_nationkey"), F.lit("@X"))).alias("made_contains"),
    )


@query("""
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS local_seconds, epoch(date_trunc('second', ts))::BIGINT - 19800 AS seconds, true AS earlier, event_id % 2 = 0 AS same FROM events
""")
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock of another zone, and order by instant."""
    e = table(spark, sf_dir, "events").select("event_id", M.from_timestamp(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("here"))
    here = F.col("here")
    there = here.withField("tz_hour", F.lit(5)).withField("tz_minute", F.lit(30))  # the same clock, five and a half hours before
    e = e.select("*", there.alias("there"), M.to_timezone(here, F.when(F.col("event_id") % 2 == 0, 3600).otherwise(-3600)).alias("moved"))
    there, moved = F.col("there"), F.col("moved")
    return e.select(
        "event_id",
        M.to_timestamp_local(there).alias("local_seconds"),
        M.to_timestamp(there).alias("seconds"),
        (M.to_timestamp(there) < M.to_timestamp(here)).alias("earlier"),
        ((M.to_timestamp(moved) == M.to_timestamp(here)) & ~moved["tz_before_gmt"]).alias("same"),
    )


@query("""
SELECT s_suppkey, 'TLSv1.2' AS tls, 'EHLO' AS greeting, 'mx' || s_suppkey || '.example.com' AS host, '10.1.2.' || s_suppkey % 256 AS ip, 'ESMTP' AS protocol FROM supplier
""")
def received_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = "concat('Received: from [10.1.2.', s_suppkey % 256, '] (EHLO mx', s_suppkey, '.example.com)\r\n by relay.example with ESMTP (version=TLSv1.2 cipher=AES256);\r\n 1 Jan 2001 00:00:00 +0000')"
    m = PARSER.parse(rendered(table(spark, sf_dir, "supplier"), ["s_suppkey"], hop, "''", "''"), headers_only=True)
    r = M.received("message")
    return m.select("s_suppkey", M.tls_version_text(r["tls_version"]).alias("tls"), M.greeting_text(r["helo_cmd"]).alias("greeting"), M.host_text(r["helo"]).alias("host"), M.host_text(r["from"]).alias("ip"), r["with"].alias("protocol"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all machines share; below a temporary one where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/maildf-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def _clear(spark: SparkSession, *folders: str) -> None:
    """Empty mounted folders of folders, by tasks, as one process takes long over many files."""
    names = [e.path for f in folders for e in os.scandir(f.removeprefix("file://").removeprefix("file:"))]
    spark.sparkContext.parallelize(names, 4 * spark.sparkContext.defaultParallelism).foreach(partial(shutil.rmtree, ignore_errors=True))


@query("SELECT conv_id, turn, 820631134 + turn AS internal_date, role || '@example.org' AS envelope_from, 'turn ' || turn AS subject, text AS body FROM conversations")
def stored_mbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail written to mbox files, split once and stored, parsed, put into JSON lines and read from them."""
    mail = r"concat('From ', role, '@example.org ', date_format(timestamp_seconds(820631134 + turn), 'E MMM d HH:mm:ss yyyy'), '\nSubject: turn ', turn, '\nX-Conv: ', conv_id, '\n\n', regexp_replace(text, '(?m)^(>*From )', '>$1')) AS value"
    path = _folder(spark, "mbox")
    table(spark, sf_dir, "conversations").selectExpr(mail).write.text(path)
    split = _folder(spark, "mail")
    read_mbox(spark, f"{path}/part-*").write.parquet(split)
    m = from_json(to_json(PARSER.parse(spark.read.parquet(split))))
    text = F.get(M.text_bodies("message"), F.lit(0))["text"]
    conv = F.trim(M.as_text(M.header("message", "X-Conv"))).cast("long")
    turn = F.substring_index(M.subject("message"), " ", -1).cast("long")
    return m.select(conv.alias("conv_id"), turn.alias("turn"), "internal_date", "envelope_from", M.subject("message").alias("subject"), F.left(text, F.length(text) - 1).alias("body"))


#: Bytes of text whose mails and attachments are on disk at once, unless that makes more than so many waves, each of which reads the table.
WAVE, MOST_WAVES = 48 << 20, 8


@query("SELECT doc_id, 'déjà ' || doc_id || '.bin' AS name, 2 * length(coalesce(text, ''))::BIGINT AS size, 'Re: [' || source || '] Fwd: document ' || doc_id || ' (fwd)' AS subject FROM documents")
def stored_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mail as a file of its own, read again; its attachments written to files, by names of their own.

    Files take some twelve times the space of the table, so a large one goes in waves: a wave's files stay until its
    attachments have been found on disk. Mails are told apart by their row's place, so that equal rows are two mails.
    """
    docs = table(spark, sf_dir, "documents").select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place"))
    waves = max(1, min(MOST_WAVES, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WAVE)))
    written, there = _folder(spark, "written"), _folder(spark, "there")
    for i in range(waves):
        mails, files = _folder(spark, "eml"), _folder(spark, "files")
        mail = document_mail(spark, sf_dir, docs.filter(F.pmod("place", F.lit(waves)) == i), "place")
        named = mail.select(F.concat_ws(".", "doc_id", F.hex("place"), F.lit("eml")).alias("attachment_name"), F.col("raw").alias("bytes"))
        write_attachments(named, mails, spread=True).write.format("noop").mode("overwrite").save()
        m = PARSER.parse(read_eml(spark, mails, recursive=True).select("raw"))
        parts = attachments(m.withColumn("subject", M.subject("message")))
        write_attachments(parts, files, ["attachment_name", "subject"], spread=True).write.mode("append").parquet(written)
        read_files(spark, files, recursive=True, contents=False).select("path", F.col("size").alias("found")).write.mode("append").parquet(there)
        _clear(spark, mails, files)
    file = lambda c: F.substring_index(c, "/", -3)  # noqa: E731  # the wave's folder, the digest's, the name
    rows = spark.read.parquet(written).withColumn("key", file("file")).join(spark.read.parquet(there).withColumn("key", file("path")), "key")
    return rows.select(F.regexp_extract("attachment_name", r"(-?\d+)\.bin$", 1).cast("long").alias("doc_id"), F.col("attachment_name").alias("name"), F.col("found").alias("size"), "subject")


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE role END AS folder, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'Seen' ELSE 'Flagged,Seen' END AS flags, true AS dated, text AS body FROM conversations
""")
def stored_maildir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a file of a Maildir with a folder for each role but the user's, new mail in ``new``."""
    top = _folder(spark, "maildir")

    def deliver(batches):
        import pyarrow as pa

        for b in batches:
            for conv, turn, role, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                box = top.removeprefix("file:") if role == "user" else f"{top.removeprefix('file:')}/.{role}"
                for sub in ("cur", "new", "tmp"):
                    os.makedirs(f"{box}/{sub}", exist_ok=True)
                name = f"new/{conv}.{turn}.host" if turn % 3 == 0 else f"cur/{conv}.{turn}.host:2,{'S' if turn % 3 == 1 else 'FS'}"
                with open(f"{box}/{name}", "wb") as f:
                    f.write(raw)
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    raw = F.expr("encode(concat('Subject: ', conv_id, '/', turn, '\n\n', text), 'UTF-8')")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", raw).mapInArrow(deliver, "n long").agg(F.sum("n")).collect()
    m = PARSER.parse(read_maildir(spark, top))
    key = F.split(M.subject("message"), "/")
    return m.select(F.get(key, F.lit(0)).cast("long").alias("conv_id"), F.get(key, F.lit(1)).cast("long").alias("turn"), "folder", F.array_join("flags", ",").alias("flags"), (F.col("internal_date") > 1_500_000_000).alias("dated"), M.text_contents(M.part("message", 0)).alias("body"))
