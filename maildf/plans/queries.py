"""The engine's queries over the test tables, each with SQL that never parses mail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as M
from ..operators import attachments, daily_counts, deduplicate, explode_messages, link_replies
from ..parse import EmailParser
from ..sources import maildir_flags, split_mbox

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
PARSER = EmailParser()
#: Quoted-printable with every byte escaped and soft breaks; Base64 in lines.
QP = r"regexp_replace(regexp_replace(hex(encode({0}, 'UTF-8')), '(..)', '=$1'), '((?:=..){{24}})', '$1=\r\n')"
B64 = r"regexp_replace(base64({0}), '(.{{76}})', '$1\r\n')"


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[fn.__name__] = fn, sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, enough: int = 16 << 20) -> DataFrame:
    """Deal a small input to all cores, since parsing costs far more than moving it; larger ones have splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * enough else df


def rendered(df: DataFrame, keep: list[str], *lines: str) -> DataFrame:
    """A frame of ``keep`` and ``raw``: SQL string expressions joined by CRLF."""
    return spread(df).selectExpr(*keep, f"encode(concat_ws('\r\n', {', '.join(lines)}), 'UTF-8') AS raw")


def orders_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order confirmation for each order: headers alone."""
    o = spread(table(spark, sf_dir, "orders")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rendered(
        o,
        ["o_orderkey", "o_custkey"],
        "concat('From: ', replace(c_name, '#', ' '), ' <', lower(replace(c_name, '#', '.')), '@example.com>')",
        "concat('To: \"Desk, ', o_orderpriority, '\" <desk@example.org>, other@example.org')",
        "concat('Subject: Order ', o_orderkey, '\r\n =?utf-8?q?caf=C3=A9?= ', o_orderstatus)",
        "concat('Date: ', date_format(o_orderdate, 'E, d MMM yyyy HH:mm:ss'), ' -0330')",
        "concat('Message-ID: <o', o_orderkey, '@example.com>')",
        "''",
        "''",
    )


@query("""
SELECT o_orderkey, lower(replace(c_name, '#', '.')) || '@example.com' AS sender, replace(c_name, '#', ' ') AS sender_name,
       'Desk, ' || o_orderpriority AS to_name, 'Order ' || o_orderkey || ' café ' || o_orderstatus AS subject,
       epoch(o_orderdate)::BIGINT + 12600 AS sent, 'o' || o_orderkey || '@example.com' AS message_id
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PARSER.parse(orders_mail(spark, sf_dir), headers_only=True)
    sender, to = M.first_address(M.from_("message")), M.first_address(M.to("message"))
    return m.select("o_orderkey", sender["address"].alias("sender"), sender["name"].alias("sender_name"), to["name"].alias("to_name"), M.subject("message").alias("subject"), M.to_timestamp(M.date("message")).alias("sent"), M.message_id("message").alias("message_id"))


@query("""
WITH a AS (SELECT c_custkey, 'u' || c_custkey || '+' || lower(c_mktsegment) || '+x@mail' || c_nationkey || '.example' AS address FROM customer)
SELECT c_custkey, split_part(address, '@', 1) AS local_part, split_part(address, '@', 2) AS domain,
       'u' || c_custkey AS user_part, 'x' AS detail FROM a
""")
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('u', c_custkey, '+', lower(c_mktsegment), '+x@mail', c_nationkey, '.example') AS a")
    return a.select("c_custkey", M.address_local_part("a").alias("local_part"), M.address_domain("a").alias("domain"), M.address_user_part("a").alias("user_part"), M.address_detail_part("a").alias("detail"))


@query("""
SELECT r_regionkey, 'Region ' || r_name AS group_name, count(*) AS members, min('n' || n_nationkey || '@example.com') AS least
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
""")
def address_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat_ws(", ", F.collect_list(F.expr("concat('\"', n_name, '\" <n', n_nationkey, '@example.com>')"))).alias("list"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    m = PARSER.parse(rendered(r, ["r_regionkey"], "concat('Cc: Region ', r_name, ': ', list, ';')", "''", "''"), headers_only=True)
    g = F.get(M.as_group(M.cc("message")), F.lit(0))
    return m.select("r_regionkey", g["name"].alias("group_name"), F.size(g["addresses"]).cast("long").alias("members"), F.array_min(F.transform(g["addresses"], lambda a: a["address"])).alias("least"))


@query("""
SELECT conv_id, turn, 'c' || conv_id || '.' || turn || '@example.net' AS message_id,
       CASE WHEN turn > 0 THEN turn ELSE 0 END AS n_references,
       CASE WHEN turn > 0 THEN 'c' || conv_id || '.' || (turn - 1) || '@example.net' END AS last_reference
FROM conversations
""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("refs", F.expr("CASE WHEN turn > 0 THEN array_join(transform(sequence(0L, turn - 1), i -> concat('<c', conv_id, '.', i, '@example.net>')), '\r\n ') ELSE '' END"))
    m = PARSER.parse(rendered(c, ["conv_id", "turn"], "concat('Message-ID: <c', conv_id, '.', turn, '@example.net>')", "concat('References: ', refs)", "''", "''"), headers_only=True)
    refs = M.as_text_list(M.references("message"))
    return m.select("conv_id", "turn", M.message_id("message").alias("message_id"), F.coalesce(F.size(refs), F.lit(0)).cast("long").alias("n_references"), M.as_text(M.references("message")).alias("last_reference"))


@query("""
SELECT p_partkey, len(string_split(p_type, ' ')) + 1 AS n_keywords, 'größe ' || p_size AS last_keyword, string_split(p_type, ' ')[1] AS first_keyword FROM part
""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PARSER.parse(rendered(table(spark, sf_dir, "part"), ["p_partkey"], "concat('Keywords: ', replace(p_type, ' ', ' , '), ',\r\n =?iso-8859-1?Q?gr=F6=DFe?= ', p_size)", "''", "''"), headers_only=True)
    k = M.as_text_list(M.keywords("message"))
    return m.select("p_partkey", F.size(k).cast("long").alias("n_keywords"), F.try_element_at(k, F.lit(-1)).alias("last_keyword"), F.get(k, F.lit(0)).alias("first_keyword"))


def document_mail(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, *keep: str) -> DataFrame:
    """Each document as plain text in Base64, as HTML in quoted-printable, and attached under an RFC 2231 name."""
    d = (table(spark, sf_dir, "documents") if docs is None else docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rendered(
        d,
        ["doc_id", *keep],
        "concat('Subject: Re: [', source, '] Fwd: document ', doc_id, ' (fwd)')",
        "'MIME-Version: 1.0'",
        "'Content-Type: multipart/mixed; boundary=\"outer b\"'",
        "''",
        "'preamble'",
        "'--outer b'",
        "'Content-Type: multipart/alternative; boundary=inner'",
        "''",
        "'--inner'",
        "'Content-Type: text/plain; charset=utf-8'",
        "'Content-Transfer-Encoding: base64'",
        "''",
        B64.format("encode(text, 'UTF-8')"),
        "'--inner'",
        "'Content-Type: text/html; charset=utf-8'",
        "'Content-Transfer-Encoding: quoted-printable'",
        "''",
        QP.format("concat('<p>', doc_id, '</p>')"),
        "'--inner--'",
        "'--outer b'",
        "'Content-Type: application/octet-stream'",
        "concat('Content-Disposition: attachment;\r\n filename*0*=utf-8\\'en\\'d%C3%A9j%C3%A0%20;\r\n filename*1=\"', doc_id, '.bin\"')",
        "'Content-Transfer-Encoding: base64'",
        "''",
        B64.format("encode(text, 'UTF-16LE')"),
        "'--outer b--'",
        "''",
    )


@query("""
SELECT doc_id, 5::BIGINT AS n_parts, 1::BIGINT AS texts, 1::BIGINT AS htmls, 1::BIGINT AS attachments, coalesce(text, '') AS body,
       '<p>' || doc_id || '</p>' AS html, 'document ' || doc_id AS thread FROM documents
""")
def mime_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PARSER.parse(document_mail(spark, sf_dir))
    return m.select("doc_id", F.size("message.parts").cast("long").alias("n_parts"), M.text_body_count("message").cast("long").alias("texts"), M.html_body_count("message").cast("long").alias("htmls"), M.attachment_count("message").cast("long").alias("attachments"), M.body_text("message").alias("body"), M.body_html("message").alias("html"), M.thread_name("message").alias("thread"))


@query("""
SELECT doc_id, 4::INTEGER AS part_id, 'déjà ' || doc_id || '.bin' AS attachment_name, 'application/octet-stream' AS media_type,
       2 * length(coalesce(text, ''))::BIGINT AS n_bytes FROM documents
""")
def attachment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attachments(PARSER.parse(document_mail(spark, sf_dir)))
    return a.select("doc_id", "part_id", "attachment_name", "media_type", F.octet_length("bytes").cast("long").alias("n_bytes"))


@query("SELECT doc_id, coalesce(text, '') AS body, 'quoted-printable' AS encoding FROM documents")
def quoted_printable_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    m = PARSER.parse(rendered(d, ["doc_id"], "'Content-Type: text/plain'", "'Content-Transfer-Encoding: Quoted-Printable'", "''", QP.format("text")))
    return m.select("doc_id", M.body_text("message").alias("body"), M.root_part("message")["encoding"].alias("encoding"))


@query("SELECT doc_id, coalesce(text, '') AS body FROM documents")
def charset_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    m = PARSER.parse(rendered(d, ["doc_id"], "'Content-Type: text/plain; charset=\"UTF-16BE\"'", "'Content-Transfer-Encoding: base64'", "''", B64.format("encode(text, 'UTF-16BE')")))
    return m.select("doc_id", M.body_text("message").alias("body"))


@query("""
SELECT doc_id, length(name) AS path_len, 'inner ' || doc_id AS subject, coalesce(text, '') AS body FROM documents, (VALUES ('inline'), ('coded')) AS k(name)
""")
def nested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in a message within a message, once as it is and once in Base64."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    inner = "concat_ws('\r\n', concat('Subject: inner ', doc_id), 'Content-Type: text/plain; charset=utf-8', 'Content-Transfer-Encoding: base64', '', " + B64.format("encode(text, 'UTF-8')") + ")"
    d = d.withColumn("inner", F.expr(inner)).withColumn("name", F.explode(F.array(F.lit("inline"), F.lit("coded"))))
    body = "CASE name WHEN 'inline' THEN concat('\r\n', inner) ELSE concat('Content-Transfer-Encoding: base64\r\n\r\n', " + B64.format("encode(inner, 'UTF-8')") + ") END"
    m = PARSER.parse(rendered(d, ["doc_id", "name"], "'Content-Type: multipart/digest; boundary=b'", "''", "'--b'", "'Content-Type: message/rfc822'", body, "'--b--'", "''"))
    n = explode_messages(m).filter(F.size("msg_path") == 1)
    return n.select("doc_id", F.length("name").cast("long").alias("path_len"), M.subject("message").alias("subject"), F.get(M.text_bodies("message"), F.lit(0))["text"].alias("b"), F.get(F.filter("message.parts", lambda p: p["kind"] == "text"), F.lit(0))["text"].alias("body")).drop("b")


@query("SELECT doc_id, v.html::BIGINT AS html, v.text::BIGINT AS text, v.attached::BIGINT AS attached FROM documents, (VALUES (2, 2, 1)) AS v(html, text, attached)")
def body_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inline texts around an image that is attached."""
    m = PARSER.parse(
        rendered(
            table(spark, sf_dir, "documents"),
            ["doc_id"],
            "'Content-Type: multipart/mixed; boundary=x'",
            "''",
            "'--x'",
            "''",
            "concat('first ', doc_id)",
            "'--x'",
            "'Content-Type: image/png'",
            "'Content-Disposition: attachment'",
            "''",
            "'png'",
            "'--x'",
            "'Content-Type: text/html'",
            "''",
            "'<b>last</b>'",
            "'--x--'",
        )
    )
    return m.select("doc_id", M.html_body_count("message").cast("long").alias("html"), M.text_body_count("message").cast("long").alias("text"), M.attachment_count("message").cast("long").alias("attached"))


@query("""
SELECT conv_id, turn, 'topic ' || conv_id || ' of ' || role AS thread FROM conversations
""")
def thread_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE turn % 5 WHEN 0 THEN concat('topic ', conv_id, ' of ', role) WHEN 1 THEN concat('Re: topic ', conv_id, ' of ', role) WHEN 2 THEN concat('AW: [list] WG: topic ', conv_id, ' of ', role, ' (fwd)') WHEN 3 THEN concat('[fwd: re: topic ', conv_id, ' of ', role, ']') ELSE concat('rv[', turn, ']: 回复: topic ', conv_id, ' of ', role) END AS s")
    return c.select("conv_id", "turn", M.thread_name_of("s").alias("thread"))


@query("SELECT doc_id, '<html><body>' || replace(replace(replace(text || chr(13) || chr(10) || '<' || source || '>', chr(13), ''), '<', '&lt;'), chr(10), '<br/>') || '</body></html>' AS html FROM documents")
def text_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.text_to_html(F.expr("concat(text, '\r\n<', source, '>')")).alias("html"))


@query("""
SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE
       left(text, list_max(list_filter(range(0, 98), lambda n: strlen(left(text, n)) <= 97))::BIGINT) || '...' END AS preview FROM documents
""")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.preview_text("text", 100).alias("preview"))


@query(r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<head>.*?</head>', '<br>', 'gs') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<br>|</p>', chr(1), 'g'), '<[^<>]*(>|$)', '', 'g') AS h FROM t),
s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '[ \t\r\n]+', ' ', 'g'), ' ?' || chr(1) || ' ?', chr(10), 'g'), '^ | $', '', 'g') AS h FROM b)
SELECT page_id, replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text FROM s
""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL knows what these pages hold: heads with one paragraph's end in a script, few entities, plain tags."""
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return p.select("page_id", M.html_to_text("html").alias("text"))


@query("""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, 820631134 + turn AS internal_date,
       role || '@example.org' AS envelope_from, text AS body
FROM conversations
""")
def mbox_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one mbox, its lines that begin with From quoted."""
    turn = r"concat('From ', role, '@example.org ', date_format(timestamp_seconds(820631134 + turn), 'E MMM d HH:mm:ss yyyy'), '\nSubject: ', turn, '\n\n', regexp_replace(text, '(?m)^(>*From )', '>$1'), '\n')"
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.expr(turn).alias("mail")).alias("t"))
    boxes = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv_id", F.encode(F.concat(F.lit("no mail\n"), F.array_join(F.transform("ts", lambda t: t["mail"]), "")), "UTF-8").alias("mbox"))
    m = PARSER.parse(split_mbox(boxes, "mbox"))
    return m.select("conv_id", "seq", "internal_date", "envelope_from", F.expr("substring(message.parts[0].text, 1, length(message.parts[0].text) - 1)").alias("body"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Seen' WHEN 1 THEN 'Flagged,Seen' WHEN 2 THEN '' ELSE 'Draft,Passed,Replied' END AS flags FROM events
""")
def maildir_flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "concat(event_id, '.host', CASE event_id % 4 WHEN 0 THEN ':2,S' WHEN 1 THEN ':2,FaS' WHEN 2 THEN '' ELSE ':2,DPR!S' END) AS name")
    return e.select("event_id", F.array_join(maildir_flags("name"), ",").alias("flags"))


@query("""
SELECT s_suppkey, 'mx' || s_suppkey || '.example.com' AS from_host, '10.0.' || (s_suppkey // 256) % 256 || '.' || s_suppkey % 256 AS from_ip,
       'relay.' || lower(n_name) || '.example' AS by_host, 'ESMTPS' AS protocol, 'TLSv1_3' AS tls, 'id' || s_suppkey AS id,
       's' || s_suppkey || '@example.org' AS recipient, 880127706 + s_suppkey AS sent
FROM (SELECT s_suppkey, replace(n_name, ' ', '-') AS n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
""")
def received_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    hop = (
        "concat('Received: from mx', s_suppkey, '.example.com (mx', s_suppkey, '.example.com [10.0.', s_suppkey div 256 % 256, '.', s_suppkey % 256, '])\r\n by relay.', "
        "lower(replace(n_name, ' ', '-')), '.example with ESMTPS (using TLSv1.3 with cipher TLS_AES_256_GCM_SHA384 (256/256 bits))\r\n id id', s_suppkey, "
        "' for <s', s_suppkey, '@example.org>;\r\n ', date_format(timestamp_seconds(880127706 + s_suppkey), 'E, d MMM yyyy HH:mm:ss'), ' +0000 (UTC)')"
    )
    m = PARSER.parse(rendered(s, ["s_suppkey"], hop, "'Received: by other.example with SMTP; 1 Jan 2001 00:00:00 +0000'", "''", "''"), headers_only=True)
    r = F.get(M.received_all("message"), F.lit(0))
    return m.select("s_suppkey", r["from"]["name"].alias("from_host"), r["from_ip"].alias("from_ip"), r["by"]["name"].alias("by_host"), r["with"].alias("protocol"), r["tls_version"].alias("tls"), r["id"].alias("id"), r["for_"].alias("recipient"), M.to_timestamp(r["date"]).alias("sent"))


@query("""
SELECT event_id, strftime(ts, '%a, %-d %b %Y %H:%M:%S') || ' +0000' AS rfc822, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339,
       epoch(date_trunc('second', ts))::BIGINT AS seconds, julian(ts::DATE)::BIGINT AS julian, dayofweek(ts)::INTEGER AS dow,
       strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS moved, true AS valid FROM events
""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", M.from_timestamp(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("d"))
    d = F.col("d")
    return e.select("event_id", M.to_rfc822(d).alias("rfc822"), M.to_rfc3339(d).alias("rfc3339"), M.to_timestamp(d).alias("seconds"), M.julian_day(d).alias("julian"), M.day_of_week(d).alias("dow"), M.to_rfc3339(M.to_timezone(d, 19800)).alias("moved"), M.is_valid_date(d).alias("valid"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t1, epoch(date_trunc('second', ts))::BIGINT - 7200 AS t2 FROM events")
def date_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events")).select("event_id", M.parse_rfc3339(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("a"), M.parse_rfc822(F.concat(F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0200 (comment (nested))"))).alias("b"))
    return e.select("event_id", M.to_timestamp(F.col("a")).alias("t1"), M.to_timestamp(F.col("b")).alias("t2"))


@query("""
SELECT o_orderkey, 2::BIGINT AS n_subjects, 'last ' || o_orderkey AS last_subject, ' first ' || o_orderkey AS first_raw, 'first ' || o_orderkey AS first_text,
       ' last ' || o_orderkey || chr(13) || chr(10) AS last_raw FROM orders
""")
def header_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated headers: the last one counts, all can be read again in another form."""
    o = rendered(table(spark, sf_dir, "orders"), ["o_orderkey"], "concat('Subject: first ', o_orderkey)", "concat('SUB JECT : last ', o_orderkey)", "''", "''")
    m = PARSER.parse(o, headers_only=True, keep_raw=True)
    text = F.transform(M.header_as("raw", "message", "Subject", "text"), lambda v: v["text"])
    first = F.get(M.headers_raw("raw", "message"), F.lit(0))["raw"]
    return m.select("o_orderkey", F.size(M.header_values("message", "Subject")).cast("long").alias("n_subjects"), M.subject("message").alias("last_subject"), F.rtrim(F.replace(first, F.lit("\r\n"), F.lit(""))).alias("first_raw"), F.get(text, F.lit(0)).alias("first_text"), M.header_raw("raw", "message", "Subject").alias("last_raw"))


@query("""
SELECT p_partkey, 'text' AS ctype, 'x-part' AS subtype, p_name AS title, lower(p_brand) AS brand, 3::BIGINT AS n_attributes FROM part
""")
def content_type_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = PARSER.parse(rendered(table(spark, sf_dir, "part"), ["p_partkey"], "concat('Content-Type: TEXT/X-Part (a comment); Title=\"', p_name, '\";\r\n brand=', lower(p_brand), '; Size*=utf-8\\'\\'%31')", "''", "'x'"))
    ct = M.content_type(M.root_part("message"))
    return m.select("p_partkey", M.ctype(ct).alias("ctype"), M.subtype(ct).alias("subtype"), M.attribute(ct, "title").alias("title"), M.attribute(ct, "brand").alias("brand"), F.size(ct["attributes"]).cast("long").alias("n_attributes"))


@query("SELECT o_orderkey, 'Text' AS subject_kind, 'Empty' AS date_kind, 'Order ' || o_orderkey || ' café ' || o_orderstatus AS subject FROM orders")
def custom_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen headers are typed, all others take the default form."""
    m = PARSER.header_text("Subject").ignore_header("Date").parse(orders_mail(spark, sf_dir), headers_only=True)
    return m.select("o_orderkey", M.header("message", "Subject")["kind"].alias("subject_kind"), M.header("message", "Date")["kind"].alias("date_kind"), M.subject("message").alias("subject"))


@query("""
SELECT doc_id, text AS b64, text AS qp, true AS percent_ok, text AS percent, text AS charset FROM documents
""")
def decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hexed = "regexp_replace(hex(encode(text, 'UTF-8')), '(..)', '{0}$1')"
    e = d.select("doc_id", F.encode(F.expr(B64.format("encode(text, 'UTF-8')")), "UTF-8").alias("b"), F.encode(F.expr(QP.format("text")), "UTF-8").alias("q"), F.encode(F.expr(hexed.format("%")), "UTF-8").alias("p"), F.encode("text", "UTF-16LE").alias("u"))
    p = M.percent_decode("p")
    out = e.select("doc_id", M.base64_decode("b").alias("b64"), M.quoted_printable_decode("q").alias("qp"), p.alias("p"), M.charset_decode("u", F.lit("utf-16le")).alias("charset"))
    return out.select("doc_id", F.col("b64").cast("string").alias("b64"), F.col("qp").cast("string").alias("qp"), F.col("p.ok").alias("percent_ok"), F.col("p.bytes").cast("string").alias("percent"), "charset")


@query("""
SELECT a.conv_id, a.turn, b.turn AS parent_turn FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
""")
def ext_reply_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: messages joined to the messages they answer."""
    c = rendered(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "concat('Message-ID: <c', conv_id, '.', turn, '@x>')", "concat('In-Reply-To: <c', conv_id, '.', turn - 1, '@x>')", "''", "''")
    m = PARSER.parse(c, headers_only=True).select("conv_id", "turn", M.message_id("message").alias("message_id"), M.as_text(M.in_reply_to("message")).alias("in_reply_to"))
    return link_replies(m).select("conv_id", "turn", "parent_turn")


@query("""
SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS sender, strftime(o_orderdate + INTERVAL 210 MINUTE, '%Y-%m-%d') AS day, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
""")
def ext_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: messages by sender and day."""
    m = PARSER.parse(orders_mail(spark, sf_dir), headers_only=True)
    counts = daily_counts(m.select(M.first_address(M.from_("message"))["address"].alias("sender"), F.timestamp_seconds(M.to_timestamp(M.date("message"))).alias("ts")))
    return counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT count(*) AS n FROM orders")
def ext_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: each message id once, from mail delivered twice."""
    m = PARSER.parse(orders_mail(spark, sf_dir), headers_only=True).select(M.message_id("message").alias("message_id"))
    return deduplicate(m.unionAll(m)).agg(F.count(F.lit(1)).alias("n"))


from . import details  # noqa: E402, F401  more queries, which use the helpers above


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
