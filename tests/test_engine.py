"""The Spark layer: parse operator, functions, sources, operators, streams and registered queries."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from maildf import functions as M
from maildf import operators as O
from maildf import sources, streaming
from maildf.kernel import dates, decoders, html, mailbox, mime
from maildf.parse import EmailParser, flatten
from maildf.plans import queries as Q

SF = "/root/testdata/sf0.001"
MAIL = b"""Received: from a.example by b.example with SMTP; 1 Jan 2001 00:00:00 +0000\r
Received: from c.example by d.example with ESMTP; 2 Jan 2001 00:00:00 +0000\r
From: Ann <ann@x.org>\r
To: Team: Bob <bob@y.org>, Cy <CY@z.org>;\r
Subject: Re: [l] plan =?utf-8?q?=C3=A9?=\r
Date: Mon, 1 Jan 2001 02:00:00 +0130\r
Message-ID: <m1@x>\r
References: <a@x> <b@x>\r
X-Raw:  kept \r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary=b\r
\r
--b\r
Content-Type: text/html; charset=utf-8\r
\r
<p>Hi <b>Bob</b></p>\r
--b\r
Content-Type: message/rfc822\r
\r
Subject: inner\r
\r
inner text\r
--b\r
Content-Type: application/pdf; name="../a b.pdf"\r
Content-Disposition: attachment\r
Content-Transfer-Encoding: base64\r
\r
JVBERg==\r
--b--\r
"""


@pytest.fixture(scope="module")
def mail(spark):
    df = spark.createDataFrame([(1, bytearray(MAIL), "x"), (2, None, "y"), (3, bytearray(b""), "z")], "id int, raw binary, message string")
    return EmailParser().parse(df, keep_raw=True).cache()


def one(df, *columns):
    return df.filter("id = 1").select(*columns).first()


def test_parse_equals_the_kernel(mail):
    got = one(mail, "message")[0].asDict(recursive=True)
    want = flatten(mime.parse(MAIL))
    assert [p["kind"] for p in got["parts"]] == [p["kind"] for p in want["parts"]]
    assert [(h["name"], h["value"]["kind"], h["offset_start"]) for p in got["parts"] for h in p["headers"]] == [(h["name"], h["value"]["kind"], h["offset_start"]) for p in want["parts"] for h in p["headers"]]
    assert mail.filter("id > 1").select(F.col("message").isNull()).distinct().collect() == [(True,)]
    assert mail.columns == ["id", "raw", "message"]


def test_accessors(mail):
    m = "message"
    r = one(
        mail,
        M.subject(m).alias("subject"),
        M.thread_name(m).alias("thread"),
        M.first_address(M.from_(m)).alias("sender"),
        M.last_address(M.to(m))["address"].alias("last_to"),
        M.address_contains(M.to(m), "cy@Z.org").alias("has"),
        F.size(M.as_group(M.to(m))).alias("groups"),
        M.as_list(M.to(m)).alias("no_list"),
        M.as_text(M.references(m)).alias("ref"),
        F.size(M.received_all(m)).alias("hops"),
        M.received(m)["from"]["name"].alias("hop"),
        M.return_address(m).alias("back"),
        M.header_raw("raw", m, "X-Raw").alias("x_raw"),
        M.body_text(m).alias("text"),
        M.body_html(m).alias("html"),
        M.body_preview(m, 5).alias("preview"),
        M.attachment_count(m).alias("n"),
        M.attachment_name(M.attachment(m, 1)).alias("file"),
        M.is_content_type(M.attachment(m, 1), "APPLICATION", "pdf").alias("pdf"),
        M.part_len(M.attachment(m, 1)).alias("len"),
        M.to_timestamp(M.date(m)).alias("ts"),
        M.to_rfc822(M.date(m)).alias("date"),
        M.subject(M.sub_message(m, M.part(m, 2))).alias("inner"),
        M.display(M.root_part(m)).alias("none"),
        M.mime_version(m)["text"].alias("version"),
        F.size(M.remove_header(m, "Received")).alias("fewer"),
        M.remove_header(m, "Received")[0]["name"].alias("moved"),
        M.raw_len(M.root_part(m)).alias("raw_len"),
        M.is_empty(m).alias("empty"),
        F.octet_length(M.raw_message("raw", m)).alias("whole"),
        M.value_len(M.header(m, "Date")).alias("date_len"),
        F.transform(M.header_as("raw", m, "Received", "raw"), lambda v: v["text"])[1].alias("as_raw"),
    )
    assert r.subject == "Re: [l] plan é" and r.thread == "plan é"
    assert tuple(r.sender) == ("Ann", "ann@x.org") and r.last_to == "CY@z.org" and r.has and r.groups == 1 and r.no_list is None
    assert (r.ref, r.hops, r.hop, r.back) == ("b@x", 2, "c.example", "ann@x.org")
    assert r.x_raw == "  kept \r\n" and r.text == html.html_to_text("<p>Hi <b>Bob</b></p>") and r.html == "<p>Hi <b>Bob</b></p>"
    assert (r.preview, r.n, r.file, r.pdf, r.len) == ("Hi Bo", 2, "../a b.pdf", True, 4)
    assert (r.ts, r.date) == (978309000, "Mon, 1 Jan 2001 02:00:00 +0130")
    assert (r.inner, r.none, r.version, r.empty) == ("inner", "[no contents]", "1.0", False)
    assert (r.fewer, r.moved) == (10, "Content-Type") and r.raw_len == r.whole == len(MAIL) and r.date_len == 24
    assert r.as_raw.startswith("from c.example")


def test_accessors_are_native(mail):
    """Only the parse itself runs in Python."""
    plan = mail.select(M.subject("message"), M.to_timestamp(M.date("message")), M.attachment_name(M.attachment("message", 0)))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_parser_options(spark):
    df = spark.createDataFrame([(bytearray(MAIL),)], "raw binary")
    kind = lambda p, name: p.parse(df, headers_only=True).select(M.header("message", name)["kind"]).first()[0]
    assert kind(EmailParser().with_minimal_headers(), "Date") == "DateTime"
    assert kind(EmailParser().with_minimal_headers(), "References") == "Text"
    assert kind(EmailParser().with_message_ids(), "References") == "TextList"
    assert kind(EmailParser().with_date_headers().default_header_ignore(), "Subject") == "Empty"
    assert kind(EmailParser().header_raw("Date"), "Date") == "Text"
    assert kind(EmailParser().header_date("Date").without_header("Date"), "Date") == "DateTime"
    assert kind(EmailParser().with_address_headers().ignore_header("From"), "From") == "Empty"
    with pytest.raises(ValueError):
        EmailParser().header("Date", "nonsense")


def test_operators(spark, mail, tmp_path):
    some = mail.filter("id = 1").drop("raw")
    assert O.explode_parts(some).count() == 5
    assert {r.msg_path[0] if r.msg_path else None for r in O.explode_messages(some).collect()} == {None, 2}
    rows = O.attachments(some)
    assert [(r.attachment_name, r.media_type, bytes(r.bytes)) for r in rows.collect()] == [("../a b.pdf", "application/pdf", b"%PDF")]
    done = O.write_attachments(rows, f"{tmp_path}/out").collect()
    assert len(done) == 1 and os.path.dirname(done[0].file) == f"{tmp_path}/out" and done[0].file.endswith("-a_b.pdf")
    assert '"inner text' in O.to_json(some).first().json


def test_columns_of_text(spark):
    df = spark.createDataFrame([("é" * 60, "a=3D", "Joe <j@x>", "content-TYPE"), (None, None, None, "no good"), ("x" * 120, "=", "", "X-Other")], "t string, q string, a string, n string")
    r = df.select(M.preview_text("t", 20).alias("p"), M.quoted_printable_decode(F.encode("q", "UTF-8")).alias("q"), M.header_value_of("a", "address")["kind"].alias("a"), M.header_name("n").alias("n"), M.charset_is_known("q").alias("k"), M.decode_header("a").alias("d")).collect()
    assert [x.p for x in r] == ["é" * 8 + "...", None, "x" * 17 + "..."]
    assert [x.q and bytes(x.q) for x in r] == [b"a=", None, b""]
    assert [x.a for x in r] == ["Address", None, "Empty"] and [x.n for x in r] == ["Content-Type", None, "X-Other"]


def test_address_functions(spark):
    cases = [("a+b+c@x.y", "a+b+c", "x.y", "a", "c"), ("a@b", "a", "b", "a", None), ("@b", None, None, None, None), ("a@", None, None, None, None), ("é@b", None, None, None, None), (None, None, None, None, None), ("a@b@c", "a", "b@c", "a", None), ("+d@x", "+d", "x", None, "d")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string").orderBy("i")
    got = df.select(M.address_local_part("a"), M.address_domain("a"), M.address_user_part("a"), M.address_detail_part("a")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_names_values_and_sql(spark, mail):
    df = spark.createDataFrame([("SUBJECT",), ("content-id",), ("X-Y",), ("Message-Instance",)], "n string")
    assert [tuple(r) for r in df.select(M.header_name_id("n"), M.is_mime_header("n"), M.is_other_header("n")).collect()] == [(0, False, False), (17, True, False), (37, False, True), (43, False, False)]
    r = one(mail, M.value_len(M.header("message", "Content-Type")).alias("ct"), M.value_len(M.header("message", "To")).alias("to"), M.host_text(M.received("message")["from"]).alias("host"), M.nested_raw("raw", "message", M.part("message", 2)).alias("nested"), M.greeting_text(F.lit("Ehlo")).alias("g"), M.tls_version_text(F.lit("TLSv1_2")).alias("t"))
    assert (r.ct, r.to, r.host, r.g, r.t) == (len("multipartmixedboundaryb"), len("Bobbob@y.orgCyCY@z.org"), "c.example", "EHLO", "TLSv1.2")
    assert bytes(r.nested) == b"Subject: inner\r\n\r\ninner text"
    M.register(spark)
    assert spark.sql("SELECT mail_thread_name_of('Re: x'), mail_html_to_text('<p>y</p>')").first()[:] == ("x", "y\n")
    one_addr = M.addr(F.lit("A"), F.lit("a@b"))
    got = spark.range(1).select(M.first_address(M.to_address(F.array(M.group(F.lit("g"), F.array(one_addr)))))["address"]).first()[0]
    assert got == "a@b"


def test_mbox_sources(spark, tmp_path):
    sources.register(spark)
    turns = [(f"From a{i}@x Sat Jan  3 01:05:{i % 60:02d} 1996\nSubject: {i}\n\n" + f">From quoted {i}\n" * (i % 7)).encode() for i in range(200)]
    (tmp_path / "one.mbox").write_bytes(b"junk\n" + b"".join(turns))
    (tmp_path / "two.mbox").write_bytes(b"")
    whole = sources.read_mbox(spark, f"{tmp_path}/*.mbox").orderBy("seq").collect()
    assert [r.envelope_from for r in whole] == [f"a{i}@x" for i in range(200)]
    assert bytes(whole[6].raw) == b"Subject: 6\n\n" + b"From quoted 6\n" * 6
    for size in (100, 999, 1 << 20):
        cut = spark.read.format("mbox").option("splitBytes", size).load(str(tmp_path)).orderBy("seq").collect()
        assert [(r.internal_date, r.envelope_from, bytes(r.raw)) for r in cut] == [(r.internal_date, r.envelope_from, bytes(r.raw)) for r in whole]
    assert sources.read_eml(spark, f"{tmp_path}/one.mbox").count() == 1


def test_maildir_sources(spark, tmp_path):
    for sub in ("", ".Work", ".Work.Old", "nested/box", "nested/box/inner"):
        for d in ("cur", "new", "tmp"):
            (tmp_path / sub / d).mkdir(parents=True, exist_ok=True)
        (tmp_path / sub / "cur" / f"1.{len(sub)}.host:2,RS").write_bytes(b"Subject: s\n\nbody")
        (tmp_path / sub / "cur" / ".hidden").write_bytes(b"no")
    sources.register(spark)
    plus = [r.folder for r in spark.read.format("maildir").load(str(tmp_path)).collect()]
    assert Counter(plus) == Counter([None, "Work", "Work.Old"])
    nested = spark.read.format("maildir").option("layout", "fs").load(str(tmp_path)).collect()
    assert Counter(r.folder for r in nested) == Counter([None, ".Work", ".Work.Old", "nested/box", "nested/box/inner"])
    assert nested[0].flags == ["Replied", "Seen"] and nested[0].internal_date > 0
    assert Counter(r.folder for r in sources.read_maildir(spark, str(tmp_path)).collect()) == Counter(plus)
    assert sources.read_maildir(spark, f"{tmp_path}/nested").count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "new").mkdir()
    for i in range(6):
        (tmp_path / "new" / f"{i}.host").write_bytes(f"From: a{i % 2}@x\nMessage-ID: <{i % 4}@x>\nDate: 1 Jan 2001 0{i % 4}:30:00 +0000\nSubject: n\n\n".encode())
    q = streaming.mail_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("mail").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.sql("SELECT * FROM mail").collect()
    assert sorted(r.message_id for r in rows) == ["0@x", "1@x", "2@x", "3@x"] and {r.sender for r in rows} == {"a0@x", "a1@x"}
    counts = streaming.windowed_counts(spark.table("mail"))
    assert counts.agg(F.sum("n")).first()[0] == 4


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.REGISTRY))
def test_queries(spark, oracle, name):
    fn, sql = Q.REGISTRY[name]
    got = fn(spark, SF)
    if sql is None:
        return
    want = oracle.sql(sql)
    key = lambda row: repr(row)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)


def test_html_query_matches_the_kernel(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in Q.html_to_text(spark, SF).collect()} == {k: html.html_to_text(v) for k, v in pages.items()}


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 1500
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("size", [5, 6, 7, 23, 50, 200, 1 << 20])
def test_mbox_in_ranges(spark, tmp_path, size):
    """Messages come out whole wherever ranges cut a file, in order, with and without a last newline."""
    one = b"lost\nFrom a@x Mon Jan 1 00:00:00 2001\nSubject: 1\r\n\r\n>From body\nx\n\nFrom b@x\n\nFrom c@x Tue Jan 2 00:00:00 2001\n" + b"long line " * 30 + b"\nFrom here\nend"
    files = {"1.mbox": one, "2.mbox": one + b"\n", "3.mbox": b"no mail\nat all\n", "4.mbox": b"", "5.mbox": b"From z@x Mon Jan 1 00:00:00 2001\n", "6.mbox": b"\nFrom a\nFrom \nFrom \n\nFrom b\n\n\nFrom", "7.mbox": b"From From \nFromx\nFrom y"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = sources.read_mbox(spark, f"{tmp_path}/*.mbox").orderBy("path", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, data in files.items():
        mine = [r for r in rows if r.path.endswith(name)]
        assert [(r.internal_date, r.envelope_from, bytes(r.raw)) for r in mine] == list(mailbox.split_mbox(data))
        assert len({r.seq for r in mine}) == len(mine)


def test_large_mbox_is_not_copied(spark):
    """A mailbox in one row, of more messages than memory would hold copies of it."""
    box = b"".join(b"From a@x Mon Jan 1 00:00:00 2001\nSubject: %d\n\n%s\n" % (i, b"x" * 1000) for i in range(20_000))
    df = spark.createDataFrame([(bytearray(box),)], "box binary")
    assert sources.split_mbox(df, "box").agg(F.count("*"), F.sum(F.octet_length("raw"))).first() == (20_000, sum(len(b"Subject: %d\n\n%s\n" % (i, b"x" * 1000)) for i in range(20_000)))


def test_native_readers_agree_with_the_kernel(spark):
    dates_ = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123-05:30", "2024-01-02T03:04:05+00:00", "2024-1-2T3:4:5Z", "2024-01-02T03:04:05", "x", None, "9999-99-99T99:99:99-99:99", " 2024-01-02T03:04:05Z"]
    for r in spark.createDataFrame([(t,) for t in dates_], "t string").select("t", M.parse_rfc3339("t").alias("d")).collect():
        assert (r.d.asDict() if r.d else None) == (dates.parse_rfc3339(r.t) if r.t is not None else None), r
    mails = ["Mon, 5 Jan 1998 01:02:03 -0330", "15 FEB 0049 01:02:03 +0000", "1 Mar 0099 23:59:59 -0000", "1 Foo 2001 00:00:00 +0100", "1 Jan 2001 00:00:00 +9999", "1 Jan 2001 00:00:00 GMT", "1 Jan 2001 0:0 +0100 (x)", "", None, "31 dEc 2024 10:00:00 +0530 (IST)"]
    for r in spark.createDataFrame([(t,) for t in mails], "t string").select("t", M.parse_rfc822("t").alias("d")).collect():
        assert (r.d.asDict() if r.d else None) == (dates.parse_rfc822(r.t) if r.t is not None else None), r
    blobs = [b"aGVsbG8=", b"aGVs\r\nbG8=", b"", b"aGVsbG8", b"a*b", None, b"aGVsbG8=aGVsbG8=", b"YQ==", b"=", b"YQ=", b"====", b"AB==", b"ab\xff"]
    for r in spark.createDataFrame([(b,) for b in blobs], "b binary").select("b", M.base64_decode("b").alias("d")).collect():
        assert (bytes(r.d) if r.d is not None else None) == (decoders.base64_decode(bytes(r.b)) if r.b is not None else None), r


def test_sources_report_what_they_cannot_read(spark, tmp_path):
    from maildf.sources.maildir import _Files, _MaildirReader

    for sub in ("cur", "new", "tmp"):
        (tmp_path / sub).mkdir()
    (tmp_path / "cur" / "1.h:2,S").write_bytes(b"Subject: moved\n\n")
    reader = _MaildirReader({"path": str(tmp_path)})
    rows = list(reader.read(_Files(None, [f"{tmp_path}/new/1.h", f"{tmp_path}/new/2.h"])))
    assert rows[0][1] == f"{tmp_path}/cur/1.h:2,S" and rows[0][3] == ["Seen"] and rows[0][5] is None
    assert rows[1][4] is None and "No such file" in rows[1][5]
    with pytest.raises(OSError):
        list(_MaildirReader({"path": str(tmp_path), "mode": "FAILFAST"}).read(_Files(None, [f"{tmp_path}/new/2.h"])))


def test_json_both_ways(spark):
    m = EmailParser().parse(spark.createDataFrame([(bytearray(MAIL),), (None,)], "raw binary"))
    assert O.from_json(O.to_json(m)).collect() == m.collect()
    with pytest.raises(ValueError, match="no mounted folder"):
        O.write_attachments(O.attachments(m), "s3a://bucket/folder")


def test_many_files_are_read_by_few_tasks(spark, tmp_path):
    """As binaryFile sees them, but listed once and read by the thousand."""
    for d in ("a", "b,c", "d/e", "k=1"):
        (tmp_path / d).mkdir(parents=True)
        for i in range(300):
            (tmp_path / d / f"é {i}.eml").write_bytes(b"Subject: %d\n\n" % i)
        (tmp_path / d / ".hidden").write_bytes(b"no")
        (tmp_path / d / "_hidden").write_bytes(b"no")
    top = str(tmp_path)
    for path, deep in ((top, True), (f"{top}/d", False), (f"{top}/a", False), (f"{top}/*/*.eml", False), (f"{top}/{{a,d/e}}/*.eml", False), ([f"{top}/b,c", f"{top}/a/é 1.eml"], False)):
        got = sources.read_files(spark, path, deep)
        want = spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(path)
        assert sorted(got.select("path", "internal_date", "size", "raw").collect()) == sorted(want.select("path", F.unix_seconds("modificationTime"), "length", "content").collect()), path
        bare = sources.read_files(spark, path, deep, contents=False).collect()
        assert sorted((r.path, r.size, r.raw) for r in bare) == sorted((r.path, r.length, None) for r in want.collect())
    assert sources.read_eml(spark, top, recursive=True).rdd.getNumPartitions() <= 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_eml(spark, f"{top}/nothing").count()


def test_attachments_are_spread_over_folders(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "concat('n', id % 100, '.bin') AS attachment_name", "encode(cast(id % 100 AS string), 'UTF-8') AS bytes")
    done = O.write_attachments(rows, f"{tmp_path}/out", ["id"], spread=True).collect()
    assert sorted(r.id for r in done) == list(range(200)) and len({r.file for r in done}) == 100
    assert all(open(r.file).read() == str(r.id % 100) and os.path.basename(r.file).startswith(os.path.basename(os.path.dirname(r.file))) for r in done)
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".part")]


def test_stored_attachments_go_in_waves(spark, tmp_path, monkeypatch):
    """Equal rows, rows without an id and negative ids too; no file outlives its wave."""
    from maildf.plans import details

    docs = [(i, "word é " * i, "s") for i in range(60)] + [(3, "same", "s"), (3, "same", "s"), (None, "none", "s"), (None, "none", "s"), (-5, "less", None), (100, None, "t")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made, folder = [], details._folder
    monkeypatch.setattr(details, "_folder", lambda s, name: made.append(folder(s, name)) or made[-1])
    monkeypatch.setattr(details, "WAVE", 4096, raising=False)
    run, sql = Q.REGISTRY["stored_attachments"]
    got = Counter(map(tuple, run(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(db.execute(sql).fetchall())
    files = [p for p in made if "maildf-eml-" in p or "maildf-files-" in p]
    assert len(files) > 4 and not any(names for p in files for _, _, names in os.walk(p.removeprefix("file://")))
