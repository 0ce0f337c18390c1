"""Raw mail through parsing, lanes and scoring; streaming twins of batch jobs."""

from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopglass.operators import content, lanes, network
from hopglass.sources import mail, store, urls
from hopglass.streaming import feed, tracking

BEC = (b"Received: from edge (edge [203.0.113.44]) by mx.example.ac.in with ESMTPS; Tue, 4 Aug 2026 04:30:20 +0000\r\n"
       b"Received: from desk (desk [10.0.0.5]) by relay.sender.net with SMTP; Tue, 4 Aug 2026 04:30:00 +0000\r\n"
       b"From: \"Dr Rao\" <Rao@College.ac.in>\r\nReply-To: pay@else.example\r\nTo: Office <office@example.ac.in>, b@x.org\r\nReturn-Path: <rao@college.ac.in>\r\n"
       b"Subject: Re: =?utf-8?q?new_bank_details?=\r\nMessage-ID: <1@college.ac.in>\r\nMIME-Version: 1.0\r\n"
       b"Content-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nPlease use the new bank account details for payment. See http://bit.ly/x.\r\n"
       b"--q\r\nContent-Type: text/html\r\n\r\n<a href=\"https://evil.example/login\">https://college.ac.in/pay</a>\r\n"
       b"--q\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=\"run.pdf.exe\"\r\nContent-Transfer-Encoding: base64\r\n\r\nTVo=\r\n--q--\r\n")
PLAIN = (b"Received: from a.college.ac.in (a.college.ac.in [198.51.100.7]) by mx.example.ac.in with ESMTPS; Tue, 4 Aug 2026 05:00:00 +0000\r\n"
         b"From: Notices <notices@college.ac.in>\r\nTo: all@example.ac.in\r\nSubject: Library hours\r\nMessage-ID: <2@college.ac.in>\r\n\r\nThe library opens at nine.\r\n")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mail")
    (d / "1.eml").write_bytes(BEC)
    (d / "2.eml").write_bytes(PLAIN)
    return str(d)


def test_parse(spark, raw):
    m = {r.message_id: r for r in mail.parse_messages(mail.read_mail(spark, raw, "o1")).collect()}
    r = m["<1@college.ac.in>"]
    assert (r.from_display_name, r.from_addr, r.reply_to, r.return_path) == ("Dr Rao", "rao@college.ac.in", "pay@else.example", "rao@college.ac.in")
    assert r.to_addrs == ["office@example.ac.in", "b@x.org"] and r.subject == "Re: new bank details" and len(r.parts) == 1
    assert [h.name for h in r.headers[:2]] == ["Received", "Received"]


def test_urls_and_attachments(spark, raw):
    m = mail.parse_messages(mail.read_mail(spark, raw, "o1"))
    u = {r.url: r for r in urls.extract_urls(m).collect()}
    assert set(u) == {"https://evil.example/login", "http://bit.ly/x"}
    assert u["https://evil.example/login"].mismatched_anchor and u["http://bit.ly/x"].is_shortened
    a = mail.attachment_table(m).first()
    assert (a.filename, a.size_bytes) == ("run.pdf.exe", 2)


def empty(spark, ddl):
    return spark.createDataFrame([], ddl)


def test_messages_to_verdicts(spark, raw):
    intel = {"auth_results": empty(spark, "case_id string, mech string, domain string, result string"), "dns_policy": empty(spark, "domain string, p string, sp string, state string"),
             "ip_list": empty(spark, "kind string, ip string"), "ip_ranges": empty(spark, "kind string, lo bigint, hi bigint"),
             "domain_intel": spark.createDataFrame([("college.ac.in", date(2010, 1, 1), True, True, "ok", "ok")], "domain string, created_at date, has_mx boolean, has_a boolean, rdap_state string, dns_state string"),
             "host_ips": empty(spark, "host string, ip string, state string"), "breaches": empty(spark, "email string, name string, breach_date date, seq bigint"),
             "registrations": empty(spark, "email string, platform string, status string, source int, seq bigint"),
             "suffix_rules": empty(spark, "rule string, private boolean")}
    ctx = lanes.context(mail.read_mail(spark, raw, "o1"), intel, F.lit(date(2026, 8, 5)), 2026)
    evidence, verdicts = lanes.analyse(ctx)
    v = {r.subject: r for r in verdicts.join(ctx["messages"].select("case_id", "subject"), "case_id").collect()}
    bad, good = v["Re: new bank details"], v["Library hours"]
    fired = {c.signal for c in bad.contributions}
    assert {"forged_received_hop", "reply_to_domain_mismatch", "fake_reply", "payment_diversion_intent", "dangerous_attachment"} <= fired
    assert bad.band == "CRITICAL" and good.band == "BENIGN" and good.score == 0


def test_lane_can_be_replaced(spark):
    before = lanes.LANES["M5"]
    try:
        lanes.lane("M5")(lambda ctx: spark.createDataFrame([("x", "M5", "s", "CLEAR", 1.0, None)], "case_id string, analyzer string, signal string, status string, confidence double, detail string"))
        assert lanes.run_lanes({}, ["M5"]).count() == 1
    finally:
        lanes.LANES["M5"] = before


@pytest.mark.parametrize("body,signal,expected", [
    ("Your verification code is 482913. Do not share it.", "credential_harvest_intent", False),
    ("Reset your password. This link expires in 10 minutes.", "credential_harvest_intent", False),
    ("Your verification code is 12345. Please enter your password now.", "credential_harvest_intent", True),
    ("Your account has been suspended, verify your account now", "credential_harvest_intent", True),
    ("please buy some gift cards today", "gift_card_scam", True),
    ("urgеnt note", "obfuscated_text", True), ("plain note", "obfuscated_text", False)])
def test_content(spark, body, signal, expected):
    m = spark.createDataFrame([(1, "Note", None, "a@b.com", body, None, [])],
                              "case_id long, subject string, from_display_name string, from_addr string, body_text string, body_html string, link_domains array<string>")
    hit = content.content_lane(m).filter((F.col("signal") == signal) & (F.col("status") == "TRIGGERED")).count() > 0
    assert hit == expected


def test_long_text_is_read_to_the_end(spark):
    m = spark.createDataFrame([(1, "Note", None, "a@b.com", "word " * 50_000 + "please enter your password", None, [])],
                              "case_id long, subject string, from_display_name string, from_addr string, body_text string, body_html string, link_domains array<string>")
    assert content.classified(m).first().harvest


def test_same_bytes_are_one_case(spark, raw, tmp_path):
    m = mail.parse_messages(mail.read_mail(spark, raw, "o1"))
    twice = m.unionByName(m)
    plan = store.plan_upsert(twice, empty(spark, "owner string, sha256 string, case_id string, scorer_version string"), "1.10.0")
    assert plan.count() == 2 and {r.action for r in plan.collect()} == {"insert"}


def test_mail_stream_matches_batch(spark, raw, tmp_path):
    stream = mail.parse_messages(mail.read_mail(spark, raw, "o1", stream=True, max_files=1))
    q = feed.write_batches(stream.select("case_id", "from_addr"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    want = {r.case_id for r in mail.parse_messages(mail.read_mail(spark, raw, "o1")).collect()}
    assert {r.case_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_correlation_over_several_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = [[("o", 1, datetime(2024, 1, 1), "ip", "x")], [("o", 2, datetime(2024, 1, 2), "ip", "x"), ("o", 2, datetime(2024, 1, 2), "url", "y")], [("o", 3, datetime(2024, 1, 3), "url", "y"), ("p", 9, datetime(2024, 1, 3), "ip", "x")]]
    ddl = "owner string, case_id long, arrival timestamp, kind string, value string"
    for part in rows:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))
    feed.correlation_stream(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.owner, r.case_id): r.related_cases for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sum(got.values()) == 2 and got[("p", 9)] == 0


def test_retry_limits(spark):
    rows = [("a", "transient")] * 4 + [("b", "transient")] * 5 + [("c", "fatal")] + [("d", "transient"), ("d", "ok")]
    got = {r.msg_id: r.action for r in tracking.retry_plan(spark.createDataFrame(rows, "msg_id string, outcome string")).collect()}
    assert got == {"a": "retry", "b": "dead_letter", "c": "dead_letter", "d": "done"}


POISON = [b"Subject: =?utf-8?b?a?=\r\n\r\nx", b"Message-ID: <\xff@x>\r\nReturn-Path: <\xfe@y>\r\n\r\nx", b"Content-Type: text/plain; charset=idna\r\n\r\n\xff\xfe..a", b"Content-Type: text/plain; charset=\"a\0b\"\r\n\r\nx",
          b"From: =?x?q?=FF?= <a@b.c>\r\nDate: never\r\n\r\n\xff"]


def test_hostile_messages_end_no_job(spark):
    from hopglass.sources import mail

    rows = [("o", f"m/{i}", None, raw) for i, raw in enumerate(POISON)]
    df = spark.createDataFrame(rows, "owner string, path string, received_at timestamp, raw binary")
    parsed = mail.parse_messages(df)
    got = parsed.collect()
    assert len(got) == len(POISON) and all(r["case_id"] and r["body_text"] is not None for r in got)
    failed = {r["case_id"] for r in mail.parse_failures(parsed).collect()}
    assert failed == {r["case_id"] for r in got if r["parse_error"]}


def test_a_message_that_cannot_be_decoded_stays_as_an_error_row(spark, monkeypatch):
    from hopglass.sources import mail

    assert mail._decode(None)["parse_error"].startswith("TypeError") and mail._decode(None)["headers"] == []


def test_decoding_takes_bounded_steps():
    rows = pa.RecordBatch.from_pydict({"raw": pa.array([b"x" * n for n in (10, mail.STEP_BYTES, 5, 5)] + [None] + [b""] * (mail.STEP_ROWS + 1), pa.binary()), "i": list(range(5 + mail.STEP_ROWS + 1))})
    got = [s.column("i").to_pylist() for s in mail.bounded(rows, "raw")]
    assert [len(s) for s in got] == [1, 1, mail.STEP_ROWS, 4] and sum(got, []) == rows.column("i").to_pylist()
    assert list(mail.bounded(rows.slice(0, 0), "raw")) == []


def test_a_batch_of_several_steps_gives_every_message(spark):
    raw = spark.range(1100).selectExpr("'o' as owner", "string(id) as path", "timestamp_seconds(id) as received_at", "cast(concat('Subject: s', id, '\r\nDate: Tue, 4 Aug 2026 10:00:00 +0530\r\n\r\n', repeat('b', int(id))) as binary) as raw")
    got = mail.parse_messages(raw.coalesce(1)).orderBy("arrival").select("subject", F.length("body_text").alias("n"), F.unix_timestamp("arrival").alias("at"), F.unix_timestamp("sent_at").alias("sent")).collect()
    assert [tuple(r) for r in got] == [(f"s{i}", i, i, 1785817800) for i in range(1100)]


def test_written_messages_are_files_of_one_folder(spark, tmp_path):
    rows = [("m/1", b"Subject: a\r\n\r\none"), ("m/1", b"Subject: a\r\n\r\none"), ("m/2", "Subject: \u00fc\r\n\r\ntwo\nlines".encode()), (None, None)]
    mail.write_mail(spark.createDataFrame(rows, "path string, raw binary").coalesce(1), f"{tmp_path}/mail")
    back = mail.read_mail(spark, f"{tmp_path}/mail", "o").collect()
    assert sorted(bytes(r["raw"]) for r in back) == sorted([rows[0][1] + b"\n" + rows[0][1] + b"\n", rows[2][1] + b"\n", b"\n"])
    assert {r["path"].rsplit("/", 1)[0].removeprefix("file:") for r in back} == {f"{tmp_path}/mail"}


def test_mounted_folders_take_files_from_the_tasks_themselves(spark, tmp_path):
    rows = [("m/1", b"Subject: a\r\n\r\none"), ("m/1", b"Subject: a\r\n\r\none"), ("m/2", "Subject: \u00fc\r\n\r\ntwo\nlines".encode() + b"\xff"), (None, None)]
    tasks = mail.write_mail(spark.createDataFrame(rows, "path string, raw binary"), f"file:{tmp_path}/mail")
    back = mail.read_mail(spark, f"file:{tmp_path}/mail", "o", tasks=tasks).collect()
    assert tasks == 1 and sorted(bytes(r["raw"]) for r in back) == sorted([rows[0][1] + b"\n" + rows[0][1] + b"\n", rows[2][1] + b"\n", b"\n"])
    names = [f.name for f in (tmp_path / "mail").iterdir()]  # no part files, checksums or marks of Spark's writers, for each of which processes are started
    assert len(names) == 3 and all(n.endswith(".eml") and not n.startswith(".") for n in names)
    with pytest.raises(FileExistsError):
        mail.write_mail(spark.createDataFrame(rows, "path string, raw binary"), f"file:{tmp_path}/mail")


def test_many_small_messages_are_read_by_few_tasks(spark, tmp_path):
    raw = spark.range(1100).selectExpr("concat('m/', id) as path", "cast(concat('Subject: s', id, '\r\n\r\nx') as binary) as raw")
    tasks = mail.write_mail(raw, f"file://{tmp_path}/mail")
    back = mail.read_mail(spark, f"file://{tmp_path}/mail", "o", tasks=tasks)
    assert tasks == 3 and back.rdd.getNumPartitions() == 3
    assert {r["subject"] for r in mail.parse_messages(back).select("subject").collect()} == {f"s{i}" for i in range(1100)}


def test_no_messages_give_an_empty_folder(spark, tmp_path):
    mail.write_mail(spark.createDataFrame([], "path string, raw binary"), f"file:{tmp_path}/mail")
    assert mail.read_mail(spark, f"file:{tmp_path}/mail", "o").count() == 0


def test_large_files_come_in_pieces(spark, tmp_path):
    files = {"a b%20c.eml": bytes(range(256)) * 5, "small.eml": b"x" * 100, "exact.eml": b"y" * 200}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = mail.read_mail(spark, str(tmp_path), "o", piece=100).orderBy("path", "start").collect()
    got = {}
    for r in rows:
        name = r["path"].rsplit("/", 1)[1]
        assert r["owner"] == "o" and r["received_at"] is not None and r["start"] == len(got.get(name, b"")) and len(r["raw"]) <= 100
        got[name] = got.get(name, b"") + bytes(r["raw"])
    assert got == files and len(rows) == 13 + 1 + 2


def test_files_beyond_two_gigabytes_are_read(spark, tmp_path):
    from hopglass.plans import load_all
    from hopglass.plans.registry import QUERIES

    load_all()
    (tmp_path / "small.parquet").write_bytes(b"x" * 10)
    with open(tmp_path / "large.parquet", "wb") as f:
        f.truncate((2 << 30) + 5)  # a hole: it takes no disk
    got = {r["file"]: r["size_bytes"] for r in QUERIES["s01_read_mail"](spark, str(tmp_path)).collect()}
    assert got == {"small.parquet": 10, "large.parquet": (2 << 30) + 5}
    assert mail.read_mail(spark, f"{tmp_path}/*.parquet", "o", piece=mail.PIECE_BYTES).rdd.getNumPartitions() >= 64
