import hashlib
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.plans import templates
from tallyforge.sources import files
from tallyforge.streaming import events as streams

BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def events(spark):
    rows = [(i, BEGIN + timedelta(minutes=(i * 37) % 600), i % 3, "a" if i % 2 else "b", float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")


def test_stream_equals_batch(spark, events, tmp_path):
    events.write.parquet(f"{tmp_path}/in")
    far = spark.createDataFrame([(999, BEGIN + timedelta(days=9), 9, "z", 0.0)], events.schema)
    far.write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in", events.schema)
    for name, build in (("w", lambda x: streams.tumbling_frame(x, "1 hour", ["event_type"])), ("s", lambda x: streams.session_frame(x, "30 minutes", ["user_id"]))):
        streams.drain(build(stream), f"{tmp_path}/{name}", f"{tmp_path}/{name}-ck")
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
        assert got == {tuple(r) for r in build(events).collect()}
    streams.drain(streams.once_frame(stream, "event_id"), f"{tmp_path}/o", f"{tmp_path}/o-ck")
    streams.drain(streams.once_frame(stream, "event_id"), f"{tmp_path}/o", f"{tmp_path}/o-ck")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 61


def plain_walk(rows, limit, window):
    """Admissions by walking all events in order."""
    logs, out = {}, {}
    for event_id, at, user in sorted(rows, key=lambda r: (r[1], r[0])):
        log = [x for x in logs.get(user, []) if x > at - window]
        out[event_id] = len(log) < limit
        logs[user] = [*log, at] if out[event_id] else log
    return out


def test_limiter(spark, events, tmp_path):
    rows = [(r.event_id, r.ts.timestamp(), r.user_id) for r in events.collect()]
    want = plain_walk(rows, 2, 3600.0)
    assert {r.event_id: r.allowed for r in streams.limited(events, 2, 3600.0).collect()} == want and not all(want.values())
    assert all(r.retry_after >= 1 for r in streams.limited(events, 2, 3600.0).where("not allowed").collect())
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.limited_stream(streams.read_stream(spark, f"{tmp_path}/in", events.schema), 2, 3600.0)
    streams.drain(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert {r.event_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    with pytest.raises(ValueError):
        streams.SlidingLog(0, 1)


def test_corrections_apply_once(spark):
    schema = "event_id string, valid_from timestamp, valid_to timestamp, amount int"
    current = spark.createDataFrame([("a", BEGIN, None, 1)], schema)
    fixes = spark.createDataFrame([("b", "a", BEGIN + timedelta(days=1), 2)], "event_id string, old_id string, valid_from timestamp, amount int")
    once = streams.apply_corrections(current, fixes)
    assert sorted((r.event_id, r.valid_to) for r in once.where("valid_to is not null").collect()) == [("a", BEGIN + timedelta(days=1))]
    assert sorted(map(tuple, streams.apply_corrections(once, fixes).fillna(0).collect()), key=str) == sorted(map(tuple, once.fillna(0).collect()), key=str)


MBOX = """From a@b Mon Jan  1 00:00:00 2024
From: Shop <x@swiggy.in>
Subject: Your order
Content-Type: text/html

<p>Order ID: 123</p><p>Thanks</p>

From c@d Tue Jan  2 00:00:00 2024
From: y@zomato.com
Subject: Bill
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=q

--q
Content-Type: text/plain

plain body
--q
Content-Type: application/pdf
Content-Disposition: attachment; filename=bill.pdf
Content-Transfer-Encoding: base64

JVBERi0xLjQK
--q--
"""


def test_mailbox(spark, tmp_path):
    (tmp_path / "a.mbox").write_text(MBOX)
    got = sorted(files.read_mailboxes(spark, f"{tmp_path}/a.mbox").collect(), key=lambda r: r.subject)
    assert [r.subject for r in got] == ["Bill", "Your order"]
    assert got[1].body == "Order ID: 123\nThanks" and got[0].body.strip() == "plain body"
    assert [(a.name, a.is_pdf, a.bytes) for a in got[0].attachments] == [("bill.pdf", True, 9)]


def test_mailbox_keeps_bytes(spark, tmp_path):
    """An 8-bit part is decoded by its own character set, and the id is of the file's bytes."""
    raw = "From: a@b.c\nSubject: x\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\nCaf\u00e9 cr\u00e8me".encode("iso-8859-1")
    (tmp_path / "b.mbox").write_bytes(b"From a@b.c Thu Jan  1 00:00:00 2024\n" + raw)
    row = files.read_mailboxes(spark, f"{tmp_path}/b.mbox").first()
    assert row.body == "Caf\u00e9 cr\u00e8me" and row.message_id == "msg_" + hashlib.sha256(raw).hexdigest()[:16]


def test_archive_digest_ignores_order(spark, tmp_path):
    frame = spark.range(50).withColumn("v", F.col("id") * 2)
    a = files.write_archive({"t": frame}, f"{tmp_path}/a")
    b = files.write_archive({"t": frame.orderBy(F.desc("id")).repartition(3)}, f"{tmp_path}/b")
    assert a == b and spark.read.json(f"{tmp_path}/a/manifest").first()["rows"] == 50


def test_strict_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": broken\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.raises(Exception):
        files.read_json_lines(spark, f"{tmp_path}/x.jsonl", schema).collect()


def test_vectors(spark, tmp_path):
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0]), (3, [float("nan"), 1.0])], "candidate_id int, embedding array<double>")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,)], "candidate_id int")
    assert {(r.candidate_id, r.fault) for r in files.embedding_faults(frame, wanted, 2).collect()} == {(2, "wrong_size"), (3, "not_a_number"), (4, "missing")}
    files.write_vectors(frame.where("candidate_id = 1"), f"{tmp_path}/v", (1, 2))
    assert {(r.candidate_id, r["size"], tuple(r.embedding)) for r in spark.read.parquet(f"{tmp_path}/v").collect()} == {(1, 1, (1.0,)), (1, 2, (0.6, 0.8))}


def test_answers(spark):
    sf = "/root/testdata/sf0.001"
    got = templates.answer_component_sum(spark, sf, "tax", "asia")
    assert got.status == "verified" and got.text.startswith("The evidence-backed tax total for Asia is INR ") and "term digest=" in got.calculation
    assert templates.answer_component_sum(spark, sf, "refund", "asia").reason == "no_graph_facts"
    assert templates.bind(spark, sf, "order_reconstruction", {"order_id": 0}).columns == ["orderkey", "relationship_type", "neighbour_id", "source_hash"]
    with pytest.raises(ValueError):
        templates.bind(spark, sf, "order_reconstruction", {"order_id": 1, "x": 2})
    prices = spark.createDataFrame([(1, Decimal("320"), "INR", "2022-01-05"), (2, Decimal("420"), "INR", "2025-01-05")], "orderkey int, amount decimal(18,2), currency string, occurred_on string")
    assert templates.answer_price_history(prices).calculation == "INR 420.00 - INR 320.00 = INR 100.00 (31.25%)"
    assert templates.answer_price_history(prices.limit(0)).status == "abstained"
