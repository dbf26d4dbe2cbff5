"""Deliveries: checks in order, repeats by the deliveries' own clock, one sink for each outcome."""

import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quernstone.functions import digests
from quernstone.streaming import deliveries as D

SECRET = b"a secret"
T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
GOOD = {"action": "opened", "issue": {"number": 7, "title": "t", "body": "run `python -m pytest a.py`", "labels": [{"name": "bug"}, "x", {}]}, "repository": {"full_name": "o/r"}, "sender": {"login": "me"}}
COMMENT = {"action": "created", "comment": {"body": "please /FIX", "user": {"login": "you"}}, "issue": {"number": 8, "title": "t", "body": None}, "repository": {"name": "r", "default_branch": "dev"}}


def sign(body):
    return "sha256=" + hmac.new(SECRET, body.encode(), hashlib.sha256).hexdigest()


def hub_row(body, event="issues", delivery="d", signature=None, **more):
    body = body if isinstance(body, str) else json.dumps(body)
    return ({"X-Hub-EVENT": event, "x-hub-delivery": delivery, "X-Hub-Signature-256": sign(body) if signature is None else signature} | more, body)


def said(df):
    return [(r.verdict.status, r.verdict.reason) for r in df.orderBy("n").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, h, b) for i, (h, b) in enumerate(rows)], "n int, headers map<string, string>, body string")


@pytest.mark.parametrize("secret", [b"k", b"x" * 64, b"y" * 100, b"\x00\xff"])
def test_hmac(spark, secret):
    texts = ["", "a", "é" * 500]
    got = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(digests.hmac_sha256(F.col("t"), secret).alias("h")).collect()]
    assert got == [hmac.new(secret, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_hub_checks_in_order(spark):
    change = lambda **x: {**GOOD, **x}
    rows = [
        (hub_row(GOOD), (200, "accepted")),
        (hub_row("{", event=" "), (400, "no event")),
        (hub_row("{", event="ping", delivery=""), (200, "ping")),
        (hub_row("{", delivery=""), (400, "no delivery id")),
        (hub_row("{", signature="sha256=00"), (401, "bad signature")),
        (hub_row(GOOD, signature=""), (401, "bad signature")),
        (hub_row("{"), (400, "malformed body")),
        (hub_row("[1]"), (400, "malformed body")),
        (hub_row("null"), (400, "malformed body")),
        (hub_row(GOOD, event="push"), (200, "event ignored")),
        (hub_row(change(action="closed")), (200, "action ignored")),
        (hub_row(change(repository={})), (422, "no repository")),
        (hub_row(change(repository={"name": "../r"})), (422, "repository leaves its folder")),
        (hub_row(change(issue={"title": " ", "body": ""})), (422, "no title or statement")),
        (hub_row(COMMENT, event="issue_comment"), (200, "accepted")),
        (hub_row({**COMMENT, "action": "edited"}, event="issue_comment"), (200, "comment ignored")),
        (hub_row({**COMMENT, "comment": {"body": "nice"}}, event="issue_comment"), (200, "no command")),
    ]
    df = frame(spark, [r for r, _ in rows])
    out = D.hub(df, SECRET)
    assert said(out) == [w for _, w in rows]
    item = {r.n: r.verdict.item for r in out.collect()}
    assert (item[0].issue_id, item[0].reproduction, item[0].labels, item[0].base_commit, item[0].sender) == ("GH-7", "python -m pytest a.py", ["bug", ""], "main", "me")
    assert (item[14].issue_id, item[14].statement, item[14].base_commit, item[14].sender) == ("GH-8", "\n\nAdditional comment instruction:\nplease /FIX", "dev", "you")
    assert item[4] is None
    assert said(D.hub(df.limit(1), b"")) == [(401, "no secret")] and said(D.hub(df.limit(1), b"", False)) == [(200, "accepted")]


def test_direct_checks_in_order(spark):
    ok = {"Authorization": "BEARER k"}
    body = {"repository": "o/r", "problem_statement": " broken ", "labels": ["a", " ", 3], "metadata": 1}
    rows = [
        ((ok, json.dumps(body)), (200, "accepted")),
        ((ok, "x" * 200), (413, "too large")),
        (({}, "{}"), (401, "unauthorized")),
        (({"x-API-key": "k", "Idempotency-Key": " i "}, json.dumps(body | {"labels": "one"})), (200, "accepted")),
        (({"x-api-key": "other"}, "{}"), (401, "unauthorized")),
        ((ok, "{"), (400, "malformed body")),
        ((ok, "[]"), (400, "not an object")),
        ((ok, '{"repository": "a/../b"}'), (422, "repository leaves its folder")),
        ((ok, '{"repository": "r"}'), (422, "no title or statement")),
        ((ok, '{"title": "t"}'), (422, "no repository")),
        ((ok, None), (400, "malformed body")),
        ((None, "{}"), (401, "unauthorized")),
    ]
    out = D.direct(frame(spark, [r for r, _ in rows]), "k", most_bytes=150)
    assert said(out) == [w for _, w in rows]
    item = {r.n: (r.verdict.key, r.verdict.item) for r in out.collect()}
    assert item[0][0] is None and item[0][1].event_id.startswith("direct-") and item[0][1].labels == ["a", "3"] and item[0][1].statement == "broken"
    assert item[3][0] == "i" and item[3][1].event_id == "i" and item[3][1].labels == ["one"]
    assert said(D.direct(frame(spark, [rows[0][0]]), "")) == [(500, "no key of the service")]


def test_repeats_over_batches(spark, tmp_path):
    """The clock is the deliveries' own: at the limit a delivery is a repeat, a microsecond later it counts; what was refused may come again."""
    ttl = 3600
    us = dt.timedelta(microseconds=1)
    hour = dt.timedelta(seconds=ttl)
    good, bad = hub_row(GOOD), hub_row("{")
    other = hub_row(GOOD, delivery="e")
    batches = [
        [(1, T0, bad), (2, T0 + us, good), (3, T0 + 2 * us, good), (4, T0, other)],
        [(5, T0 + us + hour, good), (6, T0 + 2 * us + hour, good), (7, T0 + 3 * us + hour, bad)],
        [(8, T0 + 2 * us + hour + hour, good), (9, T0 + 3 * us + hour + hour, bad), (10, T0 + 4 * us + hour + hour, good), (11, T0, hub_row("{", event="ping"))],
    ]
    want = {1: "malformed body", 2: "accepted", 3: "duplicate", 4: "accepted", 5: "duplicate", 6: "accepted", 7: "duplicate", 8: "duplicate", 9: "malformed body", 10: "accepted", 11: "ping"}
    schema = "seq long, at timestamp, headers map<string, string>, body string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame([(n, t, h, b) for n, t, (h, b) in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = D.hub(spark.readStream.schema(schema).parquet(source), SECRET)
        D.settle(D.once_each(stream, "at", "seq", ttl), out)
    D.settle(D.once_each(D.hub(spark.readStream.schema(schema).parquet(source), SECRET), "at", "seq", ttl), out)  # nothing new
    rows = D.settled(spark, out).collect()
    assert {r.seq: r.verdict.reason for r in rows} == want and len(rows) == len(want)
    assert {r.sink for r in rows} == {"accepted", "repeated", "refused", "ignored"}
    assert {r.seq for r in D.settled(spark, out, "accepted").collect()} == {2, 4, 6, 10}
    assert "PartitionFilters: [isnotnull(sink" in D.settled(spark, out, "accepted")._jdf.queryExecution().toString()


def test_verdicts_keep_their_texts_through_the_state(spark, tmp_path):
    """The state's step sees a flag and one text, no nested values, and gives back every character and empty list."""
    ttl = 3600
    odd = {**GOOD, "issue": {"number": 1, "title": ' "q"\\ ', "body": "a\n\t\u2028\u0001é😀" + "x" * 100_000, "labels": []}}
    schema = "seq long, at timestamp, headers map<string, string>, body string"
    rows = [(n, T0 + dt.timedelta(seconds=n), *hub_row(b, delivery=f"d{n}")) for n, b in enumerate((odd, GOOD, "{"))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(source)
    stream = D.once_each(D.hub(spark.readStream.schema(schema).parquet(source), SECRET), "at", "seq", ttl)
    step = next(x for x in str(stream._jdf.queryExecution().analyzed()).split("\n") if "FlatMapGroupsInPandasWithState" in x)
    assert "said" in step and "verdict" not in step
    D.settle(stream, out)
    want = {r.seq: r.verdict for r in D.hub(df, SECRET).collect()}
    assert {r.seq: r.verdict for r in D.settled(spark, out).collect()} == want and want[0].item.labels == [] and want[2].item is None
