"""Deliveries of work: checks in order, repeats within a time to live, and one sink for each outcome.

Two routes. ``hub`` takes events with a delivery id, a signature and a JSON body; ``direct`` takes requests with an API key, an optional
idempotency key and a JSON body. A delivery's outcome is the first check that ends it. All checks but the one for repeats are
expressions; that one needs state: an id counts as seen from the moment at which a delivery of it was accepted until the time
to live is over, so refused and ignored deliveries may come again, and a repeat does not prolong it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quernstone.functions import answers, digests

#: Actions of issues that lead to work, the day that an id is remembered, and the largest direct request.
ISSUE_ACTIONS = ("opened", "reopened", "labeled", "edited")
TTL_SECONDS = 86_400
MOST_BYTES = 5 * 1024 * 1024

ITEM = "source: string, event_id: string, repository: string, issue_id: string, title: string, statement: string, base_commit: string, reproduction: string, hints: string, labels: array<string>, action: string, sender: string"
VERDICT = f"struct<key: string, early: boolean, status: int, reason: string, item: struct<{ITEM}>>"


def header(headers: Column, *names: str) -> Column:
    """The value of the first of the names that is there and not empty, whatever its case, trimmed; of equal names the last counts."""
    value = lambda name: F.trim(F.get(F.reverse(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)), F.lit(0))["value"])
    return F.coalesce(*[F.nullif(value(n), F.lit("")) for n in names], F.lit(""))


def _first(checks: list[tuple[Column, int, str]], status: int, reason: str) -> Column:
    """struct<status, reason> of the first check that holds; the last pair holds where none does."""
    out = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    for when, s, r in reversed(checks):
        out = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))).otherwise(out)
    return out


def _blank(x: Column) -> Column:
    return F.trim(x) == ""


def _item_checks(item: Column) -> list[tuple[Column, int, str]]:
    """What makes a work item unfit, in order."""
    return [
        (_blank(item["event_id"]), 422, "no event id"),
        (_blank(item["repository"]), 422, "no repository"),
        (_blank(item["title"]) & _blank(item["statement"]), 422, "no title or statement"),
        (item["repository"].contains(".."), 422, "repository leaves its folder"),
    ]


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once for each row: Spark copies an expression to all of its uses and into filters below, but not out of a generator."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*df.columns, one.alias("_one")).select(*df.columns, *[F.col("_one")[n].alias(n) for n in columns])


def _decided(df: DataFrame, early: list, later: list, key: Column, item: Column) -> DataFrame:
    """The verdict on each delivery that has not been seen before. Early checks come before the one for repeats."""
    both = df.withColumns({"_key": key, "_item": item})
    later = [*later, *_item_checks(F.col("_item"))]
    both = both.withColumns({"_early": _first(early, 0, ""), "_later": _first(later, 200, "accepted")})
    said = F.when(F.col("_early.status") > 0, F.col("_early")).otherwise(F.col("_later"))
    both = both.withColumns({"_said": said, "_ended": F.col("_early.status") > 0})
    kept = F.when(F.col("_said.reason") == "accepted", F.col("_item"))
    verdict = F.struct(F.nullif("_key", F.lit("")).alias("key"), F.col("_ended").alias("early"), "_said.status", "_said.reason", kept.alias("item"))
    # whether the state has a say is a column of its own: a filter on it does not carry the whole verdict along
    stateful = ~F.col("_ended") & (F.col("_key") != "")
    return both.withColumns({"verdict": verdict, "verdict_key": F.when(stateful, F.col("_key"))}).drop("_key", "_item", "_early", "_later", "_said", "_ended", "_v", "_event", "_delivery", "_signature")


def hub(df: DataFrame, secret: bytes = b"", require_signature: bool = True, commands: tuple[str, ...] = ("/repair", "/fix"), source: str = "hub", prefix: str = "x-hub") -> DataFrame:
    """df (headers map<string, string>, body) with the verdict on each row, and verdict_key, the id under which it may be a repeat.

    Order: event header, ping, delivery header, repeat, signature, JSON, then by event: issues need an action that leads to work; comments a new one that
    holds a command; other events are ignored. A body whose root is no object counts as malformed."""
    event, delivery, signature = (header(F.col("headers"), f"{prefix}-{n}") for n in ("event", "delivery", "signature-256"))
    df = _once(df, _event=event, _delivery=delivery, _signature=signature, _v=F.try_parse_json(F.when(F.is_valid_utf8(F.col("body").cast("string")), F.col("body").cast("string"))))
    event, delivery, signature, v = map(F.col, ("_event", "_delivery", "_signature", "_v"))
    action, comment = _text(v, "$.action"), _text(v, "$.comment.body")
    number, body = _text(v, "$.issue.number"), _text(v, "$.issue.body")
    names = F.transform(F.filter(F.try_variant_get(v, "$.issue.labels", "array<variant>"), _is_object), lambda x: _text(x, "$.name"))
    repository = F.coalesce(*[F.nullif(_text(v, f"$.repository.{n}"), F.lit("")) for n in ("full_name", "name")], F.lit(""))
    on_issue = event == "issues"
    statement = F.when(on_issue, body).otherwise(F.concat(body, F.lit("\n\nAdditional comment instruction:\n"), comment))
    item = F.struct(
        F.lit(source).alias("source"), delivery.alias("event_id"), repository.alias("repository"), F.when(on_issue & (number == ""), "").otherwise(F.concat(F.lit("GH-"), number)).alias("issue_id"), _text(v, "$.issue.title").alias("title"), statement.alias("statement"),
        F.coalesce(F.try_variant_get(v, "$.repository.default_branch", "string"), F.lit("main")).alias("base_commit"), F.when(on_issue, answers.reproduction_command(body)).otherwise("").alias("reproduction"), F.lit("").alias("hints"),
        F.coalesce(names, F.array().cast("array<string>")).alias("labels"), action.alias("action"), F.when(on_issue, _text(v, "$.sender.login")).otherwise(_text(v, "$.comment.user.login")).alias("sender"),
    )
    commanded = F.lit(False)
    for c in commands:
        commanded = commanded | F.lower(comment).contains(c)
    on_comment = event == "issue_comment"
    early = [(event == "", 400, "no event"), (event == "ping", 200, "ping"), (delivery == "", 400, "no delivery id")]
    later = [
        (~digests.signed(F.col("body"), signature, secret) if secret else F.lit(require_signature), 401, "bad signature" if secret else "no secret"),
        (v.isNull() | ~_is_object(v), 400, "malformed body"),
        (~on_issue & ~on_comment, 200, "event ignored"),
        (on_issue & ~action.isin(*ISSUE_ACTIONS), 200, "action ignored"),
        (on_comment & (action != "created"), 200, "comment ignored"),
        (on_comment & ~commanded, 200, "no command"),
    ]
    return _decided(df, early, later, delivery, item)


def direct(df: DataFrame, api_key: str = "", require_auth: bool = True, most_bytes: int = MOST_BYTES, source: str = "direct") -> DataFrame:
    """df (headers map<string, string>, body) with the verdict on each row, and verdict_key, the id under which it may be a repeat.

    Order: size, key of the service, key of the request, repeat, JSON, shape, repository, fields. A request without an idempotency key is never
    a repeat; its event id comes from its body and headers, so that a retried batch gives the same. JSON nulls are empty fields."""
    h = F.col("headers")
    bearer, given = header(h, "authorization"), header(h, "x-api-key")
    given = F.when(F.lower(bearer).startswith("bearer "), F.trim(F.substr(bearer, F.lit(8)))).otherwise(given)
    key = header(h, "idempotency-key", "x-idempotency-key")
    df = df.withColumn("_v", F.try_parse_json(F.when(F.is_valid_utf8(F.col("body").cast("string")), F.col("body").cast("string"))))
    v = F.col("_v")
    field = lambda name: F.trim(_text(v, f"$.{name}"))
    one = F.nullif(_text(v, "$.labels"), F.lit(""))
    labels = F.coalesce(F.transform(F.try_variant_get(v, "$.labels", "array<variant>"), lambda x: F.trim(_text(x, "$"))), F.when(one.isNotNull(), F.array(F.trim(one))), F.array().cast("array<string>"))
    made = F.concat(F.lit("direct-"), F.substring(F.sha2(F.concat_ws("\n", F.col("body").cast("string"), F.to_json("headers")), 256), 1, 12))
    item = F.struct(
        F.lit(source).alias("source"), F.when(key != "", key).otherwise(made).alias("event_id"), *[field(n).alias(n) for n in ("repository", "issue_id", "title")], field("problem_statement").alias("statement"), field("base_commit").alias("base_commit"),
        field("reproduction_test").alias("reproduction"), field("hints_text").alias("hints"), F.filter(labels, lambda x: x != "").alias("labels"), F.lit("").alias("action"), F.lit("").alias("sender"),
    )
    early = [(F.octet_length("body") > most_bytes, 413, "too large")]
    if require_auth:
        early += [(F.lit(not api_key), 500, "no key of the service"), (given != api_key, 401, "unauthorized")]
    later = [(v.isNull(), 400, "malformed body"), (~_is_object(v), 400, "not an object"), (field("repository").contains(".."), 422, "repository leaves its folder")]
    return _decided(df, early, later, key, item)


def _recorded(ttl_seconds: int):
    """The state of an id: the moment of the delivery that counts. A timer drops it a second after the time to live, by the wall clock; whether a
    delivery is a repeat is decided by the deliveries' own clock: it is one up to and including the time to live."""
    ttl = ttl_seconds * 1_000_000

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
        at = before = state.get[0] if state.exists else None
        again = []
        for now, accepted in zip(rows["at"].tolist(), rows["accepted"].tolist()):
            again.append(at is not None and now - at <= ttl)
            if accepted and not again[-1]:
                at = now
        if at != before:
            state.update((at,))
        if state.exists:
            state.setTimeoutDuration((ttl_seconds + 1) * 1000)
        yield rows[["seq", "at", "said"]].assign(again=again)

    return run


def once_each(decided: DataFrame, arrived: str, seq: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """seq, at (microseconds) and verdict of a stream of decided deliveries, repeats marked as such. ``arrived`` is the clock; equal moments go by ``seq``.

    Rows that never look at the state (early outcomes, no key) pass by it. The others carry their verdict through it as one text, which
    costs Python less than nested values. A micro-batch's deliveries of one id are sorted in memory."""
    s = decided.select(F.col(seq).cast("long").alias("seq"), F.unix_micros(F.col(arrived).cast("timestamp")).alias("at"), "verdict", F.col("verdict_key").alias("id"))
    keyed = s.where("id IS NOT NULL").select("seq", "at", "id", (F.col("verdict.reason") == "accepted").alias("accepted"), F.to_json("verdict").alias("said"))
    seen = keyed.groupBy("id").applyInPandasWithState(_recorded(ttl_seconds), "seq long, at long, said string, again boolean", "at long", "append", "ProcessingTimeTimeout")
    said = F.from_json("said", VERDICT, {"maxStringLen": str(2**31 - 1)})
    repeat = F.struct(said["key"].alias("key"), F.lit(False).alias("early"), F.lit(200).alias("status"), F.lit("duplicate").alias("reason"), F.lit(None).cast(f"struct<{ITEM}>").alias("item"))
    seen = seen.select("seq", "at", F.when(F.col("again"), repeat).otherwise(said).alias("verdict"))
    return s.where("id IS NULL").drop("id").unionByName(seen)


def sink_of(verdict: Column) -> Column:
    return F.when(verdict["reason"] == "accepted", "accepted").when(verdict["reason"] == "duplicate", "repeated").when(verdict["status"] >= 400, "refused").otherwise("ignored")


def settle(stream: DataFrame, path: str) -> None:
    """Takes what the stream has and adds it below path, a folder for each sink within a folder for each batch. A batch that is run again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("sink", sink_of(F.col("verdict"))).write.partitionBy("sink").mode("overwrite").parquet(f"{path}/rows/batch={number}")

    # timers never come to an end of their own: one batch takes all that is there
    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(once=True).foreachBatch(put).start().awaitTermination()


def settled(spark: SparkSession, path: str, sink: str | None = None) -> DataFrame:
    """seq, at, verdict, batch and sink of what has been settled below path; of one sink, only its folders are read."""
    df = spark.read.option("basePath", f"{path}/rows").schema(f"seq long, at long, verdict {VERDICT}, batch long, sink string").parquet(f"{path}/rows")
    return df if sink is None else df.where(F.col("sink") == sink)
