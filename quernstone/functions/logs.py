"""Column functions over raw logs: failures, tracebacks, sentinels, commits and blame, and what a text asks of an interface. All stay in the JVM.

A null text counts as an empty one. What is not found is the empty string or an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T

#: The start of a traceback, the mark of a probe's line, and the patterns of an interface's terms.
TRACEBACK = "Traceback (most recent call last):"
SENTINEL = r"__PF_PROBE__:([a-zA-Z0-9_\-]+):(.*)"
ASSIGNED = r"`?\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(True|False|None|'[^']*'|\"[^\"]*\"|[0-9]+)\b`?"
HINTED = r"(?i)\b(?:parameter|argument|option|flag)\s+`?([a-zA-Z_][a-zA-Z0-9_]*)`?|\b`?([a-zA-Z_][a-zA-Z0-9_]*)`?\s+(?:parameter|argument|keyword argument|kwarg)\b"
CALLED = r"([A-Za-z_][A-Za-z0-9_\.]*)\s*\([^)]*?\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*([^,\)\s]+)[^)]*?\)"
CATCHES = r"(?i)(?:catch|handle|intercept|trap)\s+([A-Za-z_][A-Za-z0-9_\.]*(?:Error|Exception))"
REJECTS = r"(?i)\b(?:rather than|instead of|don't use|do not use|avoid|replace)\s+`?([a-zA-Z_][a-zA-Z0-9_]*)\b"
RAISES = r"(?i)(?:raise|throw|wrap in|convert to)\s+([A-Za-z_][A-Za-z0-9_\.]*(?:Error|Exception))"
#: Words that are no parameter: of prose and code, then the language's own.
NO_PARAMETERS = (
    "python", "to", "code1", "code", "args", "file", "self", "line",
    "host", "port", "timeout", "data", "amt", "version", "path",
    "true", "false", "none", "kwargs", "var", "test", "tests", "name",
    "value", "key", "result", "expected", "actual", "obj", "item",
    "cls", "the", "this", "that", "an", "a", "return", "def", "class",
)
KEYWORDS = ("False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def raw_lines(text: Column) -> Column:
    return F.split(_text(text), r"\r\n|[\n\r]")


def inspected(log: Column, most: int = 30, least: int = 20) -> Column:
    """struct<failing, traceback>: the lines of failed and broken tests, and the first ``most`` lines of tracebacks: one ends at
    a line of its error, or at a blank line once ``least`` lines are there."""
    lines = raw_lines(log)
    failing = F.transform(F.filter(lines, lambda x: x.contains("FAILED ") | x.contains("ERROR ")), lambda x: F.trim(x, F.lit(" \t")))
    zero = F.struct(F.lit(False).alias("on"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        on = a["on"] | x.contains(TRACEBACK)
        n = a["n"] + F.when(on, 1).otherwise(0)
        ends = x.startswith("E   ") | ((n > least) & (F.trim(x, F.lit(" \t")) == ""))
        return F.struct((on & ~ends).alias("on"), n.alias("n"), F.when(on & (a["n"] < most), F.array_append(a["kept"], x)).otherwise(a["kept"]).alias("kept"))

    return F.struct(failing.alias("failing"), F.array_join(F.aggregate(lines, zero, step)["kept"], "\n").alias("traceback"))


def details(log: Column, test: Column) -> Column:
    """struct<error_type, error_message, diff, locus> of one test's failure: its block below an underscored title or a FAILED
    line, else the text from its name on, else the whole log where it shows an error at all."""
    log, name = _text(log), F.substring_index(_text(test), "::", -1)
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    title = F.concat(F.lit(r"(?i)(?:_{2,}\s+(?:[\w\.]+\.)?"), quoted, F.lit(r"\s+_{2,}|FAIL(?:ED)?\s+.*?"), quoted, F.lit(r")([\s\S]*?)(?=(?:_{2,}\s+[\w\.]+\s+_{2,}|={3,}\s+short test summary info|={3,}\s+FAILURES|\z))"))
    block = F.call_function("regexp_extract", log, title, F.lit(1))
    at = F.call_function("locate", name, log)
    rest = F.when((at > 0) & (name != ""), F.substr(log, at, F.lit(2000))).when(log.contains("AssertionError") | log.contains("\nE ") | log.startswith("E "), log).otherwise("")
    body = once(block, lambda b: F.when(name == "", "").when(b != "", b).otherwise(rest))
    return once(body, _of_body)


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of_body(body: Column) -> Column:
    errors = F.filter(F.transform(raw_lines(body), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x.startswith("E "))
    errors = F.transform(errors, lambda x: F.trim(F.substr(x, F.lit(3)), F.lit(" \t")))
    frame = r"([a-zA-Z0-9_\-\.\/]+\.py):(\d+):\s*(.*)"
    frames = F.zip_with(F.regexp_extract_all(body, F.lit(frame), F.lit(1)), F.regexp_extract_all(body, F.lit(frame), F.lit(2)), lambda f, n: F.struct(f.alias("f"), n.alias("n")))
    return once(F.struct(errors.alias("errors"), frames.alias("frames")), lambda x: _of_parts(body, x["errors"], x["frames"]))


def _of_parts(body: Column, errors: Column, frames: Column) -> Column:
    first = F.coalesce(F.get(errors, F.lit(0)), F.lit(""))
    head = F.regexp_extract(first, r"^([^ :]*):", 1)
    typed = first.rlike(r"^[^ :]*:")
    plain_type, plain_text = (F.regexp_extract(body, r"([A-Za-z_][A-Za-z0-9_]*Error|Exception):\s*(.*)", i) for i in (1, 2))
    kind = F.when(F.size(errors) == 0, plain_type).when(typed, head).otherwise(F.when(first.contains("assert"), "AssertionError").otherwise("Error"))
    message = F.when(F.size(errors) == 0, F.trim(plain_text)).when(typed, F.trim(F.regexp_replace(first, r"^[^ :]*:", ""))).otherwise(first)
    diff = F.slice(F.filter(errors, lambda x: x.rlike(r"^(?:[-+]|where)")), 1, 4)
    own = F.filter(frames, lambda x: ~x["f"].startswith("/opt") & ~x["f"].contains("site-packages") & ~x["f"].rlike(r"(?:^|/)test"))
    chosen = F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at(frames, F.lit(-1)))
    locus = F.coalesce(F.concat_ws(":", chosen["f"], chosen["n"]), F.lit(""))
    return F.struct(kind.alias("error_type"), message.alias("error_message"), F.array_join(diff, "\n").alias("diff"), F.when(chosen.isNull(), "").otherwise(locus).alias("locus"))


def sentinels(logs: DataFrame, case: str, log: str, pattern: str = SENTINEL) -> DataFrame:
    """case, probe, and of its lines the last value, their number, the first line and the error that the first one tells."""
    lines = logs.select(case, F.posexplode(raw_lines(F.col(log))).alias("at", "line")).where(F.col("line").rlike(pattern))
    value = F.trim(F.regexp_extract("line", pattern, 2))
    rows = lines.select(case, "at", F.trim("line").alias("line"), F.regexp_extract("line", pattern, 1).alias("probe"), value.alias("value"))
    g = rows.groupBy(case, "probe").agg(F.max_by("value", "at").alias("observed"), F.count("*").alias("hits"), F.min_by("line", "at").alias("first_raw"), F.min_by("value", "at").alias("v"))
    return g.select(case, "probe", "observed", "hits", "first_raw", F.when(F.col("v").startswith("ERR:"), F.expr("substring(v, 5)")).alias("exception"))


def commits(log: Column) -> Column:
    """array<struct<hash, author, date, ts, message, is_fix, files>> of a log of COMMIT|hash|author|date|seconds|subject headers
    and file names; a header without five fields is none, seconds that are no number count as 0, only sources count as files."""
    blocks = F.filter(F.split(_text(log), r"COMMIT\|"), lambda b: F.trim(b, F.lit(" \t\r\n")) != "")
    rows = F.transform(blocks, lambda b: F.transform(raw_lines(F.trim(b, F.lit(" \t\r\n"))), lambda x: x))

    def one(lines):
        h = F.split(F.get(lines, F.lit(0)), r"\|")
        files = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1)), lambda x: F.translate(F.trim(x, F.lit(" \t")), "\\", "/")), lambda x: x.endswith(".py"))
        message = F.get(h, F.lit(4))
        return F.struct(
            F.get(h, F.lit(0)).alias("hash"), F.get(h, F.lit(1)).alias("author"), F.get(h, F.lit(2)).alias("date"), F.coalesce(F.get(h, F.lit(3)).try_cast("double"), F.lit(0.0)).alias("ts"),
            message.alias("message"), T.any_contains(F.lower(message), T.FIX_WORDS).alias("is_fix"), files.alias("files"), F.size(h).alias("fields"),
        )

    return F.filter(F.transform(rows, one), lambda c: c["fields"] >= 5)


def file_log(log: Column) -> Column:
    """array<struct<hash, author, date, message>> of hash|author|date|subject lines; the subject may hold bars."""
    parts = F.filter(F.transform(raw_lines(log), lambda x: F.split(x, r"\|", 4)), lambda p: F.size(p) == 4)
    return F.transform(parts, lambda p: F.struct(p[0].alias("hash"), p[1].alias("author"), p[2].alias("date"), p[3].alias("message")))


def blamed(logs: DataFrame, case: str, log: str) -> DataFrame:
    """case, place, hash, author, summary and content of each line of a porcelain blame: a header holds for the lines below it."""
    lines = logs.select(case, F.posexplode(raw_lines(F.col(log))).alias("at", "line"))
    code, x = F.col("line").startswith("\t"), F.col("line")
    head = ~code & ~x.startswith("author ") & ~x.startswith("summary ") & x.rlike(r"^\S{8,}\s+\d+\s+\d+")  # a commit and its line numbers, not a filename line
    w = Window.partitionBy(case).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda test, value: F.coalesce(F.last(F.when(test, value), ignorenulls=True).over(w), F.lit(""))
    out = lines.select(case, "at", code.alias("code"), F.expr("substring(line, 2)").alias("content"), last(head, F.regexp_extract("line", r"(\S+)", 1)).alias("hash"), last(x.startswith("author "), F.expr("substring(line, 8)")).alias("author"), last(x.startswith("summary "), F.expr("substring(line, 9)")).alias("summary"))
    return out.where("code").drop("code")


def contract_terms(problem: Column, hints: Column, target: Column, api: Column) -> Column:
    """struct<forbidden, parameters, handled, expected> of what a text asks of an interface; parameters only where ``api`` says that its signature is at issue:
    those set in the hints, those that prose names where the hints or the target's name back them, those of calls of the target."""
    problem, hints = _text(problem), _text(hints)
    text = F.concat(problem, F.lit("\n"), hints)
    every = lambda c, p, g=1: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    fit = lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~x.isin(*KEYWORDS) & ~F.lower(x).isin(*NO_PARAMETERS)
    forbidden = F.array_distinct(F.filter(F.transform(every(text, REJECTS), lambda x: F.lower(x)), fit))
    allowed = lambda x: fit(x) & ~F.array_contains(forbidden, F.lower(x))
    prose = F.zip_with(every(text, HINTED, 1), every(text, HINTED, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    backed = lambda x: ((hints != "") & hints.contains(x)) | ((_text(target) != "") & text.contains(_text(target)))
    calls = F.zip_with(every(text, CALLED, 1), every(text, CALLED, 2), lambda f, k: F.when((_text(target) != "") & f.contains(_text(target)), k))
    named = F.concat(F.filter(every(hints, ASSIGNED), allowed), F.filter(prose, lambda x: allowed(x) & backed(x)), F.filter(calls, lambda x: x.isNotNull() & allowed(x)))
    return F.struct(
        forbidden.alias("forbidden"), F.when(api, F.array_distinct(named)).otherwise(F.array().cast("array<string>")).alias("parameters"),
        F.array_distinct(every(text, CATCHES)).alias("handled"), F.array_distinct(every(text, RAISES)).alias("expected"),
    )
