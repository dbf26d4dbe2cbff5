"""Column functions over answers, reports and test logs: sections, JSON bodies, edit blocks, outcomes. All stay in the JVM.

A null text counts as an empty one. What is not found is the empty string or an empty array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of a defect report, the first found wins.
REPORT_CLASSES = ("confirmed_code_defect", "behavioral_mismatch", "ambiguous", "documentation_issue", "test_only_issue")
#: Outcome lines, assertion, exception and symbol lines, the command in backticks, the markers of an edit.
FAILED_LINE = r"(?m)^[ \t]*(?:FAILED|ERROR)[ \t]+(.+?)[ \t]*$"
PASSED_LINE = r"(?m)^[ \t]*PASSED[ \t]+(.+?)[ \t]*$"
ASSERT_LINE = r"(?m)^\s*(?:[>E]\s+)?(assert\s+.+)$"
EXCEPTION_LINE = r"(?m)^E\s+([A-Za-z_][\w.]*?(?:Error|Exception|Failure))(?::\s*(.*))?$"
COMPARED = r"^(?:AssertionError:\s*)?(?:assert\s+)?(.+?)\s*==\s*(.+)"
SYMBOL_LINE = r"(?m)^\s*(?:function|class|method)\s*:\s*(\w+)"
COMMAND = r"`(pytest\s+[^`\n]+|python\s+-m\s+pytest\s+[^`\n]+)`"
EDIT = r"(?s)<<<<<<< SEARCH\n(.*?)\n=======\n(.*?)\n>>>>>>> REPLACE"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def section(text: Column, name: str, ends: tuple[str, ...] = ()) -> Column:
    """What follows the heading ``=== name ===`` up to the first heading of ``ends``, or to the end."""
    until = "|".join(f"=== {re.escape(e)} ===" for e in ends)
    body = rf"(.*?)(?:{until}|\z)" if ends else "(.*)"
    return _trimmed(F.regexp_extract(_text(text), rf"(?si)=== {re.escape(name)} ===\s*{body}", 1))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def listed(text: Column) -> Column:
    """The lines of a section without the bullets before them; empty ones and rules of equal signs are left out."""
    lines = F.transform(F.split(_text(text), r"\r?\n"), lambda x: F.regexp_replace(_trimmed(x), r"^[*\- ]+", ""))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("="))


def numbered(text: Column) -> Column:
    """The lines of a section without bullets and numbers before them, empty ones left out."""
    lines = F.transform(F.split(_text(text), r"\r?\n"), lambda x: F.regexp_replace(_trimmed(x), r"^[*\- 123456789.)]+", ""))
    return F.filter(lines, lambda x: x != "")


def confidence(text: Column, otherwise: float = 0.95) -> Column:
    """The first number, as a share: 0 to 1 as it is, up to 100 as percent."""
    v = F.regexp_extract(_text(text), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(v <= 1, v).when(v <= 100, v / 100).otherwise(F.lit(otherwise))


def report_class(text: Column) -> Column:
    low = F.lower(_text(text))
    out = F.when(low.contains(REPORT_CLASSES[0]), REPORT_CLASSES[0])
    for name in REPORT_CLASSES[1:]:
        out = out.when(low.contains(name), name)
    return out.otherwise(REPORT_CLASSES[0])


def json_body(text: Column) -> Column:
    """The JSON object of an answer, as text: thoughts go, then the fenced object, then first to last brace; null if neither parses."""
    t = F.regexp_replace(_text(text), r"(?s)^.*</think>", "")
    t = F.regexp_replace(t, r"(?s)^.*<think>", "")
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    listed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    # in a list nothing may follow the object, which the parser would pass over
    good = lambda c: F.when((c != "") & F.try_parse_json(listed(c)).isNotNull() & (F.json_array_length(listed(c)) == 1), c)
    return F.coalesce(good(fenced), good(braces))


def edits(text: Column) -> Column:
    """array<struct<file, search, replace>> of the edit blocks below ``### file`` headings; a block without a heading is none."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), _text(text)), r"\n[ \t]*### "), 2, 2**30)
    name = lambda s: F.regexp_replace(F.split_part(F.split_part(s, F.lit("\n"), F.lit(1)), F.lit("::"), F.lit(1)), r"^[\s`]+|[\s`]+\z", "")

    def of(part: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(part, F.lit(EDIT), F.lit(1)).alias("s"), F.regexp_extract_all(part, F.lit(EDIT), F.lit(2)).alias("r"))
        return F.transform(both, lambda x: F.struct(name(part).alias("file"), x["s"].alias("search"), x["r"].alias("replace")))

    return F.flatten(F.transform(parts, of))


def failed_tests(log: Column) -> Column:
    """Ids of the FAILED and ERROR lines, without the reason after `` - ``."""
    return F.transform(F.regexp_extract_all(_text(log), F.lit(FAILED_LINE), F.lit(1)), lambda x: F.trim(F.substring_index(x, " - ", 1)))


def passed_tests(log: Column) -> Column:
    return F.regexp_extract_all(_text(log), F.lit(PASSED_LINE), F.lit(1))


def assertion_failure(log: Column) -> Column:
    """struct<test_id, assertion, exception, actual, expected> of a log's first failure; the exception's text is read first, then the assertion."""
    log = _text(log)
    test = F.regexp_extract(log, r"(?m)^(?:FAILED|ERROR)\s+([^\s]+)", 1)
    claim = _trimmed(F.regexp_extract(log, ASSERT_LINE, 1))
    detail = F.regexp_extract(log, EXCEPTION_LINE, 2)
    pick = lambda n: F.coalesce(*[F.nullif(_trimmed(F.regexp_extract(x, COMPARED, n)), F.lit("")) for x in (detail, claim)], F.lit(""))
    return F.struct(test.alias("test_id"), claim.alias("assertion"), F.regexp_extract(log, EXCEPTION_LINE, 1).alias("exception"), pick(1).alias("actual"), pick(2).alias("expected"))


def failure_block(log: Column, test: Column) -> Column:
    """The part of a log below the underscored title that names the test."""
    title = F.concat(F.lit(r"(?s)_{3,} [^\n]*\Q"), test, F.lit(r"\E[^\n]* _{3,}\n(.*?)(?:\n_{3,} |\n={3,} |\z)"))
    return F.call_function("regexp_extract", _text(log), title, F.lit(1))


def located_symbols(entry: Column) -> Column:
    """Names after ``function:``, ``class:`` and ``method:`` lines."""
    return F.regexp_extract_all(_text(entry), F.lit(SYMBOL_LINE), F.lit(1))


def reproduction_command(text: Column) -> Column:
    return F.trim(F.regexp_extract(_text(text), COMMAND, 1))


def diff_counts(diff: Column) -> Column:
    """struct<added, deleted> lines of a unified diff, file headings left out."""
    lines = F.split(_text(diff), "\n")
    n = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("long")
    return F.struct(n("+").alias("added"), n("-").alias("deleted"))


def removed(before: Column, after: Column, targets: Column) -> Column:
    """Symbols that are gone though they were no target, sorted."""
    return F.sort_array(F.array_except(F.array_except(before, after), targets))


def within_budget(text: Column, n: int, marker: str = "…") -> Column:
    """At most n characters, the marker added where something is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)
