"""Candidates told apart by their tests, claims about them, hypotheses' scores in parts, and the integrity of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.sources.tables import dealt_by_rows, written

BLOCK = 4096
#: Rows of tests in one task: a task that sorts and counts them takes up to some 2 KB for each.
APART_ROWS = 250_000
#: Kinds of evidence.
STRUCTURAL = ("GRAPH_RELATION", "CALL_RELATION", "IMPORT_RELATION")
SEMANTIC = ("SEMANTIC_MATCH", "SYMBOL_MATCH", "ISSUE_TEXT", *STRUCTURAL)
ERROR = ("ERROR_MESSAGE", "STACK_TRACE", "CODE_BEHAVIOR")


def last_without(t: DataFrame, held: DataFrame, group: str, deal: Callable[..., DataFrame]) -> DataFrame:
    """group, test and _last: the largest nth (from 0) of the group's n candidates that lacks the test, -1 if all have it.

    t: distinct group, test, n, nth, _block; held: how many of a block's candidates have a test. First the last block of BLOCK
    candidates that is not full of the test, from counts, then the place in that block: no window sees more than a block or
    the list of blocks. Of distinct numbers in falling order, those that follow on each other from the top are the ones below
    the size by their row number."""
    keys = [group, "test"]
    of_block = F.least(F.lit(BLOCK), F.col("n") - F.col("_block") * BLOCK)
    blocks = F.ceil(F.col("n") / BLOCK)
    full = F.col("_held") == of_block
    nth_full = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(full), F.desc("_block")))
    block = deal(held, *keys).withColumn("_full", full & (F.col("_block") == blocks - nth_full)).groupBy(*keys, "n").agg((F.max(blocks) - 1 - F.count_if("_full")).alias("_block"))
    inside = deal(block, *keys, "_block").join(t.drop("n"), [*keys, "_block"], "left").withColumn("_at", F.col("nth") - F.col("_block") * BLOCK)
    nth = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(F.desc("_at")))
    run = inside.withColumn("_in", F.col("_at") == of_block - nth).groupBy(*keys, "_block", "n").agg(F.count_if("_in").alias("_run"))
    return run.select(*keys, F.when(F.col("_block") < 0, -1).otherwise(F.col("_block") * BLOCK + of_block - 1 - F.col("_run")).alias("_last"))


def told_apart(tests: DataFrame, group: str, show: int = 3) -> DataFrame:
    """Each candidate with the last other candidate of its group that lacks some of its tests.

    tests: group, candidate, nth (from 0), n (candidates in the group), test. Returns group, candidate, other (its nth),
    n_unique and the first of those tests. Where pairs are compared one by one and later ones overwrite, what stays is
    the largest nth that lacks one of the candidate's tests; so it is the maximum, over its tests, of the last candidate
    without the test, and no pair is made. That other lacks the tests whose last one it is and no more: it comes after the
    last ones of the rest. Repeated rows count once; candidates that all others cover are left out.

    The rows are counted and dealt by their number. Their keys hold a test's candidates of one block, a test's blocks or a
    candidate's tests, so that a large group is spread over tasks."""
    rows = written(tests.select(group, "candidate", F.col("nth").cast("long").alias("nth"), "n", "test", F.floor(F.col("nth") / BLOCK).alias("_block")))
    size = rows.count()
    deal = lambda df, *keys: dealt_by_rows(df, size, *keys, each=APART_ROWS)
    keys = [group, "test", "_block"]
    t = deal(rows, *keys).dropDuplicates([*keys, "candidate", "nth", "n"])
    held = written(t.groupBy(*keys, "n").agg(F.count("*").alias("_held")))
    last = deal(held.drop("_held", "n"), group, "test").join(deal(last_without(t, held, group, deal), group, "test"), [group, "test"])
    of_candidate = Window.partitionBy(group, "nth")
    best = deal(t.join(deal(last, *keys), keys), group, "nth").withColumn("other", F.max("_last").over(of_candidate))
    unique = best.where("other >= 0 AND _last = other").withColumn("_r", F.row_number().over(of_candidate.orderBy("test")))
    few = unique.groupBy(group, "nth", "candidate", F.col("other").cast("long").alias("other"))
    few = few.agg(F.count("*").alias("n_unique"), F.concat_ws(", ", F.array_sort(F.collect_list(F.when(F.col("_r") <= show, F.col("test"))))).alias("tests"))
    return few.drop("nth")


def scored(hypotheses: DataFrame, evidence: DataFrame, case: str) -> DataFrame:
    """Hypotheses' scores in parts, and their rank in the case.

    hypotheses: case, hypothesis, confidence, files and candidate_files (arrays). evidence: hypothesis, type, source and
    relevance in hundredths, whose sums are exact. Semantic is a mean, structural and error counts are capped, consistency
    is the share of the files that are candidates. Three places, half up, whatever the order of the sums. Hypotheses without evidence or files have zeros there."""
    kind = lambda *types: F.col("type").isin(*types)
    places = lambda x: F.floor(x * 1000 + 0.500001) / 1000
    ran = kind(*ERROR) & F.col("source").isin("execution", "test")
    parts = evidence.groupBy("hypothesis").agg(
        (F.sum(F.when(kind(*SEMANTIC), F.col("relevance"))) / F.count_if(kind(*SEMANTIC)) / 100).alias("_semantic"),
        F.least(F.lit(0.6), 0.2 * F.count_if(kind(*STRUCTURAL))).alias("_structural"),
        F.when(F.max(kind("TEST_REFERENCE")), 0.3).otherwise(0.0).alias("_test"),
        F.least(F.lit(0.6), 0.3 * F.count_if(ran)).alias("_error"))
    h = hypotheses.join(parts, "hypothesis", "left")
    both = F.size(F.array_intersect("files", "candidate_files"))
    part = {p: F.coalesce(F.col(f"_{p}"), F.lit(0.0)) for p in ("semantic", "structural", "test", "error")}
    part["consistency"] = F.when(F.size("files") > 0, both / F.size("files")).otherwise(0.0)
    h = h.withColumn("total", places(sum(part.values())))
    order = Window.partitionBy(case).orderBy(F.desc("total"), F.desc("confidence"), "hypothesis")
    return h.select(case, "hypothesis", *[places(v).alias(p) for p, v in part.items()], "total", F.row_number().over(order).cast("long").alias("rank"))


def claims(profiles: DataFrame) -> DataFrame:
    """One row for each rule that a profile meets: target, source, confidence, claim.

    profiles: target, blast (class), callers, in_stack, bug_fixes, overwritten and mutated (arrays). All rules are one projection."""
    c = F.col
    rules = [
        (c("blast") == "GLOBAL_INFRASTRUCTURE", "CODE_GRAPH", 0.95, F.format_string("used everywhere: %d callers", "callers")),
        (c("blast") == "FEATURE_LOCAL", "CODE_GRAPH", 0.90, F.format_string("used locally: %d callers", "callers")),
        (c("in_stack"), "TRACEBACK", 1.0, F.lit("on the failing call stack")),
        (c("bug_fixes") > 0, "TEMPORAL", 0.85, F.format_string("fixed before: %d times", "bug_fixes")),
        (F.size("overwritten") > 0, "STATE_FLOW", 0.85, F.concat(F.lit("overwrites "), F.array_join("overwritten", ", "))),
        (F.size("mutated") > 0, "STATE_FLOW", 0.85, F.concat(F.lit("mutates "), F.array_join("mutated", ", "))),
    ]
    made = [F.when(when, F.struct(F.lit(source).alias("source"), F.lit(conf).alias("confidence"), claim.alias("claim"))) for when, source, conf, claim in rules]
    return profiles.select("target", F.explode(F.array_compact(F.array(*made))).alias("_c")).select("target", "_c.*")


def integrity(results: DataFrame) -> DataFrame:
    """results with unrepresented and non_discriminating (arrays), four flags and inconsistent.

    results: patch and output (texts), resolved, f2p_ok, f2p_bad, p2p_bad and base_ok (arrays of test names, nulls as empty).
    unrepresented: tests that the patch defines, that fail in the output and that no declared failure's name contains; a
    test fails where its name stands on a line with the word FAILED or ERROR. non_discriminating: passes that passed on
    the base, where one name contains the other."""
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    names = lambda x: F.coalesce(F.col(x), F.array().cast("array<string>"))
    words = lambda line: F.regexp_extract_all(line, F.lit(r"(\w+)"), F.lit(1))
    lines = F.transform(F.split(text("output"), "\n"), words)
    failing = F.flatten(F.filter(lines, lambda w: F.arrays_overlap(w, F.array(F.lit("FAILED"), F.lit("ERROR")))))
    added = F.regexp_extract_all(text("patch"), F.lit(r"\bdef\s+(test_\w+)\b"), F.lit(1))
    declared = F.concat(names("f2p_bad"), names("p2p_bad"))
    unknown = F.filter(F.array_intersect(added, failing), lambda t: ~F.exists(declared, lambda d: d.contains(t)))
    idle = F.filter(names("f2p_ok"), lambda t: F.exists(names("base_ok"), lambda b: b.contains(t) | t.contains(b)))
    out = results.withColumns({"unrepresented": unknown, "non_discriminating": idle})
    wrong = lambda when: F.coalesce(F.col("resolved") & when, F.lit(False))
    flags = {
        "idle_passes": F.size("non_discriminating") > 0,
        "resolved_with_f2p_failures": wrong(F.size(names("f2p_bad")) > 0),
        "resolved_with_p2p_failures": wrong(F.size(names("p2p_bad")) > 0),
        "resolved_without_f2p": wrong(F.size(names("f2p_ok")) + F.size(names("f2p_bad")) == 0),
    }
    out = out.withColumns(flags)
    found = F.size("unrepresented") > 0
    for f in flags:
        found = found | F.col(f)
    return out.withColumn("inconsistent", found)


def run_metrics(records: DataFrame, by: str) -> DataFrame:
    """Rates, means and the histogram of failure classes (as JSON, by name) of each run; one aggregate over few classes.

    records: applied, valid, executed, resolved (booleans), runtime and model time in milliseconds, tokens, failure_class (null: UNKNOWN)."""
    per = records.groupBy(by, F.coalesce("failure_class", F.lit("UNKNOWN")).alias("failure_class")).agg(
        F.count("*").alias("n"), *[F.count_if(x).alias(x) for x in ("applied", "valid", "executed", "resolved")], *[F.sum(x).alias(x) for x in ("runtime", "model_time", "tokens")])
    total = lambda x: F.sum(x)
    n = total("n")
    return per.groupBy(by).agg(
        n.alias("n"), *[F.round(total(x) / n, 4).alias(f"{x}_rate") for x in ("applied", "valid", "executed", "resolved")],
        F.round(total("runtime") / n / 1000, 2).alias("mean_runtime_s"), F.round(total("model_time") / n / 1000, 2).alias("mean_model_s"),
        total("tokens").alias("tokens"), F.round(total("tokens") / n, 1).alias("mean_tokens"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "failure_class", "n"))), ",").alias("failures"))
