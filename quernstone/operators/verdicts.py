"""Verdicts about hypotheses and targets: symbol points, counterfactuals, coherence, contract gate, tiers and probes.

Null conditions count as false and null confidences as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.rules import first_true

#: Names too common to count as a mention, and variables a probe looks for, in order.
COMMON_NAMES = (
    "get", "set", "read", "write", "open", "close", "run", "start", "stop", "call", "send", "update", "values", "items", "keys", "pop", "copy", "clear", "count", "index", "head", "post", "put", "delete", "options",
    "request", "session", "response", "type", "format", "parse", "data", "body", "file", "code", "error", "text", "line", "string", "list", "dict",
)
PROBED = ("proxies", "kwargs", "config", "settings", "headers", "args", "params", "options", "state", "mode", "text", "scope", "encoding")


#: Marks of answers and diffs that must not get into a source.
LEAKS = ("```", "diff --git", "<<<<<<< SEARCH", "=======", ">>>>>>> REPLACE", "@@ -")


def static_gate(before: Column, after: Column, facts: Column, targets: Column, required: Column, most: int = 150) -> Column:
    """The errors of a revised source, in the gate's order: leak, syntax, unchanged, expansion, removed, signature. None: it passes.

    facts: of sources.code.revision. targets: names that may change; required: parameters that a changed target must have. Of a
    text that does not parse nothing beyond leaks is judged."""
    before, after = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    leak = F.exists(F.array(*map(F.lit, LEAKS)), lambda m: after.contains(m) & ~before.contains(m))
    ok = facts["ok"]
    gone = F.size(F.array_except(F.array_except(facts["before"], targets), facts["after"])) > 0
    changed = F.array_intersect(facts["before"], targets)
    lacks = F.exists(changed, lambda t: F.coalesce(F.size(F.array_except(required, F.try_element_at(facts["arguments"], t))) > 0, F.lit(False)))
    tests = ((leak, "LEAK"), (~ok, "SYNTAX"), (ok & ~facts["changed"], "UNCHANGED"), (ok & (facts["added"] > most), "EXPANSION"), (ok & gone, "REMOVED"), (ok & lacks, "SIGNATURE"))
    return F.array_compact(F.array(*[F.when(t, n) for t, n in tests]))


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def symbol_points(name: Column, kind: Column, text: Column) -> Column:
    """Points of a symbol that a text names: 30 as a dotted call, 25 in backticks or as a call; a common name must
    be marked as a class or dotted; else 20 for a class, 15 for six letters and more, 8 for fewer, in any case."""
    q = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    has = lambda before, after, flags="": _is(F.regexp_like(text, F.concat(F.lit(flags + before), q, F.lit(after))))
    is_class = _is(kind == "class")
    marked = has(r"\bclass\s+", r"\b", "(?i)") | has(r"\b", r"\s+class\b", "(?i)") | has(r"\b", r"\.")
    value = (
        F.when(has(r"\.", r"\s*\("), 30.0)
        .when(has(r"`[^`\n]*\b", r"\b[^`\n]*`") | has(r"\b", r"\s*\("), 25.0)
        .when(F.lower(name).isin(*COMMON_NAMES), F.when(is_class & marked, 25.0).otherwise(0.0))
        .when(has(r"\b", r"\b", "(?i)"), F.when(is_class, 20.0).when(F.length(name) >= 6, 15.0).otherwise(8.0))
    )
    return F.when(F.length(name) > 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def counterfactual(failure: Column, expected: Column, scope: Column, unexplained: Column) -> Column:
    """Would a change here explain what is seen? unexplained: number of symptoms left over."""
    failure, expected, scope, left = _is(failure), _is(expected), _is(scope), F.coalesce(unexplained, F.lit(0))
    some = failure | expected
    return first_true([(failure & expected & scope & (left == 0), "HIGHLY_PLAUSIBLE"), (some & scope & (left <= 1), "PLAUSIBLE"), (~scope, "INSUFFICIENT_SCOPE")], "WEAK")


def coherence(declared: Column, exact: Column, structural: Column, same_file: Column, in_reason: Column) -> Column:
    """Why a target agrees with the declared sites; INCOHERENT if it does not. declared: there are sites at all."""
    return first_true([(~_is(declared), "UNDECLARED"), (_is(exact), "EXACT"), (_is(structural), "STRUCTURAL"), (_is(same_file) & _is(in_reason), "RATIONALE")], "INCOHERENT")


def gated_confidence(conf: Column, forbidden: Column, handled: Column, covered: Column) -> Column:
    """Confidence after the contract: at most 0.1 where something forbidden is proposed; 0.1 for each handled exception
    named and, unless forbidden, 0.05 for each requirement covered, up to 1."""
    out, forbidden = F.coalesce(conf, F.lit(0.0)), _is(forbidden)
    out = F.when(forbidden, F.least(out, F.lit(0.1))).otherwise(out)
    out = F.least(F.lit(1.0), out + 0.1 * F.coalesce(handled, F.lit(0)))
    return F.round(F.when(forbidden, out).otherwise(F.least(F.lit(1.0), out + 0.05 * F.coalesce(covered, F.lit(0)))), 4)


def contract_gate(h: DataFrame, case: str, order: str, forbidden: Column, conf: Column, score: Column, upstream: Column, specified: Column) -> DataFrame:
    """One row for each case: the chosen hypothesis, its confidence and why.

    The upstream choice stays if it survives; else the survivor of the highest score, confidence and smallest order
    key; without survivors a synthetic one at 0.95 where the contract is specified, else the first is revived. Maxima
    and minima of structs alone: they merge on the map side, whatever the size of a case."""
    forbidden = _is(forbidden)
    live = lambda test, key: F.max(F.when(test & ~forbidden, F.struct(*key, (-F.col(order)).alias("o"), conf.alias("c"))))
    g = h.groupBy(case).agg(
        live(_is(upstream), []).alias("up"), live(F.lit(True), [F.coalesce(score, F.lit(0.0)).alias("s"), conf.alias("k")]).alias("best"),
        F.min(F.struct(F.col(order).alias("o"), conf.alias("c"))).alias("first"), F.max(_is(specified)).alias("spec"), F.count_if(~forbidden).alias("survivors"),
    )
    why = first_true([(F.col("up").isNotNull(), "UPSTREAM"), (F.col("best").isNotNull(), "BEST"), (F.col("spec"), "SYNTHESISED")], "REVIVED")
    pick = lambda up, best, synth, first: F.when(F.col("up").isNotNull(), up).when(F.col("best").isNotNull(), best).when(F.col("spec"), synth).otherwise(first)
    return g.select(case, "survivors", why.alias("why"), pick(-F.col("up.o"), -F.col("best.o"), F.lit(None), F.col("first.o")).alias("chosen"), pick(F.col("up.c"), F.col("best.c"), F.lit(0.95), F.col("first.c")).alias("confidence"))


def tier(static_valid: Column, tested: Column, f2p: Column, resolved: Column) -> Column:
    """How far a stage-gated check came."""
    return first_true([(~_is(static_valid) | ~_is(tested), "STATIC"), ((f2p > 0) | _is(resolved), "REGRESSION_P2P")], "TARGETED_F2P")


def probe_plan(first: Column, second: Column, named: Column | None = None) -> Column:
    """At most two probes that tell two hypotheses apart: the entry, then one variable (named, or the first of PROBED
    in either text). Without a second hypothesis there is none."""
    texts = F.lower(F.concat_ws("\n", first, second))
    found = F.filter(F.array(*map(F.lit, PROBED)), lambda w: texts.contains(w))
    word = F.coalesce(named, F.get(found, 0)) if named is not None else F.get(found, 0)
    plan = F.when(word.isNotNull(), F.array(F.lit("P_ENTRY"), F.concat(F.lit("P_"), F.upper(word)))).otherwise(F.array(F.lit("P_ENTRY")))
    return F.when(first.isNotNull() & second.isNotNull(), plan).otherwise(F.array().cast("array<string>"))


def first_nearby(df: DataFrame, key: str, groups: list[str], n: int = 10) -> DataFrame:
    """key and the first n other keys of its group, in order. A key meets n + 1 rows of its group and no more, so the
    group's size does not matter; keys are unique."""
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(key))).where(F.col("_r") <= n + 1)
    top = top.groupBy(*groups).agg(F.array_sort(F.collect_list(key)).alias("_top"))
    out = df.join(top, groups)
    return out.select(key, *groups, F.slice(F.filter("_top", lambda x: x != F.col(key)), 1, n).alias("others"))
