"""Decision lists and scoring formulas as column expressions: the first true case wins, terms add up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_true(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = None
    for test, name in cases:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def points(*terms: tuple[Column, object]) -> Column:
    """The sum of the values whose conditions hold."""
    total = F.lit(0.0)
    for test, value in terms:
        total = total + F.when(test, value).otherwise(0.0)
    return total


def failure_class(infra: Column, timeout: Column, valid: Column, applied: Column, resolved: Column, f2p: Column, f2p_total: Column, p2p: Column, p2p_total: Column, output: Column) -> Column:
    """Classes of a run's outcome, most decisive first."""
    none = (f2p_total > 0) & (f2p == 0)
    return first_true([
        (timeout, "TIMEOUT"), (infra, "INFRA_FAILURE"), (~valid | ~applied, "PATCH_SYNTAX"), (resolved, "RESOLVED"),
        ((f2p_total > 0) & (f2p == f2p_total) & (p2p < p2p_total), "REGRESSION"),
        ((f2p_total > 0) & (f2p > 0) & (f2p < f2p_total), "PATCH_SEMANTICS"),
        (none & output.rlike(r"\b(?:SyntaxError|IndentationError|TabError)\b"), "PATCH_SYNTAX"),
        (none & output.rlike(r"\b(?:NameError|ImportError|ModuleNotFoundError|UnboundLocalError)\b|is not defined|cannot import name"), "PATCH_SEMANTICS"),
        (none, "WRONG_HYPOTHESIS"),
    ], "TEST_FAILURE")


def failure_category(target_failures: Column, regressions: Column) -> Column:
    return first_true([
        ((target_failures == 0) & (regressions == 0), "RESOLVED"),
        ((target_failures > 0) & (regressions == 0), "SEMANTIC_MISUNDERSTANDING"),
        ((target_failures == 0) & (regressions > 3), "BLAST_RADIUS"),
        (target_failures == 0, "REGRESSION"),
    ], "INCOMPLETE_SPECIFICATION")


def next_action(failure: Column, attempt: Column, most: int, repeated: Column, others: Column, p2p_failed: Column) -> Column:
    """What to do after an attempt; others: further hypotheses are left."""
    syntax = failure.isin("PATCH_SYNTAX", "REPAIR_SCHEMA_FAILURE")
    return first_true([
        (attempt >= most, "ABORT"), (repeated & others, "SWITCH_HYPOTHESIS"), (repeated & syntax, "FALLBACK_SYNTAX"), (repeated, "ABORT"),
        (failure.isin("REPAIR_VALIDATION_FAILURE", "UNRESOLVED"), "REFINE_SEMANTICS"), (syntax, "FALLBACK_SYNTAX"),
        ((p2p_failed > 0) | (failure == "REGRESSION"), "CONSTRAIN_MUTATION"),
        (failure.isin("WRONG_HYPOTHESIS", "WRONG_LOCALIZATION") & others, "SWITCH_HYPOTHESIS"),
    ], "REFINE_SEMANTICS")


def next_phase(passed: Column, f2p: Column, f2p_total: Column, regressions: Column) -> Column:
    return first_true([(passed, "DONE"), ((f2p_total > 0) & (2 * f2p >= f2p_total) & (regressions == 0), "REFINE_NEAR_MISS")], "REFINE")


def coverage(passed: Column, total: Column) -> Column:
    """Percent passed, one decimal; 0 without tests."""
    return F.when(total > 0, F.round(100.0 * passed / total, 1)).otherwise(0.0)


def candidate_score(final: Column, f2p: Column, regressions: Column, files: Column, diff_lines: Column, rejected: Column, confidence: Column) -> Column:
    clean = (f2p > 0) & (regressions == 0)
    base = points((final, 1000.0), (clean, 20.0), (rejected, -100.0))
    return F.round(base + 50 * f2p - 500 * regressions - 2 * files - 0.01 * diff_lines + 10 * confidence, 2)


#: Phrases of an issue that ask for another signature.
SIGNATURE_PATTERNS = (
    r"(?i)\b(?:add|new|accept|support|introduce)\s+(?:an?\s+)?(?:parameter|argument|kwarg|keyword\s+argument|option|flag)\b",
    r"(?i)\b(?:signature|signature\s+of|parameter\s+list)\b",
    r"(?i)\b(?:takes?\s+no\s+arguments?|unexpected\s+keyword\s+argument)\b",
    r"(?i)\b(?:rather\s+than\s+mode\s+strings|mode\s+parameter|text\s+parameter)\b",
)


def contract_category(text: Column, hints: Column) -> tuple[Column, Column]:
    """Category and confidence from the number of signature patterns found and a keyword in the hints."""
    n = sum((F.when(text.rlike(p), 1).otherwise(0) for p in SIGNATURE_PATTERNS), F.lit(0))
    keyword = hints.rlike(r"`[a-zA-Z_]\w*=[^`]+`")
    api, mixed = (n >= 2) | ((n >= 1) & keyword), (n == 1) | keyword
    return F.when(api, "API_SIGNATURE").when(mixed, "MIXED").otherwise("ALGORITHMIC_BEHAVIORAL"), F.when(api, 0.95).when(mixed, 0.75).otherwise(0.2)


def failure_cause(error: Column, infra: Column, valid: Column, patch: Column, patch_error: Column, applied: Column, resolved: Column, f2p: Column, f2p_total: Column, p2p: Column, p2p_total: Column, output: Column, changed: Column, likely: Column, target_file: Column, target_symbol: Column) -> Column:
    """The full decision list of a run's outcome. changed: files of the patch; likely: files of the first candidates.

    Of a run that mended nothing the output says why: broken syntax, missing names, a patch beside all likely files, a
    failure that passed through the patched code, or none of these."""
    text = lambda c: F.coalesce(c, F.lit(""))
    error, patch_error, output = text(error), F.lower(text(patch_error)), F.concat_ws(" ", text(output), text(error))
    late = F.lower(error).contains("timeout")
    broken = ~valid | (F.trim(text(patch), F.lit(" \t\n\r")) == "")
    none = (f2p_total > 0) & (f2p == 0)
    likely = F.filter(F.slice(likely, 1, 5), lambda f: f != "")
    beside = (F.size(likely) > 0) & (F.size(changed) > 0) & ~F.exists(changed, lambda p: F.exists(likely, lambda f: p.contains(f) | f.contains(p)))
    files = F.concat(changed, F.when(text(target_file) != "", F.array(target_file)).otherwise(F.array().cast("array<string>")))
    name = lambda f: F.substring_index(F.translate(f, "\\", "/"), "/", -1)
    passed = F.exists(files, lambda f: (name(f) != "") & output.contains(name(f))) | ((text(target_symbol) != "") & output.contains(text(target_symbol)))
    return first_true([
        (late, "TIMEOUT"), (infra, "INFRA_FAILURE"), ((error != "") & ~applied, "INFRA_FAILURE"),
        (broken & patch_error.contains("schema"), "REPAIR_SCHEMA_FAILURE"), (broken & patch_error.contains("validation"), "REPAIR_VALIDATION_FAILURE"), (broken & patch_error.contains("expansion"), "REPAIR_OVEREXPANSION"),
        (broken | ~applied, "PATCH_SYNTAX"), (resolved, "RESOLVED"),
        ((f2p_total > 0) & (f2p == f2p_total) & (p2p < p2p_total), "REGRESSION"), ((f2p_total > 0) & (f2p > 0) & (f2p < f2p_total), "PATCH_SEMANTICS"),
        (none & output.rlike(r"\b(?:SyntaxError|IndentationError|TabError)\b"), "PATCH_SYNTAX"),
        (none & output.rlike(r"\b(?:NameError|ImportError|ModuleNotFoundError|UnboundLocalError)\b|is not defined|cannot import name"), "PATCH_SEMANTICS"),
        (none & beside, "WRONG_LOCALIZATION"), (none & passed, "PATCH_SEMANTICS"), (none, "WRONG_HYPOTHESIS"),
    ], "TEST_FAILURE")


def hypothesis_score(confidence: Column, evidence: Column, frames: Column, matched: Column, unexplained: Column, wide: Column, local: Column, specific: Column, tested: Column, forbidden: Column, branch: Column) -> tuple[Column, Column]:
    """A hypothesis' score and whether it is eliminated. wide and local: numbers of its sites with a global and a local
    radius; forbidden: number of forbidden events seen. A confidence that is no finite number counts as a half; without any evidence it counts up to 0.75."""
    c = F.coalesce(F.when(F.isnan(confidence) | (F.abs(confidence) == float("inf")), 0.5).otherwise(confidence), F.lit(0.5))
    score = F.when(~evidence, F.least(F.lit(75.0), 100 * c)).otherwise(100 * c)
    score = score - F.when((frames >= 2) & ~matched, 40.0).otherwise(0.0) - F.least(F.lit(35.0), 15.0 * unexplained) - 25.0 * wide + 20.0 * local
    score = score + points((specific, 15.0), (tested, 10.0), (branch, 15.0)) - 30.0 * forbidden
    contradicted = (forbidden >= 2) & (forbidden > F.when(branch, 1).otherwise(0))
    return F.round(score, 2), contradicted | (score < 20)
