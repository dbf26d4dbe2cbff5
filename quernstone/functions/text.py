"""Column functions over text: tokens, grams, stems, paths and pattern extraction. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "([a-zA-Z_][a-zA-Z0-9_]*)"
#: Words of a commit subject that mark a fix (matched as substrings).
FIX_WORDS = ("fix", "bug", "patch", "issue", "resolve", "defect", "error", "crash")


def tokens(text: Column, longer_than: int = 2) -> Column:
    """Identifiers of more than ``longer_than`` characters, lower-cased, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(1)), F.lower)
    return F.filter(found, lambda t: F.length(t) > longer_than) if longer_than else found


def token_set(text: Column) -> Column:
    """Distinct identifiers of any length, lower-cased first."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(IDENTIFIER), F.lit(1)))


def grams(token: Column, n: int = 3) -> Column:
    """Character n-grams of ^token$; shorter words give themselves."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1))), lambda i: F.substring(padded, i, F.lit(n)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def stem(token: Column) -> Column:
    """Drops ing, ed, ies, es or s from words of more than four letters; ss stays."""
    cut = lambda n: token.substr(F.lit(1), F.length(token) - n)
    out = F.when(F.length(token) <= 4, token)
    for ending, n, more in (("ing", 3, ""), ("ed", 2, ""), ("ies", 3, "y"), ("es", 2, ""), ("s", 1, "")):
        ends = token.endswith(ending) if ending != "s" else token.endswith("s") & ~token.endswith("ss")
        out = out.when(ends, F.concat(cut(n), F.lit(more)) if more else cut(n))
    return out.otherwise(token)


def mentions(text: Column, symbol: Column) -> Column:
    """True where the symbol stands in text between word boundaries."""
    quoted = F.concat(F.lit(r"\b\Q"), F.regexp_replace(symbol, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E\b"))
    return F.regexp_like(text, quoted)


def paths_match(a: Column, b: Column) -> Column:
    """Equal paths, one a suffix of the other at a slash, or equal names where one has no directory."""
    name = lambda p: F.substring_index(p, "/", -1)
    bare = ~a.contains("/") | ~b.contains("/")
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a)) | (bare & (name(a) == name(b)))


def any_contains(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [text.contains(w) for w in words])


def covers(text: Column, words: Column) -> Column:
    """True where the text holds one of the words, in any case, or where there are none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.size(words) == 0) | F.exists(words, lambda w: low.contains(F.lower(w)))


def normal_path(p: Column) -> Column:
    return F.regexp_replace(p, r"\\", "/")


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def split_lines(text: Column) -> Column:
    """A text's lines without the white space around them, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x != "")


def phrases(lines: Column, patterns: tuple[str, ...], most: int, longer_than: int = 8) -> Column:
    """What the patterns' first groups hold, a line at a time and a pattern at a time: distinct, the first ``most``, joined."""
    found = F.flatten(F.transform(lines, lambda x: F.array(*[F.trim(F.regexp_extract(x, p, 1)) for p in patterns])))
    return F.array_join(F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) > longer_than)), 1, most), "; ")


def lines(df, keep: list[str], text: str = "text"):
    """A row for each line: keep, line_no from 1, line."""
    return df.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def parts(text: Column, least: int, most: int) -> Column:
    """Distinct substrings of ``least`` to ``most`` letters: keys by which a containment join finds its candidates, linear in the text's length."""
    at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[at(n) for n in range(least, most + 1)]))
