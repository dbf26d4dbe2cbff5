"""Stack frames and lines against the spans of candidates: interval joins of any span length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the grids that spans are laid on: a span takes at most two cells of the narrowest grid that is as wide as itself.
WIDTHS = [16**n for n in range(1, 9)]
#: Folders whose frames belong to others, and the points of a covered frame.
FOREIGN = ("packages", "vendor", "third_party")
COVERS, DEPTH, INNERMOST = 30.0, 30.0, 30.0


def _grid() -> Column:
    """The number of the narrowest grid that is as wide as the span."""
    length, n = F.col("hi") - F.col("lo"), F.lit(len(WIDTHS) - 1)
    for i in reversed(range(len(WIDTHS) - 1)):
        n = F.when(length < WIDTHS[i], i).otherwise(n)
    return n


def grids(spans: DataFrame) -> list[int]:
    """The grids that spans lie on."""
    return sorted(r.n for r in spans.where("lo <= hi").select(_grid().alias("n")).distinct().collect())


def within(places: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """places with each span (lo, hi) of their keys that holds ``at``. A place is copied once for each grid that a span lies on, a span at most twice, however long.
    Which grids are in use is asked first: at most len(WIDTHS) numbers."""
    used, level = grids(spans), _grid()
    spans = spans.where("lo <= hi")
    cell = lambda x, n: F.floor(F.col(x) / WIDTHS[n]) * len(WIDTHS) + n
    cells = F.array().cast("array<long>")
    for n in used:
        cells = F.when(level == n, F.array_distinct(F.array(cell("lo", n), cell("hi", n)))).otherwise(cells)
    s = spans.withColumn("_cell", F.explode(cells))
    p = places.withColumn("_cell", F.explode(F.array(*[cell(at, n) for n in used]).cast("array<long>")))
    return p.join(s, [*keys, "_cell"]).where(F.col(at).between(F.col("lo"), F.col("hi"))).drop("_cell")


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def covered(frames: DataFrame, candidates: DataFrame, case: str) -> DataFrame:
    """Each candidate with the last frame that its span covers, and the points of it.

    frames: case, nth (from 0, outermost first), path, line. candidates: case, candidate, file, lo, hi. A frame is of a
    candidate's file if its path contains the file's name in small letters. Points grow with the frame's depth; the
    innermost frame in a candidate's file, tests and foreign folders left out, gives more. depth counts from 1 and is
    null, as is line, where no frame is covered; candidates of a case without frames have n_frames 0."""
    c = candidates.withColumn("_name", F.lower(file_name(F.col("file"))))
    hits = within(frames, c.where("_name <> ''").withColumnRenamed("file", "_file"), [case], "line").where(F.col("path").contains(F.col("_name")))
    last = hits.groupBy(case, "candidate").agg(F.max(F.struct("nth", "line")).alias("_m"))
    name, parts = file_name(F.col("path")), F.split(F.translate("path", "\\", "/"), "/")
    own = ~F.arrays_overlap(parts, F.array(*map(F.lit, FOREIGN))) & ~name.startswith("test_") & ~name.endswith("_test.py")
    inner = frames.where(own).withColumn("_name", name).join(c.select(case, "_name").distinct(), [case, "_name"], "left_semi")
    inner = inner.groupBy(case).agg(F.max("nth").alias("_inner"))
    count = frames.groupBy(case).agg(F.count("*").alias("n_frames"))
    out = c.join(last, [case, "candidate"], "left").join(count, case, "left").join(inner, case, "left")
    depth = F.col("_m.nth") + 1
    points = COVERS + F.round(depth / F.col("n_frames") * DEPTH, 1) + F.when(F.col("_m.nth") == F.col("_inner"), INNERMOST).otherwise(0.0)
    return out.select(case, "candidate", depth.cast("long").alias("depth"), F.col("_m.line").alias("line"), F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"), F.coalesce(points, F.lit(0.0)).alias("points"))


#: Levels of the dyadic grid of ``first_holding``; spans and places lie within 2 ** LEVELS of 0.
LEVELS = 40


def first_holding(places: DataFrame, spans: DataFrame, keys: list[str], at: str, value: Column) -> DataFrame:
    """keys, at and the least value (``least``) of the spans (lo, hi) of the keys that hold the place; none where no span does."""
    return held(places, spans, keys, at, value).groupBy(*keys, at).agg(F.min("_v").alias("least"))


def held(places: DataFrame, spans: DataFrame, keys: list[str], at: str, value: Column) -> DataFrame:
    """Places with the least value (``_v``) of the spans in each cell that holds them, a row for each of their cells.

    A span is cut into the fewest cells of a dyadic grid, at most two of each width, and the least value of each cell is kept; a place asks the cells
    that it lies in. So no place meets each of its spans: rows grow with places and spans, not with their pairs."""
    low, high = F.floor("lo").cast("long"), F.floor("hi").cast("long")
    grids = F.sequence(F.lit(0), F.lit(LEVELS))
    # a = ceil(lo / 2^n), b = floor((hi + 1) / 2^n): the span's whole cells of level n are a .. b - 1
    cell = lambda n: F.struct(n.alias("n"), (-F.call_function("shiftright", -F.col("_lo"), n)).alias("a"), F.call_function("shiftright", F.col("_hi") + 1, n).alias("b"))
    ends = F.filter(F.transform(grids, cell), lambda c: c["a"] < c["b"])
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    own = lambda c: F.array_distinct(F.concat(F.when(odd(c["a"]), F.array(c["a"])).otherwise(F.array().cast("array<bigint>")), F.when(odd(c["b"]), F.array(c["b"] - 1)).otherwise(F.array().cast("array<bigint>"))))
    cells = F.flatten(F.transform(ends, lambda c: F.transform(own(c), lambda i: F.struct(c["n"].alias("n"), i.alias("i")))))
    s = spans.where("lo <= hi").select(*keys, low.alias("_lo"), high.alias("_hi"), value.alias("_v"))
    s = s.withColumn("_cell", F.explode(cells)).groupBy(*keys, "_cell").agg(F.min("_v").alias("_v"))
    p = places.select(*keys, at).distinct().withColumn("_cell", F.explode(F.transform(grids, lambda n: F.struct(n.alias("n"), F.call_function("shiftright", F.floor(at).cast("long"), n).alias("i")))))
    return p.join(s, [*keys, "_cell"])


def enclosing(places: DataFrame, spans: DataFrame, file: str, at: str, kinds: tuple[str, ...] = ("method", "function")) -> DataFrame:
    """Each place with the first span (symbol, kind, nth, lo, hi) that holds it, one of ``kinds`` before any other; null where none does. Lines are whole numbers."""
    first = F.struct((~F.col("kind").isin(*kinds)).alias("other"), "nth", "symbol", "kind")
    found = first_holding(places, spans, [file], at, first)
    return places.join(found, [file, at], "left").select(*places.columns, F.col("least.symbol").alias("symbol"), F.col("least.kind").alias("kind"))
