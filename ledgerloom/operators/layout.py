"""Page layout over recognised text boxes.

Items are (page_id, item_no, x0, y0, x1, y1, text, score). Anything that must walk a
page in order walks its distinct positions and sizes, which the pixel grid bounds; the
items themselves are only joined and aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.fuzzy import codes_match
from ledgerloom.functions.geometry import inside_closed, inside_half_open
from ledgerloom.functions.number import is_amount_text, number_or_null
from ledgerloom.functions.text import key_code, let, strip, text_or_empty, title_like
from ledgerloom.scale import lead_within, rects_by_tile, with_rects

PAGE = ["page_id"]
CELL = ["page_id", "r", "c"]
_CJK = r"[一-鿿]"


def placed(items: DataFrame) -> DataFrame:
    """Adds centre and height."""
    return items.withColumns({
        "cx": (F.col("x0") + F.col("x1")) / F.lit(2.0),
        "cy": (F.col("y0") + F.col("y1")) / F.lit(2.0),
        "h": (F.col("y1") - F.col("y0")).cast("double"),
    })


def upper_median(values: Column) -> Column:
    """Upper middle of an array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def gaps(values: Column) -> Column:
    """Differences of neighbours in a sorted array."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<double>"))


# --- rectangles and cells -------------------------------------------------


def _rect_tiles(rects: DataFrame, size: tuple, keep: Sequence[str], order: Sequence[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return rects_by_tile(rects, PAGE, size, keep, (x, y, x + F.col("w"), y + F.col("h")), order)


def drop_ignored(items: DataFrame, rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Items whose centre is in no ignore rectangle (fractions of the page, borders included)."""
    size = (0.125, 0.125)
    tiled = _rect_tiles(rects, size, ["x", "y", "w", "h"], ["x", "y"])
    located = placed(items)
    fx, fy = F.col("cx") / page_w, F.col("cy") / page_h
    joined = with_rects(located, tiled, PAGE, fx, fy, size)
    inside = F.exists(F.coalesce("_rects", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")),
                      lambda b: inside_closed(fx, fy, b["x"], b["y"], b["w"], b["h"]))
    return joined.filter(~inside).select(*items.columns)


def assign_cells(items: DataFrame, cells: DataFrame, tile: tuple[int, int] = (200, 100)) -> DataFrame:
    """Each item with the first cell (row, column order) holding its centre; others are dropped."""
    tiled = _rect_tiles(cells, tile, ["r", "c", "x", "y", "w", "h"], ["r", "c"])
    joined = with_rects(placed(items), tiled, PAGE, F.col("cx"), F.col("cy"), tile)
    hit = F.filter("_rects", lambda b: inside_half_open(F.col("cx"), F.col("cy"), b["x"], b["y"], b["w"], b["h"]))
    found = joined.withColumn("_hit", F.get(hit, F.lit(0))).filter(F.col("_hit").isNotNull())
    return found.withColumns({"r": F.col("_hit.r"), "c": F.col("_hit.c")}).drop("_hit", "_rects")


def near_scores(cells: DataFrame, items: DataFrame, page_w: float, page_h: float, reach: float = 0.05) -> DataFrame:
    """Lowest score of the items near each cell centre, both distances below `reach` of the page."""
    fx = (F.col("x") + F.col("w") / F.lit(2.0)) / page_w
    fy = (F.col("y") + F.col("h") / F.lit(2.0)) / page_h
    around = lambda v: F.sequence(F.floor(v / reach) - 1, F.floor(v / reach) + 1)
    spread = (
        cells.select(*CELL, fx.alias("fx"), fy.alias("fy"))
        .select("*", F.explode(around(F.col("fx"))).alias("_tx"))
        .select("*", F.explode(around(F.col("fy"))).alias("_ty"))
    )
    located = placed(items).select("page_id", "score", (F.col("cx") / page_w).alias("bx"), (F.col("cy") / page_h).alias("by"))
    tiled = located.withColumns({"_tx": F.floor(F.col("bx") / reach), "_ty": F.floor(F.col("by") / reach)})
    near = spread.join(tiled, ["page_id", "_tx", "_ty"]).filter(
        (F.abs(F.col("bx") - F.col("fx")) < reach) & (F.abs(F.col("by") - F.col("fy")) < reach)
    )
    return near.groupBy(*CELL).agg(F.min("score").alias("score"))


def holes(cells: DataFrame, filled: DataFrame, rects: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Cells without text, at most 60% of the page per side, centre outside the ignore rectangles."""
    bare = cells.filter((F.col("w") <= page_w * 0.6) & (F.col("h") <= page_h * 0.6)).join(
        filled.select(*CELL).distinct(), CELL, "left_anti"
    )
    boxed = bare.withColumns({"x0": F.col("x"), "x1": F.col("x") + F.col("w"), "y0": F.col("y"), "y1": F.col("y") + F.col("h")})
    return drop_ignored(boxed, rects, page_w, page_h).select(*cells.columns)


def line_veto(lines: DataFrame, items: DataFrame, margin: int = 6, limit: int = 4, tile: int = 64) -> DataFrame:
    """Vertical lines (page_id, x) with the number of distinct CJK boxes across them and whether
    they stay, which is so below `limit`. Boxes overlapping by IoU > 0.4 count once, first seen first."""
    cjk = items.filter(F.regexp_like("text", F.lit(_CJK))).groupBy("page_id", "x0", "y0", "x1", "y1").agg(F.min("item_no").alias("no"))
    spans = cjk.select("*", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))).alias("_tx"))
    asked = lines.withColumn("_tx", F.floor(F.col("x") / tile))
    across = asked.join(spans, ["page_id", "_tx"]).filter((F.col("x0") < F.col("x") - margin) & (F.col("x1") > F.col("x") + margin))
    boxes = across.groupBy("page_id", "x").agg(F.sort_array(F.collect_list(F.struct("no", "x0", "y0", "x1", "y1"))).alias("boxes"))
    kept = F.aggregate(
        "boxes",
        F.slice(F.col("boxes"), 1, 0),
        lambda acc, b: F.when(F.exists(acc, lambda u: _iou(u, b) > 0.4), acc).otherwise(F.concat(acc, F.array(b))),
    )
    counted = boxes.select("page_id", "x", F.size(kept).alias("crossings"))
    n = F.coalesce("crossings", F.lit(0))
    return lines.join(counted, ["page_id", "x"], "left").select(*lines.columns, n.alias("crossings"), (n < limit).alias("stays"))


def _iou(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda s: (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])
    return F.when((w > 0) & (h > 0), (w * h) / (area(a) + area(b) - w * h).cast("double")).otherwise(0.0)


def column_bands(cells: DataFrame) -> DataFrame:
    return cells.groupBy("page_id", "c").agg(F.min("x").alias("band0"), F.max(F.col("x") + F.col("w")).alias("band1"))


def band_items(items: DataFrame, bands: DataFrame, page_w: float, slack: int = 4, tile: int = 64) -> DataFrame:
    """Numbers with the first column band holding their centre. A repeat of the row's own code at
    the right edge is dropped (column `line_code`, where present)."""
    located = placed(items)
    if "line_code" in items.columns:
        repeat = (
            (F.col("line_code") != "") & (F.col("text") == F.col("line_code")) & F.regexp_like("text", F.lit(r"^\d{1,6}$")) & (F.col("cx") > page_w * 0.85)
        )
        located = located.filter(~F.coalesce(repeat, F.lit(False)))
    spread = bands.select(
        "page_id", "c", "band0", "band1",
        F.explode(F.sequence(F.floor((F.col("band0") - slack) / tile), F.floor((F.col("band1") + slack) / tile))).alias("_tx"),
    ).groupBy("page_id", "_tx").agg(F.sort_array(F.collect_set(F.struct("c", "band0", "band1"))).alias("_bands"))
    joined = located.withColumn("_tx", F.floor(F.col("cx") / tile)).join(spread, ["page_id", "_tx"])
    hit = F.filter("_bands", lambda b: (b["band0"] - slack <= F.col("cx")) & (F.col("cx") < b["band1"] + slack))
    return joined.withColumn("c", F.get(hit, F.lit(0))["c"]).filter(F.col("c").isNotNull()).drop("_tx", "_bands")


def column_median(items: DataFrame) -> DataFrame:
    """Median right edge per (page, column) with at least two samples.

    Equal edges are counted first, so a hot column reaches the percentile as pixel counts.
    """
    counted = items.groupBy("page_id", "c", "x1").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("page_id", "c").agg(
        F.percentile("x1", 0.5, F.col("n")).alias("ref"), F.sum("n").alias("samples")
    ).filter("samples >= 2").select("page_id", "c", "ref")


def nearest_column(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Each item moves to the column whose reference edge is nearest; beyond the limit it stays.

    The limit is max(40, 0.45 x pitch) with the pitch taken from the column numbers, 200 for a
    single column.
    """
    per_page = refs.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ref", "c"))).alias("_refs"))
    numbers = F.array_sort(F.transform("_refs", lambda x: x["c"].cast("double")))
    pitch = F.coalesce(F.array_min(gaps(numbers)), F.lit(200.0))
    limited = per_page.withColumn("_lim", F.greatest(F.lit(40.0), pitch * 0.45))
    near = F.array_sort(
        F.transform(
            F.filter("_refs", lambda x: F.abs(F.col("x1") - x["ref"]) < F.col("_lim")),
            lambda x: F.struct(F.abs(F.col("x1") - x["ref"]).alias("d"), x["c"].alias("c")),
        )
    )
    joined = items.join(limited, "page_id", "left")
    return joined.withColumn("new_c", F.coalesce(F.get(near, F.lit(0))["c"], F.col("c"))).drop("_refs", "_lim")


def anchor_fit(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """Cells moved by the least-squares lines x -> x', y -> y' over matched anchors
    (page_id, r, c, ax, ay): at least 4 anchors and both slopes in [0.7, 1.4], else unchanged."""
    joined = cells.join(anchors, CELL)
    px, py = F.col("x") + F.col("w") / F.lit(2.0), F.col("y") + F.col("h") / F.lit(2.0)
    fit = joined.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.col("ax"), px).alias("sx"), F.regr_intercept(F.col("ax"), px).alias("ix"),
        F.regr_slope(F.col("ay"), py).alias("sy"), F.regr_intercept(F.col("ay"), py).alias("iy"),
    )
    ok = (F.col("n") >= 4) & F.col("sx").between(0.7, 1.4) & F.col("sy").between(0.7, 1.4)
    moved = lambda s, v, i: F.col(s) * v + F.col(i)
    pixel = lambda v: F.bround(v).cast("int")
    left, top = moved("sx", F.col("x"), "ix"), moved("sy", F.col("y"), "iy")
    right, bottom = moved("sx", F.col("x") + F.col("w"), "ix"), moved("sy", F.col("y") + F.col("h"), "iy")
    use = lambda new, old: F.when(ok, pixel(new)).otherwise(F.col(old)).alias(old)
    return cells.join(fit, "page_id", "left").select(
        *CELL, use(left, "x"), use(top, "y"), use(right - left, "w"), use(bottom - top, "h"), F.coalesce(ok, F.lit(False)).alias("fitted")
    )


# --- one-dimensional clusters ---------------------------------------------


def cluster_1d(values: DataFrame, gap: float) -> DataFrame:
    """(page_id, grp, centre, n): runs of positions at most `gap` apart, with their mean.

    The window runs over distinct positions, not over the rows.
    """
    counted = values.groupBy("page_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return _islands(counted, F.lit(gap))


def _islands(counted: DataFrame, gap: Column) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("v")
    starts = (F.col("v") - F.lag("v").over(w) > gap).cast("int")
    grouped = counted.withColumn("_s", F.coalesce(starts, F.lit(0)))
    numbered = grouped.withColumn("grp", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy("page_id", "grp").agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("centre"), F.sum("n").alias("n")
    )


def line_positions(values: DataFrame, gap: float = 10.0) -> DataFrame:
    """Line positions after a second, page-adaptive pass: max(gap, 0.35 x typical distance)."""
    first = cluster_1d(values, gap)
    page = first.groupBy("page_id").agg(F.sort_array(F.collect_list("centre")).alias("cs"))
    g = F.array_sort(gaps(F.col("cs")))
    typical = upper_median(F.when(F.size(g) >= 3, F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0)))).otherwise(g))
    adaptive = F.when(F.size("cs") >= 3, F.greatest(F.lit(gap), typical * 0.35)).otherwise(F.lit(-1.0))
    spread = page.withColumn("_gap", adaptive).select("page_id", "_gap", F.explode("cs").alias("v")).withColumn("n", F.lit(1))
    second = _islands(spread, F.col("_gap"))
    return second.select("page_id", F.col("grp").alias("line_no"), F.bround("centre").cast("int").alias("pos"))


def suppress_near(positions: DataFrame, min_gap: float) -> DataFrame:
    """(page_id, pos, cover): of neighbours closer than `min_gap` the better covered stays."""
    best = positions.groupBy("page_id", "pos").agg(F.max("cover").alias("cover"))
    page = best.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cover"))).alias("ps"))

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        close = (F.size(acc) > 0) & (p["pos"] - last["pos"] < min_gap)
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(close & (p["cover"] > last["cover"]), F.concat(head, F.array(p))).when(close, acc).otherwise(F.concat(acc, F.array(p)))
        )

    kept = F.aggregate("ps", F.slice(F.col("ps"), 1, 0), step)
    return page.select("page_id", F.inline(kept))


def uniform_gaps(positions: DataFrame) -> DataFrame:
    """Whether a page's lines are evenly spaced: largest gap below 2.8 x the lower half's median."""
    page = positions.groupBy("page_id").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
    g = F.array_sort(gaps(F.col("ps").cast("array<double>")))
    low = upper_median(F.slice(g, 1, F.greatest(F.floor(F.size(g) / 2).cast("int"), F.lit(1))))
    even = (F.size("ps") >= 3) & ~((low > 0) & (F.array_max(g) >= low * 2.8))
    return page.select("page_id", F.size("ps").alias("n_lines"), F.coalesce(even, F.lit(False)).alias("uniform"))


def snap_lines(values: DataFrame, lines: DataFrame) -> DataFrame:
    """Index of the nearest line within max(6, half the median gap); null beyond it."""
    page = lines.groupBy("page_id").agg(F.sort_array(F.collect_set("pos")).alias("_ps"))
    g = gaps(F.col("_ps").cast("array<double>"))
    tol = F.greatest(F.lit(6.0), F.floor(F.coalesce(upper_median(g), F.lit(20.0)) / 2))
    ranked = F.array_sort(F.transform("_ps", lambda p, i: F.struct(F.abs(p - F.col("v")).alias("d"), i.alias("i"))))
    best = F.get(ranked, F.lit(0))
    joined = values.join(page.withColumn("_tol", tol), "page_id", "left")
    return joined.select(*values.columns, F.when(best["d"] <= F.col("_tol"), best["i"]).alias("line_index"))


# --- text lines -----------------------------------------------------------


def text_lines(items: DataFrame) -> DataFrame:
    """(page_id, line_no, text, score, x0, y0, x1, y1) of free text.

    A line is anchored on its first box. At one y only the first box that does not fit
    can open a line, so walking the distinct (y, height) pairs finds every anchor.
    """
    used = placed(items).withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    shapes = used.groupBy("page_id", "cy", "h").agg(F.min("item_no").alias("seq"))
    page = shapes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("cy", "seq", "h"))).alias("_s"))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.abs(s["cy"] - last["cy"]) < F.greatest(F.lit(6.0), F.greatest(s["h"], last["h"]) * 0.6))
        return F.when(fits, acc).otherwise(F.concat(acc, F.array(s)))

    anchored = page.select("page_id", "_s", F.aggregate("_s", F.slice(F.col("_s"), 1, 0), step).alias("_a"))

    def located(s: Column) -> Column:
        until = F.size(F.filter("_a", lambda a: a["cy"] <= s["cy"]))
        own = F.element_at("_a", until)
        return F.struct(s["cy"].alias("cy"), s["h"].alias("h"), (until - 1).alias("no"), F.when(own["cy"] == s["cy"], own["seq"]).alias("cut"))

    levels = anchored.select("page_id", F.inline(F.transform("_s", located)))
    early = F.coalesce(F.col("item_no") < F.col("cut"), F.lit(False))
    lined = used.join(levels, ["page_id", "cy", "h"]).withColumn("line_no", F.col("no") - early.cast("int"))
    words = F.sort_array(F.collect_list(F.struct("cx", "cy", "item_no", "text")))
    return lined.groupBy("page_id", "line_no").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.min("score").alias("score"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def merge_fragments(assigned: DataFrame) -> DataFrame:
    """(page_id, r, c, text, score): fragments of a cell joined by line, then left to right, no spaces."""
    rows = assigned.groupBy(*CELL).agg(
        F.collect_list(F.struct("cy", "cx", "item_no", F.col("text").alias("t"))).alias("_f"), F.min("score").alias("score")
    )
    levels = F.array_sort(F.array_distinct(F.transform("_f", lambda f: f["cy"])))

    def step(acc: Column, y: Column) -> Column:
        near = (F.size(acc) > 0) & (y - F.try_element_at(acc, F.lit(-1)) < 8.0)
        return F.when(near, acc).otherwise(F.concat(acc, F.array(y)))

    starts = rows.withColumn("_a", F.aggregate(levels, F.array().cast("array<double>"), step))
    ordered = F.array_sort(F.transform("_f", lambda f: F.struct(
        F.size(F.filter("_a", lambda a: a <= f["cy"])).alias("line"), f["cx"].alias("cx"), f["cy"].alias("cy"), f["item_no"].alias("no"), f["t"].alias("t")
    )))
    return starts.select(*CELL, F.array_join(F.transform(ordered, lambda f: f["t"]), "").alias("text"), "score")


_LINE = "array<struct<cy:double,seq:bigint,mean:double,n:bigint>>"


def _line(cy: Column, seq: Column, mean: Column, n: Column) -> Column:
    return F.struct(
        cy.cast("double").alias("cy"), seq.cast("bigint").alias("seq"), mean.cast("double").alias("mean"), n.cast("bigint").alias("n")
    )


def _page_shapes(used: DataFrame) -> DataFrame:
    """(page_id, med_h, levels): per distinct y the box count and, per height, the position of its
    first box among the boxes of that y."""
    shapes = used.groupBy("page_id", "cy", "h").agg(F.min("item_no").alias("first"), F.count(F.lit(1)).alias("n"))
    levels = shapes.groupBy("page_id", "cy").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("first", "h"))).alias("kinds")
    )
    # Only levels with several heights need the boxes' own order.
    mixed = levels.filter(F.size("kinds") > 1).select("page_id", "cy", "kinds")
    opened = F.size(F.filter("kinds", lambda k: k["first"] <= F.col("item_no")))
    spans = used.select("page_id", "cy", "item_no").join(mixed, ["page_id", "cy"]).groupBy("page_id", "cy", opened.alias("k")).agg(F.count(F.lit(1)).alias("m"))
    counts = spans.groupBy("page_id", "cy").agg(F.collect_list(F.struct("k", "m")).alias("spans"))
    before = lambda i: F.coalesce(
        F.aggregate(F.filter("spans", lambda s: s["k"] <= i), F.lit(0).cast("bigint"), lambda acc, s: acc + s["m"]), F.lit(0).cast("bigint")
    )
    positioned = levels.join(counts, ["page_id", "cy"], "left").select(
        "page_id", "cy", "total", F.transform("kinds", lambda k, i: F.struct(k["first"].alias("first"), k["h"].alias("h"), before(i).alias("pos"))).alias("kinds")
    )
    page = positioned.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("cy", "total", "kinds"))).alias("levels"))
    heights = shapes.groupBy("page_id", "h").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("page_id").orderBy("h")
    cumulated = heights.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy("page_id"))})
    medians = cumulated.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("page_id").agg(F.min("h").alias("med_h"))
    medians = medians.withColumn("med_h", F.when(F.col("med_h") == 0, 10.0).otherwise(F.col("med_h")))
    return page.join(medians, "page_id")


def photo_line_starts(used: DataFrame) -> DataFrame:
    """(page_id, lines, tol): text lines by running mean, split lines merged, with where each starts."""

    def grow(acc: Column, g: Column, late: Column) -> Column:
        last, cut = F.element_at(acc, -1), F.get(late, F.lit(0))
        fits = F.size(late) == 0
        joined = F.when(fits, g["total"]).otherwise(cut["pos"])
        grown = _line(last["cy"], last["seq"], (last["mean"] * last["n"] + g["cy"] * joined) / (last["n"] + joined), last["n"] + joined)
        head = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        return F.when(fits, head).otherwise(F.concat(head, F.array(_line(g["cy"], cut["first"], g["cy"], g["total"] - joined))))

    def step(acc: Column, g: Column) -> Column:
        # After p boxes of this level joined, the distance to the mean is gap * n / (n + p).
        last = F.element_at(acc, -1)
        room = (g["cy"] - last["mean"]) * last["n"]
        late = F.filter(g["kinds"], lambda k: room / (last["n"] + k["pos"]) > F.greatest(F.col("med_h"), k["h"]) * 0.6)
        first = F.array(_line(g["cy"], F.get(g["kinds"], F.lit(0))["first"], g["cy"], g["total"]))
        return F.when(F.size(acc) == 0, first).otherwise(let(late, lambda found: grow(acc, g, found)))

    walked = _page_shapes(used).withColumn("lines", F.aggregate("levels", F.array().cast(_LINE), step))
    split = upper_median(gaps(F.transform("lines", lambda x: x["mean"]))) * 0.5

    def merge(acc: Column, x: Column, near: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        n = last["n"] + x["n"]
        both = _line(last["cy"], last["seq"], (last["mean"] * last["n"] + x["mean"] * x["n"]) / n, n)
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (x["mean"] - last["mean"] <= near), F.concat(head, F.array(both))).otherwise(F.concat(acc, F.array(x)))

    joined_lines = let(split, lambda near: F.aggregate("lines", F.array().cast(_LINE), lambda acc, x: merge(acc, x, near)))
    merged = walked.withColumn("lines", F.when(F.size("lines") >= 3, joined_lines).otherwise(F.col("lines")))
    typical = upper_median(gaps(F.transform("lines", lambda x: x["mean"])))
    tol = F.greatest(F.when(F.size("lines") >= 3, typical * 0.55).otherwise(F.col("med_h")), F.col("med_h") * 0.8)
    return merged.select("page_id", "lines", "levels", tol.alias("tol"))


def photo_line_items(items: DataFrame) -> DataFrame:
    """Items with their text line (line_no, y, tol).

    Lines are given to the levels of a page first; the items then join on (page, y), which
    spreads a hot page. At most one line starts on a level, from box `cut` on.
    """
    used = placed(items).filter(strip(F.col("text")) != "")
    starts = photo_line_starts(used)

    def located(g: Column) -> Column:
        until = F.size(F.filter("lines", lambda a: a["cy"] <= g["cy"]))
        own, before = F.element_at("lines", until), F.get(F.col("lines"), until - 2)
        cut = F.when(own["cy"] == g["cy"], own["seq"])
        return F.struct(
            g["cy"].alias("cy"), (until - 1).alias("no"), cut.alias("cut"), own["mean"].alias("own_y"), before["mean"].alias("before_y")
        )

    levels = starts.select("page_id", "tol", F.inline(F.transform("levels", located)))
    early = F.coalesce(F.col("item_no") < F.col("cut"), F.lit(False))
    return (
        used.join(levels, ["page_id", "cy"])
        .withColumns({"line_no": F.col("no") - early.cast("int"), "y": F.when(early, F.col("before_y")).otherwise(F.col("own_y"))})
        .drop("no", "cut", "own_y", "before_y")
    )


def photo_lines(items: DataFrame) -> DataFrame:
    """(page_id, line_no, y, tol, code, name, text): code is the first digit-rich text, name the longest CJK text."""
    lined = photo_line_items(items)
    t = F.col("text")
    n_digits = F.length(F.regexp_replace(t, r"[^\p{Nd}]", ""))
    at = F.struct("cy", "item_no")
    code = F.min_by(t, F.when(n_digits >= F.greatest(F.lit(3), F.length(t) - 1), at))
    name = F.min_by(t, F.when(F.regexp_like(t, F.lit(_CJK)), F.struct(-F.length(t), "cy", "item_no")))
    words = F.sort_array(F.collect_list(F.struct("cx", "cy", "item_no", "text")))
    return lined.groupBy("page_id", "line_no").agg(
        F.first("y").alias("y"), F.first("tol").alias("tol"), F.coalesce(code, F.lit("")).alias("code"), F.coalesce(name, F.lit("")).alias("name"),
        F.array_join(F.transform(words, lambda w: w["text"]), "").alias("text"),
    )


def overlapping_fragments(assigned: DataFrame, chunk: int = 16) -> DataFrame:
    """Cells in which neighbouring numeric boxes overlap and share up to 3 end/start characters."""
    value = F.struct(F.col("cx").alias("cx"), F.col("x1").alias("rx"), F.col("text").alias("t"))
    paired = lead_within(assigned, CELL, ["cx", "item_no"], value, F.floor(F.col("cx") / chunk), "_n")
    numeric = F.lit(r"^[\d,.+\-]+$")
    lx0, lx1 = F.col("cx") * 2 - F.col("x1"), F.col("_n.cx") * 2 - F.col("_n.rx")
    overlap = F.col("x1") - lx1
    narrow = F.least(F.col("x1") - lx0, F.col("_n.rx") - lx1)
    shared = F.lit(False)
    for k in (1, 2, 3):
        shared |= (F.length("text") >= k) & (F.length("_n.t") >= k) & (F.right("text", F.lit(k)) == F.left("_n.t", F.lit(k)))
    hit = (
        F.col("_n").isNotNull() & F.regexp_like("text", numeric) & F.regexp_like("_n.t", numeric)
        & (overlap >= F.greatest(F.lit(2.0), narrow * 0.15)) & shared
    )
    return paired.groupBy(*CELL).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("overlaps"))


# --- page level -----------------------------------------------------------


def items_to_grid(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Every cell with its text and lowest score; cells without items are empty."""
    texts = merge_fragments(assign_cells(items, cells))
    return cells.select(*CELL).join(texts, CELL, "left").select(*CELL, F.coalesce("text", F.lit("")).alias("text"), "score")


def table_gate(grid: DataFrame) -> DataFrame:
    """Whether a grid is a table: 2 rows, 2 columns, half filled, 2 columns with 2 texts."""
    filled = strip(F.col("text")) != ""
    columns = grid.groupBy("page_id", "c").agg(F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("f"), F.max("r").alias("last"), F.min("r").alias("top"))
    page = columns.groupBy("page_id").agg(
        (F.max("last") - F.min("top") + 1).alias("rows"), F.count(F.lit(1)).alias("cols"),
        (F.sum("f") / F.sum("n")).alias("fill"), F.count_if(F.col("f") >= 2).alias("good"),
    )
    ok = (F.col("rows") >= 2) & (F.col("cols") >= 2) & (F.col("fill") >= 0.5) & (F.col("good") >= 2)
    return page.select("page_id", F.col("fill"), ok.alias("is_table"))


def header_rows(grid: DataFrame) -> DataFrame:
    """Leading rows (at most 4) before the first numeric code in column 0."""
    coded = F.regexp_like(key_code(F.col("text")), F.lit(r"^\p{Nd}+$")) & (F.col("c") == 0) & (F.col("r") < 4)
    return grid.groupBy("page_id").agg(
        F.coalesce(F.min(F.when(coded, F.col("r"))), F.least(F.max("r") + 1, F.lit(4))).cast("int").alias("header_rows")
    )


def value_columns(grid: DataFrame) -> DataFrame:
    """(page_id, c, is_value): not a repeat of the code column and not mostly CJK text."""
    row = Window.partitionBy("page_id", "r")
    t = strip(F.col("text"))
    code = F.max(F.when(F.col("c") == 0, t)).over(row)
    heads = header_rows(grid)
    texts = grid.withColumn("_code", code).withColumn("text", t).filter((F.col("c") > 0)).join(heads, "page_id")
    filled, body = F.col("text") != "", F.col("r") >= F.col("header_rows")
    n_cjk = F.length(F.regexp_replace("text", "[^一-鿿]", ""))
    texty = ~is_amount_text(F.col("text")) & (n_cjk >= 2) & (n_cjk / F.greatest(F.length("text"), F.lit(1)) >= 0.5)
    repeats = filled & (F.coalesce("_code", F.lit("")) != "") & codes_match(F.col("text"), F.col("_code"))
    per_column = texts.groupBy("page_id", "c").agg(
        F.count_if(filled).alias("n"), F.count_if(repeats).alias("dup"), F.count_if(filled & body).alias("m"), F.count_if(filled & body & texty).alias("cjk")
    )
    is_dup = (F.col("n") > 0) & (F.col("dup") / F.greatest("n", F.lit(1)) >= 0.7)
    is_text = (F.col("m") > 0) & (F.col("cjk") / F.greatest("m", F.lit(1)) >= 0.6)
    return per_column.select("page_id", "c", (~is_dup & ~is_text).alias("is_value"))


def cell_flags(grid: DataFrame, low: float = 0.8, share: float = 0.6) -> DataFrame:
    """Per filled cell: non-numeric text in a mostly numeric column, and low confidence."""
    filled = grid.filter(strip(F.col("text")) != "")
    numeric = number_or_null(F.col("text")).isNotNull()
    columns = filled.groupBy("page_id", "c").agg((F.count_if(numeric) / F.count(F.lit(1)) >= share).alias("_numeric"))
    return filled.join(columns, ["page_id", "c"]).select(
        *CELL, "text", (F.col("_numeric") & ~numeric).alias("outlier"), F.coalesce(F.col("score") < low, F.lit(False)).alias("low_score")
    )


def promote_title(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """A first row merged over its whole width with a single text becomes the title; rows move up."""
    top = grid.filter("r = 0").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("width"), F.count_if(strip(F.col("text")) != "").alias("n"), F.max(F.nullif(strip(F.col("text")), F.lit(""))).alias("title")
    )
    spans = merges.filter("r = 0 and c = 0").groupBy("page_id").agg(F.max("cspan").alias("cspan"))
    lifted = top.join(spans, "page_id").filter("width >= 2 and n = 1 and cspan >= width").select("page_id", "title")
    moved = grid.join(lifted, "page_id", "left")
    shift = F.col("title").isNotNull().cast("int")
    return moved.withColumn("r", F.col("r") - shift).filter("r >= 0").select("page_id", "r", "c", "text", "title")


def pick_title(candidates: DataFrame, band_boost: float = 1.15) -> DataFrame:
    """Tallest title-like candidate per page (page_id, seq, text, h, in_band); the first of equals wins."""
    usable = candidates.filter(title_like(F.col("text")) & (strip(F.col("text")) != ""))
    height = F.col("h") * F.when(F.col("in_band"), band_boost).otherwise(1.0)
    return usable.filter(height > 0).groupBy("page_id").agg(F.min_by(strip(F.col("text")), F.struct(-height, "seq")).alias("title"))


def page_mode(counts: DataFrame) -> DataFrame:
    """(page_id, n_x, n_y, is_table) -> mode."""
    ruled = (F.col("n_x") >= 3) & (F.col("n_y") >= 3)
    return counts.select("page_id", F.when(ruled, "table").when(F.col("is_table"), "borderless").otherwise("text").alias("mode"))


def min_confidence(scored: DataFrame) -> DataFrame:
    """Lowest score per cell and per page."""
    cells = scored.groupBy(*CELL).agg(F.min("score").alias("score"))
    pages = scored.groupBy("page_id").agg(F.min("score").alias("page_score"))
    return cells.join(pages, "page_id").select(*CELL, "score", "page_score")


def turn_quality(items: DataFrame) -> DataFrame:
    """(page_id, turn, q, n_items, mean_score, tall_ratio) of each probed orientation."""
    tall = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0")) * 1.2
    page = items.groupBy("page_id", "turn").agg(
        F.sum(F.length("text")).alias("chars"), F.avg("score").alias("mean_score"), F.avg(tall.cast("int")).alias("tall_ratio"), F.count(F.lit(1)).alias("n_items")
    )
    q = F.col("chars") * F.col("mean_score") * F.when(F.col("tall_ratio") > 0.5, 0.5).otherwise(1.0)
    return page.select("page_id", "turn", q.alias("q"), "n_items", "mean_score", "tall_ratio")


def pick_turn(quality: DataFrame) -> DataFrame:
    """Orientation per page. A clear sampled winner is taken at once; otherwise the best probe must
    beat the upright one by a third. Four rows per page at most."""
    probes = quality.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("q")).alias("nq"), "turn", "n_items", "mean_score", "tall_ratio"))).alias("all")
    )
    zero = F.get(F.filter("all", lambda p: p["turn"] == 0), F.lit(0))
    q0 = F.coalesce(-zero["nq"], F.lit(0.0))
    tall0 = F.coalesce(zero["tall_ratio"], F.lit(0.0))

    def probed(wide: Column) -> Column:
        return F.filter("all", lambda p: (p["turn"] == 0) | (p["turn"] == 2) | wide)

    sampled = probed((tall0 > 0.5) | (q0 < 24.0))
    best, runner = F.get(sampled, F.lit(0)), F.get(sampled, F.lit(1))
    runner_q = F.coalesce(-runner["nq"], F.lit(0.0))
    clear = (best["n_items"] >= 4) & (best["mean_score"] >= 0.85) & (-best["nq"] >= F.greatest(F.lit(24.0), runner_q * 1.6))
    full = F.get(probed(tall0 > 0.5), F.lit(0))
    turned = (-full["nq"] > q0) & (-full["nq"] >= F.greatest(F.lit(12.0), q0 * 1.35))
    return probes.select("page_id", F.when(clear, best["turn"]).when(turned, full["turn"]).otherwise(0).cast("int").alias("turn"))


def top_by_area(items: DataFrame, k: int) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    w = Window.partitionBy("page_id").orderBy(F.desc("area"), "item_no")
    return items.withColumn("area", area).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
