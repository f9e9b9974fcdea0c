"""Choice of the template page: several placements of each candidate, fitted to the texts found, scored two ways.

A candidate's cells are laid over the page in up to three ways: by the frame of the detected table, by that frame
widened to all texts, and by the detected rows. Texts that agree with the template's own texts are anchors; a line
fitted through them moves the cells, and the better of both placings counts. The structure score is the share of
the template's texts found on visible rows; the row-key score comes from the alignment of codes and names, and needs
no pixel. The best candidate wins, the first of equals.

Everything is keyed by (page, candidate, placement), so pages never meet in one task. Work follows the number
of candidates a page keeps, which the caller prunes by template hits before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.fuzzy import text_match
from ledgerloom.operators import align, layout
from ledgerloom.scale import first_row, materialized

TPL = ["doc", "page"]
LEAST_FIT = 0.10
ACCEPTED = 0.55
# Height of the strips in which texts look for the rows they make visible.
STRIP = 64
_KEY = "\u0001"


def frames_of(cells: DataFrame) -> DataFrame:
    """(page_id, x0, y0, x1, y1, edges) of detected cells (page_id, r, c, x, y, w, h): the frame and the rows' edges."""
    rows = cells.groupBy("page_id", "r").agg(F.min("y").alias("y"), F.max(F.col("y") + F.col("h")).alias("end"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("right"))
    page = rows.groupBy("page_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("right").alias("x1"), F.max("end").alias("y1"), F.sort_array(F.collect_set("y")).alias("_tops")
    )
    numbers = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return page.select("page_id", *numbers, F.concat("_tops", F.array("y1")).cast("array<double>").alias("edges"))


def _placements(candidates: DataFrame, frames: DataFrame, items: DataFrame, geometry: DataFrame) -> DataFrame:
    """(place, page_id, doc, page, n, x0, y0, x1, y1, edges): n = 0 by frame, 1 by frame and texts, 2 by rows."""
    texts = items.groupBy("page_id").agg(F.min("x0").alias("a0"), F.min("y0").alias("b0"), F.max("x1").alias("a1"), F.max("y1").alias("b1"))
    size = geometry.groupBy(*TPL).agg((F.max("r") + 1).alias("n_rows"))
    base = candidates.join(frames, "page_id").join(texts, "page_id").join(size, TPL)
    none = F.lit(None).cast("array<double>")

    def way(n: int, box: tuple, edges: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), *[c.cast("double").alias(k) for k, c in zip(("x0", "y0", "x1", "y1"), box)], edges.alias("edges"))

    frame = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    wide = F.least("x0", "a0"), F.least("y0", "b0"), F.greatest("x1", "a1"), F.greatest("y1", "b1")
    by_rows = F.when(F.size("edges") == F.col("n_rows") + 1, way(2, frame, F.col("edges")))
    ways = F.filter(F.array(way(0, frame, none), way(1, wide, none), by_rows), lambda w: w.isNotNull())
    placed = base.select("page_id", *TPL, F.inline(ways))
    return placed.withColumn("place", F.concat_ws(_KEY, F.col("page_id").cast("string"), "doc", "page", F.col("n").cast("string")))


def _laid(places: DataFrame, geometry: DataFrame) -> DataFrame:
    """Cells (page_id = place, r, c, x, y, w, h) in whole pixels, halves to even."""
    at = lambda lo, hi, part: F.col(lo) + F.col(part) * (F.col(hi) - F.col(lo))
    joined = places.join(geometry.select(*TPL, "r", "c", "fx0", "fy0", "fx1", "fy1"), TPL)
    top = F.when(F.col("edges").isNull(), at("y0", "y1", "fy0")).otherwise(F.get("edges", F.col("r").cast("int")))
    end = F.when(F.col("edges").isNull(), at("y0", "y1", "fy1")).otherwise(F.get("edges", F.col("r").cast("int") + 1))
    pixel = lambda c: F.bround(c).cast("int")
    left, right = pixel(at("x0", "x1", "fx0")), pixel(at("x0", "x1", "fx1"))
    return joined.select(
        F.col("place").alias("page_id"), "r", "c", left.alias("x"), pixel(top).alias("y"), (right - left).alias("w"), (pixel(end) - pixel(top)).alias("h")
    )


def _read(cells: DataFrame, items: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors, centres): the template's texts beside what was read in their cells, and where that stands."""
    pieces = F.sort_array(F.collect_list(F.struct("cy", "cx", "item_no", "text")))
    held = layout.assign_cells(items, cells).groupBy(*layout.CELL).agg(pieces.alias("_p"))
    first = F.get("_p", F.lit(0))  # the topmost piece stands for the cell
    joined = F.array_join(F.transform("_p", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    held = materialized(held.select(*layout.CELL, joined.alias("text"), first["cx"].alias("ax"), first["cy"].alias("ay")))
    read, centres = held.select(*layout.CELL, "text"), held.select(*layout.CELL, "ax", "ay")
    strips = lambda lo, hi: F.sequence(F.floor(lo / STRIP), F.floor(hi / STRIP))
    bands = cells.groupBy("page_id", "r").agg(F.min("y").alias("lo"), F.max(F.col("y") + F.col("h")).alias("hi")).filter("hi > lo")
    bands = bands.withColumn("strip", F.explode(strips(F.col("lo"), F.col("hi"))))
    seen = layout.placed(items).select("page_id", "cy", F.floor(F.col("cy") / STRIP).alias("strip")).distinct()
    visible = bands.join(seen, ["page_id", "strip"]).filter((F.col("lo") <= F.col("cy")) & (F.col("cy") < F.col("hi"))).select("page_id", "r").distinct()
    wanted = cells.select(*layout.CELL).join(texts, layout.CELL).join(read, layout.CELL, "left").join(
        visible.withColumn("visible", F.lit(True)), ["page_id", "r"], "left"
    )
    anchors = wanted.select(*layout.CELL, "tpl_text", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("visible", F.lit(False)).alias("visible"))
    return anchors, centres


def structure_scores(candidates: DataFrame, frames: DataFrame, items: DataFrame, geometry: DataFrame) -> DataFrame:
    """(page_id, doc, page, score, n, fitted): the best placement of each candidate; `geometry` holds the cells of the
    template pages (doc, page, r, c, text, fx0, fy0, fx1, fy1) as fractions of the table."""
    places = materialized(_placements(candidates, frames, items, geometry))
    cells = materialized(_laid(places, geometry))
    own = items.select("page_id", "item_no", "x0", "y0", "x1", "y1", "text", "score").join(places.select("page_id", "place"), "page_id")
    placed = materialized(own.drop("page_id").withColumnRenamed("place", "page_id"))
    named = geometry.filter("text <> ''").select(*TPL, "r", "c", F.col("text").alias("tpl_text"))
    texts = materialized(places.join(named, TPL).select(F.col("place").alias("page_id"), "r", "c", "tpl_text"))
    anchors, centres = _read(cells, placed, texts)
    anchors = materialized(anchors)
    first = materialized(align.structure_score(anchors).select("page_id", "score"))

    fit_for = first.filter(F.col("score") >= LEAST_FIT).select("page_id")
    good = anchors.filter(text_match(F.col("tpl_text"), F.col("text"))).join(fit_for, "page_id", "left_semi").join(centres, layout.CELL)
    moved = materialized(layout.anchor_fit(cells.join(fit_for, "page_id", "left_semi"), good.select(*layout.CELL, "ax", "ay")).filter("fitted").drop("fitted"))
    kept = placed.join(moved.select("page_id").distinct(), "page_id", "left_semi")
    again, _ = _read(moved, kept, texts.join(moved.select("page_id").distinct(), "page_id", "left_semi"))
    second = align.structure_score(again).select("page_id", F.col("score").alias("score2"))
    both = places.select("place", "page_id", *TPL, "n").join(first.withColumnRenamed("page_id", "place"), "place", "left").join(
        second.withColumnRenamed("page_id", "place"), "place", "left"
    )
    plain, fitted = F.coalesce("score", F.lit(0.0)), F.coalesce("score2", F.lit(0.0))
    each = both.select("page_id", *TPL, "n", F.greatest(plain, fitted).alias("score"), (fitted > plain).alias("fitted"))
    return first_row(each, ["page_id", *TPL], F.desc("score"), F.col("n"))


def choose_page(
    items: DataFrame, lines: DataFrame, frames: DataFrame, candidates: DataFrame, geometry: DataFrame, tpl: DataFrame, forced: DataFrame | None = None,
) -> DataFrame:
    """(page_id, doc, page, score, note): doc and page are null where no candidate reaches ACCEPTED.

    `forced` (page_id, doc, page) names the only candidate of its pages; it is kept below the limit too, with a note.
    """
    wanted = candidates.select("page_id", *TPL).distinct().withColumn("forced", F.lit(False))
    if forced is not None:
        named = forced.select("page_id", *TPL).distinct().withColumn("forced", F.lit(True))
        wanted = wanted.join(named.select("page_id").distinct(), "page_id", "left_anti").unionByName(named)
    wanted = materialized(wanted)
    geo = structure_scores(wanted.select("page_id", *TPL), frames, items, geometry)

    keyed = wanted.withColumn("key", F.concat_ws(_KEY, F.col("page_id").cast("string"), *TPL))
    pages = keyed.select(F.col("key").alias("page_id"), *TPL)
    read = lines.join(keyed.select("page_id", "key"), "page_id").drop("page_id").withColumnRenamed("key", "page_id")
    read = materialized(read.select("page_id", "line_no", "y", "code", "name", "text"))
    aligned = align.align_fuzzy(pages, tpl, read)
    base = keyed.join(geo.select("page_id", *TPL, "score"), ["page_id", *TPL], "left").select(F.col("key").alias("page_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = base.withColumnRenamed("score", "_base").join(
        align.key_score(pages, tpl, read, aligned).withColumnRenamed("score", "_keys"), "page_id", "left"
    ).select(F.col("page_id").alias("key"), F.greatest("_base", F.coalesce("_keys", F.lit(0.0))).alias("score"))
    best = first_row(keyed.join(scored, "key"), ["page_id"], F.desc("score"), F.col("doc"), F.col("page"))
    low = F.col("score") < ACCEPTED
    share = F.concat(F.lit(fv.LOW_SCORE), F.bround(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))
    note = F.when(low & F.col("forced"), F.concat(share, F.lit(fv.FORCED_PAGE))).when(low, share).otherwise("")
    fits = ~low | F.col("forced")
    return best.select("page_id", F.when(fits, F.col("doc")).alias("doc"), F.when(fits, F.col("page")).alias("page"), "score", note.alias("note"))
