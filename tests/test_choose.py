"""The template page of recognised pages, against plain loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import choose

from test_align import text_match

ROWS, COLS = 9, 4


def template(seed):
    rnd = random.Random(seed)
    return {(r, c): (f"{seed * 1111}{r:02d}" if c == 0 else "".join(rnd.choice("abcdefghij") for _ in range(6))) for r in range(ROWS) for c in (0, 1)}


def frame_score(texts, items, cells):
    visible = {r for _x, y, _t in items for (r, _c), (_cx, cy, _w, h) in cells.items() if cy <= y < cy + h}
    wanted = {k: t for k, t in texts.items() if k[0] in visible}
    found: dict = {}
    for x, y, t in items:
        hit = next((k for k in sorted(cells) if cells[k][0] <= x < cells[k][0] + cells[k][2] and cells[k][1] <= y < cells[k][1] + cells[k][3]), None)
        if hit:
            found.setdefault(hit, []).append((y, x, t))
    read = {k: "".join(t for *_, t in sorted(v)) for k, v in found.items()}
    at = {k: sorted(v)[0][1::-1] for k, v in found.items()}
    good = {k: at[k] for k, t in texts.items() if k in read and text_match(t, read[k])}
    if len(wanted) < 4 or len(wanted) < 0.3 * len(texts):
        return 0.0, good
    return sum(k in good for k in wanted) / len(wanted), good


def by_hand(texts, items, frame):
    """Frame and widened frame, each fitted to its anchors."""
    wide = min(frame[0], min(x - 5 for x, *_ in items)), min(frame[1], min(y - 5 for _x, y, _t in items)), max(frame[2], max(x + 5 for x, *_ in items)), max(frame[3], max(y + 5 for _x, y, _t in items))
    best = 0.0
    for x0, y0, x1, y1 in (frame, wide):
        cells = {}
        for r in range(ROWS):
            for c in range(COLS):
                left, top, right, end = (round(v) for v in (x0 + c / COLS * (x1 - x0), y0 + r / ROWS * (y1 - y0), x0 + (c + 1) / COLS * (x1 - x0), y0 + (r + 1) / ROWS * (y1 - y0)))
                cells[(r, c)] = (left, top, right - left, end - top)
        score, good = frame_score(texts, items, cells)
        if score >= 0.1 and len(good) >= 4:
            mid = {k: (cells[k][0] + cells[k][2] / 2, cells[k][1] + cells[k][3] / 2) for k in good}
            ax, bx = np.polyfit([mid[k][0] for k in good], [good[k][0] for k in good], 1)
            ay, by = np.polyfit([mid[k][1] for k in good], [good[k][1] for k in good], 1)
            if 0.7 <= ax <= 1.4 and 0.7 <= ay <= 1.4:
                fitted = {k: (round(ax * x + bx), round(ay * y + by), round(ax * (x + w) + bx) - round(ax * x + bx), round(ay * (y + h) + by) - round(ay * y + by)) for k, (x, y, w, h) in cells.items()}
                score = max(score, frame_score(texts, items, fitted)[0])
        best = max(best, score)
    return best


def test_structure_scores_and_choice(spark):
    texts = {"A": template(3), "B": template(7)}
    rnd = random.Random(1)
    frames = {i: (100.0, 200.0, 900.0, 1100.0) for i in range(1, 7)}

    def page(t, x0, y0, x1, y1, wrong=0.0):
        out = []
        for (r, c), text in t.items():
            x, y = x0 + (c + 0.4) / COLS * (x1 - x0), y0 + (r + 0.5) / ROWS * (y1 - y0)
            out.append((round(x), round(y), text if rnd.random() >= wrong else "zz"))
        return out

    items = {
        1: page(texts["A"], *frames[1]), 2: page(texts["A"], 140, 225, 960, 1190, 0.1), 3: page(texts["B"], 100, 200, 900, 1100, 0.8),
        4: page(texts["B"], *frames[4])[:6], 5: page(texts["A"], 100, 640, 900, 1540), 6: page({k: "qq" for k in texts["A"]}, *frames[6]),
    }
    geometry = spark.createDataFrame(
        [("D", p, r, c, t.get((r, c), ""), c / COLS, r / ROWS, (c + 1) / COLS, (r + 1) / ROWS) for p, t in texts.items() for r in range(ROWS) for c in range(COLS)],
        "doc string, page string, r int, c int, text string, fx0 double, fy0 double, fx1 double, fy1 double",
    )
    rows = [(i, n, x - 5, y - 5, x + 5, y + 5, t, 0.9) for i, found in items.items() for n, (x, y, t) in enumerate(found)]
    items_df = spark.createDataFrame(rows, "page_id long, item_no int, x0 int, y0 int, x1 int, y1 int, text string, score double")
    edges = [(i, *f, [float(f[1]), float(f[3])]) for i, f in frames.items()]
    frames_df = spark.createDataFrame(edges, "page_id long, x0 double, y0 double, x1 double, y1 double, edges array<double>")
    pairs = spark.createDataFrame([(i, "D", p) for i in items for p in texts], "page_id long, doc string, page string")
    got = {(r.page_id, r.page): r.score for r in choose.structure_scores(pairs, frames_df, items_df, geometry).collect()}
    want = {(i, p): by_hand(texts[p], items[i], frames[i]) for i in items for p in texts}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert want[(1, "A")] == 1 and want[(2, "A")] > 0.7 > want[(2, "B")] and 0 < want[(3, "B")] < choose.ACCEPTED

    # Page 3 is told by its codes, page 4 by nothing but its texts; page 6 is forced, page 5 has lines of both templates.
    lines = [(i, r, float(r), t, "", t) for i, p in ((1, "A"), (3, "B"), (5, "A")) for (r, c), t in texts[p].items() if c == 0]
    lines_df = spark.createDataFrame(lines, "page_id long, line_no int, y double, code string, name string, text string")
    tpl = spark.createDataFrame([("D", p, r, t, "") for p, x in texts.items() for (r, c), t in x.items() if c == 0], "doc string, page string, r int, code string, name string")
    forced = spark.createDataFrame([(6, "D", "B")], "page_id long, doc string, page string")
    chosen = {r.page_id: r for r in choose.choose_page(items_df, lines_df, frames_df, pairs, geometry, tpl, forced).collect()}
    assert {i: r.page for i, r in chosen.items() if i != 4} == {1: "A", 2: "A", 3: "B", 5: "A", 6: "B"}
    assert chosen[3].score == 1.0 and chosen[6].score < choose.ACCEPTED and "%" in chosen[6].note and chosen[1].note == ""
    assert (chosen[4].page is None) == (max(want[(4, "A")], want[(4, "B")]) < choose.ACCEPTED)
    assert choose.choose_page(items_df, lines_df, frames_df, pairs.limit(0), geometry, tpl).count() == 0


def test_page_job_with_geometry(spark, tables):
    from ledgerloom.catalog.align import tpl
    from ledgerloom.plans import pages

    rows = tpl(tables)
    kinds = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("kind")) for c, k in ((0, "struct"), (1, "struct"), (3, "num"))])
    cells = rows.select("doc", "page", "r", "code", F.inline(kinds)).select("doc", "page", "r", "c", F.when(F.col("c") == 0, F.col("code")).otherwise("").alias("text"), "kind")
    geometry = cells.select("doc", "page", "r", "c", "text", (F.col("c") / 5).alias("fx0"), (F.col("r") / 194).alias("fy0"), ((F.col("c") + 1) / 5).alias("fx1"), ((F.col("r") + 1) / 194).alias("fy1"))
    some = tables.items.filter("page_id < 2")
    result = pages.run(some, tables.cell_boxes, tables.ignore_rects, rows, cells, geometry=geometry, rules=[("positive", "true", "c3 > 0"), ("gone", "true", "c77 > 0")])
    choice = {r.page_id: r for r in result.choice.collect()}
    assert choice and all((r.page is None) == (r.score < choose.ACCEPTED) for r in choice.values())
    assert {r.page_id for r in result.pages.collect()} == {i for i, r in choice.items() if r.page is not None}
    assert result.summary.count() == some.select("page_id").distinct().count()
