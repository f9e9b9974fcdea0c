"""Page layout queries over the text boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import Tables
from ledgerloom.operators import layout

W, H = 1000.0, 1400.0

define("boxes", ("items",), "boxes as (select *, (x0 + x1) / 2.0::double as cx, (y0 + y1) / 2.0::double as cy, cast(y1 - y0 as double) as h from items)")
define(
    "located",
    ("boxes", "cell_boxes"),
    """located as (select i.*, b.r, b.c from boxes i join cell_boxes b on b.page_id = i.page_id and i.cx >= b.x and i.cx < b.x + b.w and i.cy >= b.y and i.cy < b.y + b.h)""",
)


@query(
    "ignore_filter",
    """select page_id, item_no, text from boxes i where not exists (select 1 from ignore_rects g where g.page_id = i.page_id and i.cx / 1000 between g.x and g.x + g.w and i.cy / 1400 between g.y and g.y + g.h)""",
    ("boxes", "ignore_rects"),
)
def ignore_filter(t: Tables) -> DataFrame:
    return layout.drop_ignored(t.items, t.ignore_rects, W, H).select("page_id", "item_no", "text")


@query("assign_cells", "select page_id, item_no, r, c from located", ("located",))
def assign_cells(t: Tables) -> DataFrame:
    return layout.assign_cells(t.items, t.cell_boxes).select("page_id", "item_no", "r", "c")


@query(
    "near_scores",
    """select b.page_id, b.r, b.c, min(i.score) as score from cell_boxes b join boxes i on i.page_id = b.page_id
 and abs(i.cx / 1000 - (b.x + b.w / 2.0::double) / 1000) < 0.05::double and abs(i.cy / 1400 - (b.y + b.h / 2.0::double) / 1400) < 0.05::double group by 1, 2, 3""",
    ("boxes", "cell_boxes"),
)
def near_scores(t: Tables) -> DataFrame:
    return layout.near_scores(t.cell_boxes, t.items, W, H)


@query(
    "holes",
    """select b.page_id, b.r, b.c from cell_boxes b where not exists (select 1 from located l where l.page_id = b.page_id and l.r = b.r and l.c = b.c)
 and not exists (select 1 from ignore_rects g where g.page_id = b.page_id and (b.x + b.w / 2.0) / 1000 between g.x and g.x + g.w and (b.y + b.h / 2.0) / 1400 between g.y and g.y + g.h)""",
    ("located", "ignore_rects"),
)
def holes(t: Tables) -> DataFrame:
    filled = layout.assign_cells(t.items, t.cell_boxes)
    return layout.holes(t.cell_boxes, filled, t.ignore_rects, W, H).select("page_id", "r", "c")


define("cjk_items", ("items",), "cjk_items as (select page_id, item_no, x0, y0, x0 + 300 as x1, y1, case when item_no % 2 = 0 then '中文' || text else text end as text from items)")


@query(
    "line_veto",
    """with recursive cross_raw as (select l.page_id, l.x, i.x0, i.y0, i.x1, i.y1, min(i.item_no) as no from (select distinct page_id, x from cell_boxes) l join cjk_items i on i.page_id = l.page_id
 where i.item_no % 2 = 0 and i.x0 < l.x - 6 and i.x1 > l.x + 6 group by all),
 crossing as (select *, row_number() over (partition by page_id, x order by no) as n from cross_raw),
 walk(page_id, x, n, kept) as (select page_id, x, 0::bigint, []::struct(x0 bigint, y0 bigint, x1 bigint, y1 bigint)[] from (select distinct page_id, x from crossing)
 union all select w.page_id, w.x, c.n, case when len(list_filter(w.kept, lambda u: least(u.x1, c.x1) > greatest(u.x0, c.x0) and least(u.y1, c.y1) > greatest(u.y0, c.y0)
 and (least(u.x1, c.x1) - greatest(u.x0, c.x0)) * (least(u.y1, c.y1) - greatest(u.y0, c.y0)) / cast((u.x1 - u.x0) * (u.y1 - u.y0) + (c.x1 - c.x0) * (c.y1 - c.y0)
 - (least(u.x1, c.x1) - greatest(u.x0, c.x0)) * (least(u.y1, c.y1) - greatest(u.y0, c.y0)) as double) > 0.4)) > 0 then w.kept
 else list_append(w.kept, struct_pack(x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1)) end
 from walk w join crossing c on c.page_id = w.page_id and c.x = w.x and c.n = w.n + 1),
 last as (select page_id, x, max_by(len(kept), n) as k from walk group by 1, 2)
 select l.page_id, l.x, cast(coalesce(k, 0) as int) as crossings, coalesce(k, 0) < 4 as stays from (select distinct page_id, x from cell_boxes) l left join last using (page_id, x)""",
    ("cjk_items", "cell_boxes"),
)
def line_veto(t: Tables) -> DataFrame:
    even = F.col("item_no") % 2 == 0
    items = t.items.withColumns({"x1": F.col("x0") + 300, "text": F.when(even, F.concat(F.lit("中文"), "text")).otherwise(F.col("text"))})
    return layout.line_veto(t.cell_boxes.select("page_id", "x").distinct(), items)


define("bands", ("cell_boxes",), "bands as (select page_id, c, min(x) as b0, max(x + w) as b1 from cell_boxes group by 1, 2)")
define(
    "banded",
    ("boxes", "bands"),
    r"""banded as (select i.page_id, i.item_no, i.text, i.cx, i.x1, min(b.c) as c from (select * from boxes where not (regexp_full_match(text, '\d{1,6}') and item_no % 9 = 0 and cx > 850)) i
 join bands b on b.page_id = i.page_id and i.cx >= b.b0 - 4 and i.cx < b.b1 + 4 group by all)""",
)


def banded(t: Tables) -> DataFrame:
    code = F.when(F.col("item_no") % 9 == 0, F.col("text")).otherwise("")
    return layout.band_items(t.items.withColumn("line_code", code), layout.column_bands(t.cell_boxes), W)


@query("col_bands", "select page_id, item_no, c from banded", ("banded",))
def col_bands(t: Tables) -> DataFrame:
    return banded(t).select("page_id", "item_no", "c")


define("medians", ("banded",), "medians as (select page_id, c, quantile_cont(cast(x1 as double), 0.5) as ref from banded group by 1, 2 having count(*) >= 2)")


@query("col_median", "select * from medians", ("medians",))
def col_median(t: Tables) -> DataFrame:
    return layout.column_median(banded(t))


@query(
    "nearest_col",
    """with lim as (select page_id, greatest(40.0, 0.45 * case when count(*) > 1 then 1 else 200 end) as lim from medians group by 1)
 select b.page_id, b.item_no, b.c, cast(coalesce((select m.c from medians m, lim l where m.page_id = b.page_id and l.page_id = b.page_id and abs(b.x1 - m.ref) < l.lim order by abs(b.x1 - m.ref), m.c limit 1), b.c) as int) as new_c from banded b""",
    ("medians",),
)
def nearest_col(t: Tables) -> DataFrame:
    found = banded(t)
    return layout.nearest_column(found, layout.column_median(found)).select("page_id", "item_no", "c", "new_c")


define(
    "anchors",
    ("located",),
    """anchors as (select distinct page_id, r, c, case when page_id % 5 = 0 then 2.0::double else 1.1::double end * (c * 200 + 100) + page_id % 7 as ax, 0.9::double * (r * 100 + 50) + 3 as ay from located)""",
)


@query(
    "anchor_fit",
    """with fit as (select page_id, count(*) as n, regr_slope(ax, c * 200 + 100) as sx, regr_intercept(ax, c * 200 + 100) as ix, regr_slope(ay, r * 100 + 50) as sy, regr_intercept(ay, r * 100 + 50) as iy from anchors group by 1),
 ok as (select * from fit where n >= 4 and sx between 0.7 and 1.4 and sy between 0.7 and 1.4)
 select b.page_id, b.r, b.c, cast(coalesce(round_even(f.sx * b.x + f.ix, 0), b.x) as int) as x, cast(coalesce(round_even(f.sy * b.y + f.iy, 0), b.y) as int) as y,
 cast(coalesce(round_even(f.sx * (b.x + b.w) + f.ix - (f.sx * b.x + f.ix), 0), b.w) as int) as w, cast(coalesce(round_even(f.sy * (b.y + b.h) + f.iy - (f.sy * b.y + f.iy), 0), b.h) as int) as h,
 f.page_id is not null as fitted from cell_boxes b left join ok f on f.page_id = b.page_id""",
    ("anchors", "cell_boxes"),
)
def anchor_fit(t: Tables) -> DataFrame:
    p, r, c = F.col("page_id"), F.col("r"), F.col("c")
    anchors = layout.assign_cells(t.items, t.cell_boxes).select("page_id", "r", "c").distinct().withColumns({
        "ax": F.when(p % 5 == 0, 2.0).otherwise(1.1) * (c * 200 + 100) + p % 7, "ay": F.lit(0.9) * (r * 100 + 50) + 3,
    })
    return layout.anchor_fit(t.cell_boxes, anchors)


define("ys", ("items",), "ys as (select page_id, y0 as v, count(*) as n from items group by 1, 2)")
define(
    "cluster1",
    ("ys",),
    """cluster1 as (select page_id, cast(grp as int) as grp, sum(v * n) / sum(n) as centre, cast(sum(n) as bigint) as n from (select *, sum(s) over (partition by page_id order by v rows unbounded preceding) as grp
 from (select *, case when v - lag(v) over (partition by page_id order by v) > 10 then 1 else 0 end as s from ys)) group by 1, 2)""",
)


@query("cluster_1d", "select * from cluster1", ("cluster1",))
def cluster_1d(t: Tables) -> DataFrame:
    return layout.cluster_1d(t.items.select("page_id", F.col("y0").alias("v")), 10)


define(
    "line_pos",
    ("cluster1",),
    """line_pos as (with g as (select page_id, list(centre order by centre) as cs from cluster1 group by 1),
 gg as (select page_id, cs, list_sort(list_transform(range(2, len(cs) + 1), lambda i: cs[i] - cs[i - 1])) as g from g),
 lim as (select page_id, cs, case when len(cs) >= 3 then greatest(10.0::double, 0.35::double * case when len(g) >= 3 then g[(len(g) - 1) // 2 + 1] else g[len(g) // 2 + 1] end) else -1.0 end as gap from gg),
 v as (select page_id, gap, unnest(cs) as v from lim)
 select page_id, cast(grp as int) as line_no, cast(round_even(avg(v), 0) as int) as pos from (select *, sum(s) over (partition by page_id order by v rows unbounded preceding) as grp
 from (select *, case when v - lag(v) over (partition by page_id order by v) > gap then 1 else 0 end as s from v)) group by 1, 2)""",
)


@query("line_positions", "select * from line_pos", ("line_pos",))
def line_positions(t: Tables) -> DataFrame:
    return layout.line_positions(t.items.select("page_id", F.col("y0").alias("v")), 10.0)


@query(
    "suppress_near",
    """with recursive p as (select page_id, x0 as pos, max(score) as cover, row_number() over (partition by page_id order by x0) as n from items group by 1, 2),
 walk(page_id, n, pos, cover, grp) as (select page_id, n, pos, cover, 0 from p where n = 1 union all
 select p.page_id, p.n, case when p.pos - w.pos < 30 and p.cover <= w.cover then w.pos else p.pos end, case when p.pos - w.pos < 30 and p.cover <= w.cover then w.cover else p.cover end,
 case when p.pos - w.pos < 30 then w.grp else w.grp + 1 end from walk w join p on p.page_id = w.page_id and p.n = w.n + 1)
 select page_id, max_by(pos, n) as pos, max_by(cover, n) as cover from walk group by page_id, grp""",
    ("items",),
)
def suppress_near(t: Tables) -> DataFrame:
    return layout.suppress_near(t.items.select("page_id", F.col("x0").alias("pos"), F.col("score").alias("cover")), 30)


@query(
    "uniform_gaps",
    """with g as (select page_id, list(distinct x0 - x0 % 50 order by x0 - x0 % 50) as ps from items group by 1),
 gg as (select page_id, ps, list_sort(list_transform(range(2, len(ps) + 1), lambda i: ps[i] - ps[i - 1])) as g from g)
 select page_id, cast(len(ps) as int) as n_lines, coalesce(len(ps) >= 3 and not (g[greatest(1, len(g) // 2) // 2 + 1] > 0 and g[len(g)] >= 2.8 * g[greatest(1, len(g) // 2) // 2 + 1]), false) as uniform from gg""",
    ("items",),
)
def uniform_gaps(t: Tables) -> DataFrame:
    return layout.uniform_gaps(t.items.select("page_id", (F.col("x0") - F.col("x0") % 50).alias("pos")))


@query(
    "snap_lines",
    """select i.page_id, i.item_no, cast((select l.x // 200 from (select distinct page_id, x from cell_boxes) l where l.page_id = i.page_id and abs(l.x - i.x0) <= greatest(6, 200 // 2)
 order by abs(l.x - i.x0), l.x limit 1) as int) as line_index from items i""",
    ("items", "cell_boxes"),
)
def snap_lines(t: Tables) -> DataFrame:
    lines = t.cell_boxes.select("page_id", F.col("x").alias("pos")).distinct()
    values = t.items.select("page_id", "item_no", F.col("x0").alias("v"))
    return layout.snap_lines(values, lines).select("page_id", "item_no", "line_index")


define("ord_boxes", ("boxes",), "ord_boxes as (select *, row_number() over (partition by page_id order by cy, item_no) as n from boxes)")


@query(
    "text_lines",
    """with recursive walk(page_id, n, item_no, line_no, acy, ah) as (select page_id, n, item_no, 0, cy, h from ord_boxes where n = 1 union all
 select o.page_id, o.n, o.item_no, case when abs(o.cy - w.acy) < greatest(6.0::double, 0.6::double * greatest(o.h, w.ah)) then w.line_no else w.line_no + 1 end,
 case when abs(o.cy - w.acy) < greatest(6.0::double, 0.6::double * greatest(o.h, w.ah)) then w.acy else o.cy end, case when abs(o.cy - w.acy) < greatest(6.0::double, 0.6::double * greatest(o.h, w.ah)) then w.ah else o.h end
 from walk w join ord_boxes o on o.page_id = w.page_id and o.n = w.n + 1)
 select w.page_id, w.line_no, string_agg(b.text, ' ' order by b.cx, b.cy, b.item_no) as text, min(b.score) as score, min(b.x0) as x0, min(b.y0) as y0, max(b.x1) as x1, max(b.y1) as y1
 from walk w join boxes b using (page_id, item_no) group by 1, 2""",
    ("ord_boxes",),
)
def text_lines(t: Tables) -> DataFrame:
    return layout.text_lines(t.items)


define("merged", ("located",), """merged as (with recursive o as (select page_id, r, c, cy, row_number() over (partition by page_id, r, c order by cy) as n from (select distinct page_id, r, c, cy from located)),
 walk(page_id, r, c, n, cy, acy) as (select page_id, r, c, n, cy, cy from o where n = 1 union all select o.page_id, o.r, o.c, o.n, o.cy, case when o.cy - w.acy < 8 then w.acy else o.cy end
 from walk w join o on o.page_id = w.page_id and o.r = w.r and o.c = w.c and o.n = w.n + 1)
 select l.page_id, l.r, l.c, string_agg(l.text, '' order by w.acy, l.cx, l.cy, l.item_no) as text, min(l.score) as score from located l join walk w on w.page_id = l.page_id and w.r = l.r and w.c = l.c and w.cy = l.cy group by 1, 2, 3)""")


@query("merge_fragments", "select * from merged", ("merged",))
def merge_fragments(t: Tables) -> DataFrame:
    return layout.merge_fragments(layout.assign_cells(t.items, t.cell_boxes))


define("grid_text", ("merged", "cell_boxes"), "grid_text as (select b.page_id, b.r, b.c, coalesce(m.text, '') as text, m.score from cell_boxes b left join merged m using (page_id, r, c))")


def grid_text(t: Tables) -> DataFrame:
    return layout.items_to_grid(t.items, t.cell_boxes)


@query("items_to_grid", "select * from grid_text", ("grid_text",))
def items_to_grid(t: Tables) -> DataFrame:
    return grid_text(t)


PHOTO = """photo_med as (select page_id, h as med_h from (select page_id, h, row_number() over (partition by page_id order by h) as k, count(*) over (partition by page_id) as n from boxes) where k = n // 2 + 1),
 photo_walk as (with recursive w(page_id, n, item_no, line_no, mean, m) as (select page_id, n, item_no, 0, cy, 1 from ord_boxes where n = 1 union all
 select o.page_id, o.n, o.item_no, case when o.cy - w.mean <= 0.6::double * greatest(p.med_h, o.h) then w.line_no else w.line_no + 1 end,
 case when o.cy - w.mean <= 0.6::double * greatest(p.med_h, o.h) then (w.mean * w.m + o.cy) / (w.m + 1) else o.cy end, case when o.cy - w.mean <= 0.6::double * greatest(p.med_h, o.h) then w.m + 1 else 1 end
 from w join ord_boxes o on o.page_id = w.page_id and o.n = w.n + 1 join photo_med p on p.page_id = w.page_id) select * from w),
 photo_raw as (select page_id, line_no, max_by(mean, m) as y, max(m) as n from photo_walk group by 1, 2),
 photo_gap as (select page_id, list_sort(list(y - py) filter (py is not null)) as g, count(*) as k from (select *, lag(y) over (partition by page_id order by line_no) as py from photo_raw) group by 1),
 photo_merge as (with recursive m(page_id, line_no, merged_no, y, n) as (select page_id, line_no, 0, y, n from photo_raw where line_no = 0 union all
 select r.page_id, r.line_no, case when g.k >= 3 and r.y - m.y <= 0.5::double * g.g[len(g.g) // 2 + 1] then m.merged_no else m.merged_no + 1 end,
 case when g.k >= 3 and r.y - m.y <= 0.5::double * g.g[len(g.g) // 2 + 1] then (m.y * m.n + r.y * r.n) / (m.n + r.n) else r.y end, case when g.k >= 3 and r.y - m.y <= 0.5::double * g.g[len(g.g) // 2 + 1] then m.n + r.n else r.n end
 from m join photo_raw r on r.page_id = m.page_id and r.line_no = m.line_no + 1 join photo_gap g on g.page_id = m.page_id) select * from m),
 photo_y as (select page_id, merged_no as line_no, max_by(y, line_no) as y from photo_merge group by 1, 2),
 photo_tol as (select y.page_id, greatest(case when y.k >= 3 then 0.55::double * y.g[len(y.g) // 2 + 1] else p.med_h end, 0.8::double * p.med_h) as tol
 from (select page_id, list_sort(list(y - py) filter (py is not null)) as g, count(*) as k from (select *, lag(y) over (partition by page_id order by line_no) as py from photo_y) group by 1) y join photo_med p using (page_id)),
 photo_items as (select b.*, pm.merged_no as line_no from photo_walk w join photo_merge pm on pm.page_id = w.page_id and pm.line_no = w.line_no join boxes b on b.page_id = w.page_id and b.item_no = w.item_no),
 photo_lines as (select i.page_id, i.line_no, any_value(y.y) as y, any_value(tl.tol) as tol, coalesce(arg_min(i.text, i.n) filter (regexp_full_match(i.text, '\\d{3,}')), '') as code, '' as name,
 string_agg(i.text, '' order by i.cx, i.cy, i.item_no) as text from (select p.*, o.n from photo_items p join ord_boxes o using (page_id, item_no)) i join photo_y y on y.page_id = i.page_id and y.line_no = i.line_no join photo_tol tl on tl.page_id = i.page_id group by 1, 2)"""
define("photo_lines", ("ord_boxes",), PHOTO)


@query("photo_lines", "select page_id, line_no, round(y, 6) as y, round(tol, 6) as tol, code, name, text from photo_lines", ("photo_lines",))
def photo_lines(t: Tables) -> DataFrame:
    found = layout.photo_lines(t.items)
    return found.withColumns({"y": F.round("y", 6), "tol": F.round("tol", 6)})


define("num_located", ("located",), "num_located as (select page_id, r, c, item_no, cx, x1, case when item_no % 4 = 0 then text else cast(item_no * 7 % 1000 as varchar) || '.' || item_no % 10 end as text from located)")


@query(
    "overlap_frag",
    r"""with p as (select *, lead(cx) over w as ncx, lead(x1) over w as nx1, lead(text) over w as nt from num_located window w as (partition by page_id, r, c order by cx, item_no))
 select page_id, r, c, bool_or(coalesce(regexp_full_match(text, '[\d,.+\-]+') and regexp_full_match(nt, '[\d,.+\-]+') and x1 - (2 * ncx - nx1) >= greatest(2.0, 0.15 * least(x1 - (2 * cx - x1), nx1 - (2 * ncx - nx1)))
 and (right(text, 1) = left(nt, 1) or (length(text) >= 2 and length(nt) >= 2 and right(text, 2) = left(nt, 2)) or (length(text) >= 3 and length(nt) >= 3 and right(text, 3) = left(nt, 3))), false)) as overlaps from p group by 1, 2, 3""",
    ("num_located",),
)
def overlap_frag(t: Tables) -> DataFrame:
    n = F.col("item_no")
    text = F.when(n % 4 == 0, F.col("text")).otherwise(F.concat((n * 7 % 1000).cast("string"), F.lit("."), (n % 10).cast("string")))
    return layout.overlapping_fragments(layout.assign_cells(t.items, t.cell_boxes).withColumn("text", text))


@query(
    "table_gate",
    """with col as (select page_id, c, count(*) as n, count(*) filter (text <> '' and r < 2 + page_id % 13) as f, max(r) as hi, min(r) as lo from grid_text group by 1, 2)
 select page_id, sum(f) / sum(n) as fill, max(hi) - min(lo) + 1 >= 2 and count(*) >= 2 and sum(f) / sum(n) >= 0.5 and count(*) filter (f >= 2) >= 2 as is_table from col group by 1""",
    ("grid_text",),
)
def table_gate(t: Tables) -> DataFrame:
    # Whole grids; lower rows are blank on some pages, so that both verdicts occur.
    blanked = F.when(F.col("r") < 2 + F.col("page_id") % 13, F.col("text")).otherwise("")
    return layout.table_gate(grid_text(t).withColumn("text", blanked))


@query(
    "header_rows",
    r"""select page_id, coalesce(min(r) filter (c = 0 and r < 4 and regexp_full_match(text, '\d+')), 4) as header_rows from grid_text group by 1""",
    ("grid_text",),
)
def header_rows(t: Tables) -> DataFrame:
    return layout.header_rows(grid_text(t))


define(
    "codes_grid",
    ("grid_text",),
    """codes_grid as (select page_id, r, c, case when c = 0 then case when r < page_id % 4 then '' else cast(11000 + r as varchar) end when c = 4 and page_id % 2 = 0 then cast(11000 + r as varchar)
 when c = 3 and page_id % 3 = 0 then '科目名称' || r when c = 2 then text else cast(r as varchar) || '.5' end as text from grid_text)""",
)


def codes_grid(t: Tables) -> DataFrame:
    r, c, p = F.col("r"), F.col("c"), F.col("page_id")
    code = (11000 + r).cast("string")
    text = (
        F.when(c == 0, F.when(r < p % 4, "").otherwise(code)).when((c == 4) & (p % 2 == 0), code)
        .when((c == 3) & (p % 3 == 0), F.concat(F.lit("科目名称"), r)).when(c == 2, F.col("text")).otherwise(F.concat(r, F.lit(".5")))
    )
    return grid_text(t).withColumn("text", text)


@query(
    "value_columns",
    """select page_id, c, not (c = 4 and page_id % 2 = 0) and not (c = 3 and page_id % 3 = 0) and not (c = 2 and dup) as is_value from
 (select g.page_id, g.c, coalesce(avg(case when g.text <> '' then case when k.text <> '' and abs(length(g.text) - length(k.text)) <= 1 and (g.text = k.text or
 list_sum(list_transform(range(1, least(length(g.text), length(k.text)) + 1), lambda i: case when g.text[i] = k.text[i] then 1 else 0 end)) / greatest(length(g.text), length(k.text)) >= 0.7) then 1 else 0 end end) >= 0.7, false) as dup
 from codes_grid g join codes_grid k on k.page_id = g.page_id and k.r = g.r and k.c = 0 where g.c > 0 group by 1, 2)""",
    ("codes_grid",),
)
def value_columns(t: Tables) -> DataFrame:
    return layout.value_columns(codes_grid(t))


@query(
    "cell_flags",
    r"""with f as (select * from grid_text where text <> ''), k as (select page_id, c, avg(case when regexp_full_match(text, '\d+') then 1 else 0 end) >= 0.6 as num from f group by 1, 2)
 select f.page_id, f.r, f.c, f.text, k.num and not regexp_full_match(f.text, '\d+') as outlier, coalesce(f.score < 0.8::double, false) as low_score from f join k using (page_id, c)""",
    ("grid_text",),
)
def cell_flags(t: Tables) -> DataFrame:
    return layout.cell_flags(grid_text(t))


@query(
    "min_conf",
    "select page_id, r, c, score, min(score) over (partition by page_id) as page_score from merged",
    ("merged",),
)
def min_conf(t: Tables) -> DataFrame:
    return layout.min_confidence(layout.assign_cells(t.items, t.cell_boxes))


@query(
    "promote_title",
    """select page_id, cast(case when page_id % 3 = 0 then r - 1 else r end as int) as r, c, text, case when page_id % 3 = 0 then '标题' || page_id end as title
 from (select page_id, r, c, case when r = 0 then case when c = 1 then '标题' || page_id else '' end else text end as text from grid_text) where page_id % 3 <> 0 or r > 0""",
    ("grid_text",),
)
def promote_title(t: Tables) -> DataFrame:
    title = F.when(F.col("c") == 1, F.concat(F.lit("标题"), "page_id")).otherwise("")
    grid = grid_text(t).withColumn("text", F.when(F.col("r") == 0, title).otherwise(F.col("text")))
    merges = t.cell_boxes.filter("r = 0 and c = 0").select("page_id", "r", "c", F.when(F.col("page_id") % 3 == 0, 5).otherwise(2).alias("cspan"))
    return layout.promote_title(grid, merges)


@query(
    "pick_title",
    r"""select page_id, arg_min(text, [-(h * case when y0 < 200 then 1.15::double else 1.0::double end), cast(item_no as double)]) as title from boxes where length(regexp_replace(text, '[\s0-9]+', '', 'g')) >= 2 group by 1""",
    ("boxes",),
)
def pick_title(t: Tables) -> DataFrame:
    boxes = layout.placed(t.items).select("page_id", F.col("item_no").alias("seq"), "text", "h", (F.col("y0") < 200).alias("in_band"))
    return layout.pick_title(boxes)


@query(
    "page_mode",
    """with g as (select page_id, sum(f) / sum(n) >= 0.5 and count(*) filter (f >= 2) >= 2 as ok from (select page_id, c, count(*) as n, count(*) filter (text <> '') as f from grid_text group by 1, 2) group by 1)
 select l.page_id, case when l.n >= 3 and l.m >= 3 then 'table' when g.ok then 'borderless' else 'text' end as mode from (select page_id, count(distinct (y0 // 50)) as n, count(distinct (x0 // (100 + 300 * (page_id % 4)))) as m from items group by 1) l join g using (page_id)""",
    ("grid_text", "items"),
)
def page_mode(t: Tables) -> DataFrame:
    # Places are counted on a raster that differs by page, so that several modes occur.
    across = F.floor(F.col("x0") / (100 + 300 * (F.col("page_id") % 4)))
    counts = t.items.groupBy("page_id").agg(F.count_distinct(F.floor(F.col("y0") / 50)).alias("n_y"), F.count_distinct(across).alias("n_x"))
    return layout.page_mode(counts.join(layout.table_gate(grid_text(t)), "page_id"))


define(
    "turns",
    ("items",),
    """turns as (select page_id, cast(item_no % 4 as int) as turn, sum(length(text)) * avg(score) * case when avg(case when y1 - y0 > 1.2 * (x1 - x0 - 20) then 1 else 0 end) > 0.5 then 0.5 else 1 end as q,
 count(*) as n, avg(score) as m, avg(case when y1 - y0 > 1.2 * (x1 - x0 - 20) then 1 else 0 end) as tall from items group by 1, 2)""",
)


@query(
    "pick_turn",
    """with z as (select p.page_id, coalesce(t.q, 0) as q0, coalesce(t.tall, 0) as tall0 from (select distinct page_id from turns) p left join turns t on t.page_id = p.page_id and t.turn = 0),
 s as (select t.*, z.q0, z.tall0, row_number() over (partition by t.page_id order by q desc) as k, lead(q) over (partition by t.page_id order by q desc) as nq from turns t join z using (page_id) where t.turn in (0, 2) or z.tall0 > 0.5 or z.q0 < 24),
 f as (select t.*, row_number() over (partition by t.page_id order by q desc) as k from turns t join z using (page_id) where t.turn in (0, 2) or z.tall0 > 0.5)
 select z.page_id, cast(case when s.n >= 4 and s.m >= 0.85 and s.q >= greatest(24, 1.6 * coalesce(s.nq, 0)) then s.turn when f.q > z.q0 and f.q >= greatest(12, 1.35 * z.q0) then f.turn else 0 end as int) as turn
 from z left join s on s.page_id = z.page_id and s.k = 1 left join f on f.page_id = z.page_id and f.k = 1""",
    ("turns",),
)
def pick_turn(t: Tables) -> DataFrame:
    # Boxes are narrowed by 20 so that tall ones occur.
    probes = t.items.withColumns({"turn": (F.col("item_no") % 4).cast("int"), "x1": F.col("x1") - 20})
    return layout.pick_turn(layout.turn_quality(probes))


@query(
    "topk_area",
    """select page_id, item_no, (x1 - x0) * (y1 - y0) as area, cast(k as int) as rank from (select *, row_number() over (partition by page_id order by (x1 - x0) * (y1 - y0) desc, item_no) as k from items) where k <= 12""",
    ("items",),
)
def topk_area(t: Tables) -> DataFrame:
    return layout.top_by_area(t.items, 12).select("page_id", "item_no", "area", "rank")
