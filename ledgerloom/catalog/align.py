"""Template matching and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.layout import codes_grid, grid_text
from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import Tables
from ledgerloom.operators import align, layout
from ledgerloom.scale import materialized

define(
    "tpl",
    ("tpl_rows",),
    "tpl as (select doc, page, r, case when r % 10 = 9 then '' else code end as code, case when r % 10 = 9 then '合计' || name else name end as name from tpl_rows)",
)
define("pairing", ("items",), "pairing as (select distinct page_id, 'DOC' as doc, 'P' || page_id % 4 as page from items)")
# Lines whose first code is taken apart so that later stages have work: every third line keeps only a near code.
define(
    "lines",
    ("photo_lines",),
    """lines as (select page_id, line_no, y, tol, case when line_no % 3 = 1 and code <> '' then left(code, 4) || '9' when line_no % 7 = 3 and code <> '' then '88' || right(code, 2) else code end as code, name, text from photo_lines)""",
)
define(
    "exact",
    ("tpl", "pairing", "lines"),
    """exact as (select p.page_id, t.r, l.line_no from pairing p join (select *, row_number() over (partition by doc, page, code order by r) as k from tpl where code <> '') t using (doc, page)
 join (select *, row_number() over (partition by page_id, code order by line_no) as k from lines where code <> '') l on l.page_id = p.page_id and l.code = t.code and l.k = t.k)""",
)


def tpl(t: Tables) -> DataFrame:
    total = F.col("r") % 10 == 9
    return t.tpl_rows.select(
        "doc", "page", "r", F.when(total, "").otherwise(F.col("code")).alias("code"),
        F.when(total, F.concat(F.lit("合计"), "name")).otherwise(F.col("name")).alias("name"),
    )


def pairing(t: Tables) -> DataFrame:
    return t.items.select("page_id", F.lit("DOC").alias("doc"), F.concat(F.lit("P"), F.col("page_id") % 4).alias("page")).distinct()


def lines(t: Tables) -> DataFrame:
    """The page's text lines, written once per query: several joins read them."""
    if "_lines" not in t.__dict__:
        t.__dict__["_lines"] = materialized(_lines(t))
    return t.__dict__["_lines"]


def _lines(t: Tables) -> DataFrame:
    near = F.concat(F.left("code", F.lit(4)), F.lit("9"))
    return layout.photo_lines(t.items).withColumn(
        "code",
        F.when((F.col("line_no") % 3 == 1) & (F.col("code") != ""), near)
        .when((F.col("line_no") % 7 == 3) & (F.col("code") != ""), F.concat(F.lit("88"), F.right("code", F.lit(2)))).otherwise(F.col("code")),
    )


@query("align_exact", "select * from exact", ("exact",))
def align_exact(t: Tables) -> DataFrame:
    return align.align_exact(pairing(t), tpl(t), lines(t))


_SAME = "list_sum(list_transform(range(1, least(length(t.code), length(l.code)) + 1), lambda i: case when t.code[i] = l.code[i] then 1 else 0 end)) / greatest(length(t.code), length(l.code))"
FUZZY = f"""with recursive cand as (select p.page_id, t.r, list(l.line_no order by l.line_no) as ls, row_number() over (partition by p.page_id order by t.r) as n
 from pairing p join tpl t using (doc, page) join lines l on l.page_id = p.page_id where t.code <> ''
 and not exists (select 1 from exact e where e.page_id = p.page_id and e.r = t.r) and not exists (select 1 from exact e where e.page_id = l.page_id and e.line_no = l.line_no)
 and ((length(t.name) >= 3 and (contains(l.code || l.name, t.name) or contains(t.name, l.code || l.name))) or (l.code = '' and contains(l.text, t.code)) or (l.code <> '' and (t.code = l.code
 or (length(l.code) >= 3 and contains(t.code, l.code) and length(t.code) - length(l.code) <= length(t.code) * 0.6) or (length(t.code) >= 3 and contains(l.code, t.code) and length(l.code) - length(t.code) <= length(l.code) * 0.6)
 or (abs(length(t.code) - length(l.code)) <= 1 and {_SAME} >= 0.75)))) group by 1, 2),
 walk(page_id, n, r, used, got) as (select page_id, 0::bigint, null::int, []::int[], null::int from (select distinct page_id from cand)
 union all select w.page_id, c.n, c.r, case when f.f is null then w.used else list_append(w.used, f.f) end, f.f from walk w join cand c on c.page_id = w.page_id and c.n = w.n + 1,
 lateral (select list_filter(c.ls, lambda k: not list_contains(w.used, k))[1] as f) f)
 select page_id, r, line_no, 'code' as stage from exact union all select page_id, r, got, 'key' from walk where got is not null"""


@query("align_fuzzy", FUZZY, ("exact",))
def align_fuzzy(t: Tables) -> DataFrame:
    return align.align_fuzzy(pairing(t), tpl(t), lines(t))


define(
    "library",
    (),
    """named as (select *, p_name || '-' || translate(cast(p_partkey as varchar), '0123456789', 'abcdefghij') as name, cast(11000000 + p_partkey * 7 as varchar) as own, p_partkey // 40 % 6 as how from part),
library as (select 'LIB' as doc, 'T' || p_partkey % 4 as page, cast(p_partkey // 4 as int) as r, case when p_partkey % 11 = 10 then '' else own end as code, name from named),
library_lines as (select p_partkey % 40 as page_id, cast(p_partkey // 40 as int) as line_no, case how when 0 then own when 1 then left(own, 6) || 'x' || right(own, 1) when 2 then right(own, 4) else '' end as code,
 case how when 3 then name when 4 then left(name, 4) || '##' || substr(name, 7) when 5 then '' else left(name, 2) end as name, case how when 5 then '#' || own || ';' else null end as text from named)""",
)
_POSITIONS = "list_sum(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: case when {a}[i] = {b}[i] then 1 else 0 end)) / greatest(length({a}), length({b}))"
_INSIDE = "(length({a}) >= 3 and contains({b}, {a}) and length({b}) - length({a}) <= length({b}) * 0.6::double)"
_KEYS = "({k} <> '' and (tk = {k} or " + _INSIDE.format(a="td", b="{d}") + " or " + _INSIDE.format(a="{d}", b="td") + " or (abs(length(tk) - length({k})) <= 1 and " + _POSITIONS.format(a="tk", b="{k}") + " >= 0.75::double)))"
_CODE_OF = r"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')"
_DIGITS_OF = r"regexp_replace({x}, '[^0-9]', '', 'g')"
# Pairs of every open row with every spare line of its page, row by row in order; then the names.
LIBRARY = f"""with recursive l_exact as (select l.page_id, t.r, l.line_no from library_lines l join library t on t.page = 'T' || l.page_id % 4 and t.code = l.code where l.code <> ''),
t as (select *, replace(name, ' ', '') as sq, {_CODE_OF.format(x="code")} as tk, {_DIGITS_OF.format(x="code")} as td from library where code <> ''),
l as (select *, replace(name, ' ', '') as sq, {_CODE_OF.format(x="code")} as k, {_CODE_OF.format(x="code || name")} as kb, {_DIGITS_OF.format(x="code")} as d, {_DIGITS_OF.format(x="code || name")} as db, code || name as whole
 from library_lines x where not exists (select 1 from l_exact e where e.page_id = x.page_id and e.line_no = x.line_no)),
open as (select p.page_id, t.* from (select distinct page_id from library_lines) p join t on t.page = 'T' || p.page_id % 4 where not exists (select 1 from l_exact e where e.page_id = p.page_id and e.r = t.r)),
same as (select o.page_id, o.r, l.line_no, o.name <> '' and l.name <> '' and (o.sq = l.sq or (length(o.sq) >= 4 and length(l.sq) >= 4 and {_POSITIONS.format(a="o.sq", b="l.sq")} >= 0.8::double)) as by_name,
 (l.whole <> '' and (({_KEYS.format(k="kb", d="db")}) or contains(whole, o.name) or contains(o.name, whole) or ({_KEYS.format(k="k", d="d")})))
 or (l.code = '' and l.text is not null and contains(l.text, o.code)) or (l.whole = '') as by_key from open o join l on l.page_id = o.page_id),
cand as (select page_id, r, list(line_no order by line_no) as ls, row_number() over (partition by page_id order by r) as n from same where by_key or by_name group by page_id, r),
walk(page_id, n, r, used, got) as (select page_id, 0::bigint, null::int, []::int[], null::int from (select distinct page_id from cand)
 union all select w.page_id, c.n, c.r, case when f.f is null then w.used else list_append(w.used, f.f) end, f.f from walk w join cand c on c.page_id = w.page_id and c.n = w.n + 1,
 lateral (select list_filter(c.ls, lambda k: not list_contains(w.used, k))[1] as f) f),
last as (select page_id, arg_max(used, n) as used from walk group by page_id),
names as (select o.page_id, o.r, l.line_no, row_number() over (partition by o.page_id order by o.r, l.line_no) as n from (select p.page_id, t.*, replace(t.name, ' ', '') as sq from (select distinct page_id from library_lines) p join library t on t.page = 'T' || p.page_id % 4 where t.code = '') o
 join l on l.page_id = o.page_id where l.name <> '' and (o.sq = l.sq or (length(o.sq) >= 4 and length(l.sq) >= 4 and {_POSITIONS.format(a="o.sq", b="l.sq")} >= 0.8::double))),
second(page_id, n, rows_used, lines_used, r, got) as (select p.page_id, 0::bigint, []::int[], coalesce(last.used, []::int[]), null::int, null::int from (select distinct page_id from names) p left join last using (page_id)
 union all select s.page_id, c.n, case when f.ok then list_append(s.rows_used, c.r) else s.rows_used end, case when f.ok then list_append(s.lines_used, c.line_no) else s.lines_used end, case when f.ok then c.r end, case when f.ok then c.line_no end
 from second s join names c on c.page_id = s.page_id and c.n = s.n + 1, lateral (select not list_contains(s.rows_used, c.r) and not list_contains(s.lines_used, c.line_no) as ok) f)
select page_id, r, line_no, 'code' as stage from l_exact union all select page_id, r, got, 'key' from walk where got is not null union all select page_id, r, got, 'name' from second where got is not null"""


def library_pages(t: Tables) -> DataFrame:
    return t.library_lines.select("page_id", F.lit("LIB").alias("doc"), F.concat(F.lit("T"), F.col("page_id") % 4).alias("page")).distinct()


@query("align_library", LIBRARY, ("library",))
def align_library(t: Tables) -> DataFrame:
    """All three stages on a library that grows with the parts: codes, row keys and, for rows without a code, names."""
    return align.align_fuzzy(library_pages(t), t.library, t.library_lines)


@query(
    "library_hits",
    f"""select distinct l.page_id, t.code from library_lines l join (select distinct code from library where code <> '') t on l.code <> '' and
 (l.code = t.code or (abs(length(l.code) - length(t.code)) <= 1 and {_POSITIONS.format(a="l.code", b="t.code")} >= 0.7::double))""",
    ("library",),
)
def library_hits(t: Tables) -> DataFrame:
    """Template codes seen on the pages, where all codes begin alike."""
    return align.template_hits(t.library_lines.select("page_id", F.col("code").alias("text")), t.library)


@query(
    "align_anti",
    """select p.page_id, t.r as no, t.code, 'template' as side from pairing p join tpl t using (doc, page) where t.code <> '' and not exists (select 1 from exact e where e.page_id = p.page_id and e.r = t.r)
 union all select l.page_id, l.line_no, l.code, 'line' from lines l where l.code <> '' and not exists (select 1 from exact e where e.page_id = l.page_id and e.line_no = l.line_no)""",
    ("exact",),
)
def align_anti(t: Tables) -> DataFrame:
    aligned = align.align_exact(pairing(t), tpl(t), lines(t))
    rows = align.unmatched_rows(pairing(t), tpl(t), aligned).select("page_id", F.col("r").alias("no"), "code", F.lit("template").alias("side"))
    extra = align.extra_lines(lines(t), aligned).select("page_id", F.col("line_no").alias("no"), "code", F.lit("line").alias("side"))
    return rows.unionByName(extra)


@query(
    "unknown_lines",
    """select l.page_id, l.line_no, l.code from lines l join pairing p using (page_id) where l.code <> '' and not exists (select 1 from exact e where e.page_id = l.page_id and e.line_no = l.line_no)
 and not exists (select 1 from tpl t where t.doc = p.doc and t.page = p.page and t.code <> '' and (t.code = l.code or (abs(length(t.code) - length(l.code)) <= 1 and
 list_sum(list_transform(range(1, least(length(t.code), length(l.code)) + 1), lambda i: case when t.code[i] = l.code[i] then 1 else 0 end)) / greatest(length(t.code), length(l.code)) >= 0.75)))""",
    ("exact",),
)
def unknown_lines(t: Tables) -> DataFrame:
    aligned = align.align_exact(pairing(t), tpl(t), lines(t))
    return align.unknown_lines(pairing(t), tpl(t), lines(t), aligned)


@query(
    "align_report",
    """select p.page_id, (select count(*) from exact e where e.page_id = p.page_id) as matched,
 (select count(*) from tpl t where t.doc = p.doc and t.page = p.page and t.code <> '') - (select count(distinct r) from exact e where e.page_id = p.page_id) as unmatched,
 (select count(*) from lines l where l.page_id = p.page_id and l.code <> '') - (select count(distinct line_no) from exact e where e.page_id = p.page_id) as extra from pairing p""",
    ("exact",),
)
def align_report(t: Tables) -> DataFrame:
    aligned = align.align_exact(pairing(t), tpl(t), lines(t))
    return align.align_report(pairing(t), tpl(t), lines(t), aligned)


@query(
    "key_score",
    """select p.page_id, case when c.n > 0 then (least(1.0::double, coalesce(u.n, 0) / c.n) + coalesce(u.n, 0) / greatest(1, coalesce(k.n, 0))) / 2 else 0 end as score from pairing p
 left join (select page_id, count(*) as n from exact group by 1) u using (page_id) join (select page_id, count(*) filter (code <> '') as n from lines group by 1) c using (page_id)
 left join (select doc, page, count(*) as n from tpl where code <> '' group by 1, 2) k on k.doc = p.doc and k.page = p.page""",
    ("exact",),
)
def key_score(t: Tables) -> DataFrame:
    aligned = align.align_exact(pairing(t), tpl(t), lines(t))
    return align.key_score(pairing(t), tpl(t), lines(t), aligned)


INTERP = """with recursive anch as (select e.page_id, e.r, l.y, e.line_no from exact e join lines l using (page_id, line_no)),
 span as (select page_id, min(r) as lo, max(r) as hi from anch group by 1),
 gap as (select page_id, 1.3::double * coalesce(g[len(g) // 2 + 1], 20) as reach from (select page_id, list_sort(list(y - py) filter (py is not null)) as g from (select *, lag(y) over (partition by page_id order by line_no) as py from lines) group by 1)),
 need as (select p.page_id, t.r, row_number() over (partition by p.page_id order by t.r) as n from pairing p join tpl t using (doc, page) where t.code = '' and p.page_id in (select page_id from anch)),
 want as (select n.page_id, n.r, n.n, case when n.r <= s.lo then (select y from anch a where a.page_id = n.page_id and a.r = s.lo) when n.r >= s.hi then (select y from anch a where a.page_id = n.page_id and a.r = s.hi)
 else (select lo.y + (hi.y - lo.y) * (n.r - lo.r) / (hi.r - lo.r) from anch lo, anch hi where lo.page_id = n.page_id and hi.page_id = n.page_id and lo.r < n.r and hi.r > n.r order by lo.r desc, hi.r limit 1) end as y
 from need n join span s using (page_id)),
 cand as (select w.page_id, w.n, w.r, list(l.line_no order by abs(l.y - w.y), l.line_no) as ls from want w join gap g using (page_id) join lines l on l.page_id = w.page_id and abs(l.y - w.y) <= g.reach
 where not exists (select 1 from exact e where e.page_id = l.page_id and e.line_no = l.line_no) group by 1, 2, 3),
 walk(page_id, n, r, used, got) as (select page_id, 0::bigint, null::int, []::int[], null::int from span
 union all select w.page_id, x.n, x.r, case when f.f is null then w.used else list_append(w.used, f.f) end, f.f from walk w join want x on x.page_id = w.page_id and x.n = w.n + 1
 left join cand c on c.page_id = x.page_id and c.n = x.n, lateral (select list_filter(c.ls, lambda k: not list_contains(w.used, k))[1] as f) f)
 select page_id, r, got as line_no from walk where got is not null"""


@query("interp_fill", INTERP, ("exact",))
def interp_fill(t: Tables) -> DataFrame:
    aligned = align.align_exact(pairing(t), tpl(t), lines(t))
    return align.claim_nearest(pairing(t), tpl(t), lines(t), aligned)


_LIKE = """(i.text = t.code or (abs(length(i.text) - length(t.code)) <= 1 and list_sum(list_transform(range(1, least(length(i.text), length(t.code)) + 1), lambda k: case when i.text[k] = t.code[k] then 1 else 0 end)) / greatest(length(i.text), length(t.code)) >= 0.7))"""
define(
    "hits",
    ("items", "tpl"),
    f"hits as (select distinct i.page_id, t.code from (select distinct page_id, text from items where item_no % 7 <> 0 and text <> '--') i join (select distinct code from tpl where code <> '') t on {_LIKE})",
)
define(
    "scores",
    ("hits",),
    """scores as (select h.page_id, t.doc, t.page, count(*) / (select count(*) from tpl x where x.doc = t.doc and x.page = t.page and x.code <> '') as score from hits h join tpl t using (code) group by 1, 2, 3)""",
)


def read_texts(t: Tables) -> DataFrame:
    """Items whose text was read; every seventh is blank."""
    return t.items.withColumn("text", F.when(F.col("item_no") % 7 == 0, "--").otherwise(F.col("text")))


@query("tpl_hit", "select * from hits", ("hits",))
def tpl_hit(t: Tables) -> DataFrame:
    return align.template_hits(read_texts(t), tpl(t))


@query("tpl_score", "select * from scores", ("scores",))
def tpl_score(t: Tables) -> DataFrame:
    return align.template_scores(read_texts(t), tpl(t))


@query("tpl_best", "select * from scores where score >= 0.5 qualify row_number() over (partition by page_id order by score desc, doc, page) = 1", ("scores",))
def tpl_best(t: Tables) -> DataFrame:
    return align.best_template(align.template_scores(read_texts(t), tpl(t)), 0.5)


define(
    "struct_anchors",
    ("codes_grid",),
    """struct_anchors as (select page_id, r, text as tpl_text, case when r % 3 = 0 then 'zz' else ' ' || text end as text, r >= page_id % 14 as visible from codes_grid where c in (0, 1) and text <> '')""",
)


@query(
    "struct_score",
    """select page_id, case when v < 4 or v < n * 0.3 then 0.0::double else h / v end as score, case when v < 4 or v < n * 0.3 then 0.0::double else h / v end >= 0.55 as accepted from
 (select page_id, count(*) as n, count(*) filter (visible) as v, count(*) filter (visible and tpl_text = trim(text)) as h from struct_anchors group by 1)""",
    ("struct_anchors",),
)
def struct_score(t: Tables) -> DataFrame:
    r = F.col("r")
    anchors = codes_grid(t).filter("c in (0, 1) and text <> ''").select(
        "page_id", "r", F.col("text").alias("tpl_text"), F.when(r % 3 == 0, "zz").otherwise(F.concat(F.lit(" "), "text")).alias("text"),
        (r >= F.col("page_id") % 14).alias("visible"),
    )
    return align.structure_score(anchors)


define("tpl_cells", ("codes_grid",), "tpl_cells as (select page_id, r, c, text, case when c = 3 then 'num' else 'struct' end as kind from codes_grid)")
define("read_cells", ("grid_text",), "read_cells as (select page_id, r, c, case when r % 4 = 0 then '--' when r % 4 = 1 then '1,' || lpad(cast(r as varchar), 3, '0') || ' .5' else text end as text from grid_text where r % 5 <> 2)")
_CLEAN = r"case when regexp_matches(coalesce(v.text, ''), '[\p{L}\p{N}]') then regexp_replace(v.text, '[\s,，]', '', 'g') else '' end"


def tpl_cells(t: Tables) -> DataFrame:
    return codes_grid(t).select("page_id", "r", "c", "text", F.when(F.col("c") == 3, "num").otherwise("struct").alias("kind"))


def read_cells(t: Tables) -> DataFrame:
    r = F.col("r")
    text = F.when(r % 4 == 0, "--").when(r % 4 == 1, F.concat(F.lit("1,"), F.lpad(r.cast("string"), 3, "0"), F.lit(" .5"))).otherwise(F.col("text"))
    return grid_text(t).filter(r % 5 != 2).withColumn("text", text)


@query("fill_position", f"select t.page_id, t.r, t.c, case when kind = 'num' then {_CLEAN} else t.text end as text from tpl_cells t left join read_cells v using (page_id, r, c)", ("tpl_cells", "read_cells"))
def fill_position(t: Tables) -> DataFrame:
    return align.fill_position(tpl_cells(t), read_cells(t))


@query(
    "fill_vlookup",
    f"""select t.page_id, t.r, t.c, case when kind = 'num' then {_CLEAN} else t.text end as text from tpl_cells t left join read_cells v on v.page_id = t.page_id and v.c = t.c and v.r = (t.r * 5 + t.page_id) % 14 and t.r <> 7""",
    ("tpl_cells", "read_cells"),
)
def fill_vlookup(t: Tables) -> DataFrame:
    r = F.col("r")
    aligned = tpl_cells(t).filter(r != 7).select("page_id", "r", ((r * 5 + F.col("page_id")) % 14).cast("int").alias("line_no")).distinct()
    return align.fill_vlookup(tpl_cells(t), aligned, read_cells(t).withColumnRenamed("r", "line_no"))


@query(
    "code_validate",
    """select page_id, r, '第' || (r + 1) || '行代码：模板[' || code || '] 疑似[' || got || ']' as warning from (select page_id, r, cast(11000 + r as varchar) as code, text as got from grid_text where c = 0)
 where got <> '' and not (got = code or (abs(length(got) - length(code)) <= 1 and list_sum(list_transform(range(1, least(length(got), length(code)) + 1), lambda k: case when got[k] = code[k] then 1 else 0 end)) / greatest(length(got), length(code)) >= 0.7))""",
    ("grid_text",),
)
def code_validate(t: Tables) -> DataFrame:
    got = grid_text(t).filter("c = 0").select("page_id", "r", F.col("text").alias("code"))
    want = got.select("page_id", "r", (11000 + F.col("r")).cast("string").alias("code"))
    return align.code_warnings(want, got)


@query(
    "heal_keys",
    """with stored as (select o_custkey as book, 'K' || o_orderkey as key, o_orderkey as seq from orders where o_orderstatus = 'F'),
 pages as (select o_custkey as book, case when o_orderkey % 3 = 0 then 'K' else 'Q' end || o_orderkey as page, o_orderkey as seq from orders where o_orderstatus <> 'O'),
 o as (select *, row_number() over (partition by book order by seq) as k, count(*) over (partition by book) as n from stored s where not exists (select 1 from pages p where p.book = s.book and p.page = s.key)),
 m as (select *, row_number() over (partition by book order by seq) as k, count(*) over (partition by book) as n from pages p where not exists (select 1 from stored s where p.book = s.book and p.page = s.key))
 select s.book, s.key, s.key as page from stored s where exists (select 1 from pages p where p.book = s.book and p.page = s.key) union all select o.book, o.key, m.page from o join m using (book, n, k)""",
)
def heal_keys(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    stored = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("book"), F.concat(F.lit("K"), k).alias("key"), k.alias("seq"))
    pages = t.orders.filter("o_orderstatus <> 'O'").select(
        F.col("o_custkey").alias("book"), F.concat(F.when(k % 3 == 0, "K").otherwise("Q"), k).alias("page"), k.alias("seq")
    )
    return align.heal_keys(stored, pages)


define("fixes", ("cell_boxes",), "fixes as (select page_id, r + page_id % 3 as r, c, 'fix' || r as text from cell_boxes where (r + c) % 4 = 0)")


@query(
    "apply_corrections",
    """select g.page_id, g.r, g.c, coalesce(f.text, g.text) as text, f.text is not null as corrected, false as rejected from grid_text g left join fixes f using (page_id, r, c)
 union all select f.page_id, cast(f.r as int), f.c, f.text, false, true from fixes f where f.r > 13""",
    ("grid_text", "fixes"),
)
def apply_corrections(t: Tables) -> DataFrame:
    r = F.col("r")
    fixes = t.cell_boxes.filter("(r + c) % 4 = 0").select("page_id", (r + F.col("page_id") % 3).cast("int").alias("r"), "c", F.concat(F.lit("fix"), r).alias("text"))
    grid = grid_text(t).select("page_id", "r", "c", "text")
    fixed = align.apply_corrections(grid, fixes).withColumn("rejected", F.lit(False))
    out = align.rejected_corrections(grid, fixes).withColumns({"corrected": F.lit(False), "rejected": F.lit(True)})
    return fixed.unionByName(out)


@query(
    "tpl_data_rows",
    """select t.doc, t.page, t.r, t.code from tpl t where t.r >= case t.page when 'P0' then 2 when 'P1' then 5 else 0 end and t.r % 3 <> 1""",
    ("tpl",),
)
def tpl_data_rows(t: Tables) -> DataFrame:
    rows = tpl(t).select("doc", "page", "r", "code")
    numeric = rows.filter("r % 3 <> 1").select("doc", "page", "r")
    heads = rows.select("doc", "page").distinct().withColumn("header_rows", F.when(F.col("page") == "P0", 2).when(F.col("page") == "P1", 5).otherwise(0))
    return align.data_rows(rows, numeric, heads, ["doc", "page"])
