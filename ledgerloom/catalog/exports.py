"""Export queries: grids as text formats, sheet names, redaction and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.layout import grid_text
from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import Tables
from ledgerloom.operators import export

# Text with the characters each format must treat.
define(
    "out_grid",
    ("grid_text",),
    """out_grid as (select page_id, r, c, case c when 1 then text || ',' || r when 2 then '"' || text || '"' when 3 then text || '|' else text end as text, score from grid_text)""",
)
define("out_pages", ("items",), "out_pages as (select distinct page_id, 'page' || page_id || '.jpg' as name, case when page_id % 3 = 0 then '' else '标题\"' || page_id end as title, 'table' as mode from items)")
define("out_rows", ("out_grid",), "out_rows as (select page_id, r, list(text order by c) as texts from out_grid group by 1, 2)")


def out_grid(t: Tables) -> DataFrame:
    c, text = F.col("c"), F.col("text")
    marked = (
        F.when(c == 1, F.concat(text, F.lit(","), "r")).when(c == 2, F.concat(F.lit('"'), text, F.lit('"'))).when(c == 3, F.concat(text, F.lit("|"))).otherwise(text)
    )
    return grid_text(t).withColumn("text", marked)


def out_pages(t: Tables) -> DataFrame:
    p = F.col("page_id")
    return t.items.select("page_id").distinct().select(
        "page_id", F.concat(F.lit("page"), p, F.lit(".jpg")).alias("name"), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit('标题"'), p)).alias("title"), F.lit("table").alias("mode"),
    )


@query(
    "export_csv_rows",
    """select page_id, r, array_to_string(list_transform(texts, lambda x: case when regexp_matches(x, '[",\r\n]') then '"' || replace(x, '"', '""') || '"' else x end), ',') as line from out_rows""",
    ("out_rows",),
)
def export_csv_rows(t: Tables) -> DataFrame:
    return export.csv_lines(out_grid(t))


_TITLE = "coalesce(nullif(title, ''), name)"


@query(
    "export_txt",
    f"""select page_id, cast(-1 as bigint) as pos, '===== ' || {_TITLE} || ' =====' as line from out_pages union all select page_id, r, array_to_string(texts, '  ') from out_rows
 union all select page_id, -2, '' from out_pages where page_id > (select min(page_id) from out_pages)""",
    ("out_rows", "out_pages"),
)
def export_txt(t: Tables) -> DataFrame:
    return export.text_lines(out_grid(t), out_pages(t))


@query(
    "export_md",
    f"""select page_id, cast(-2 as bigint) as pos, '## ' || {_TITLE} as line from out_pages union all select page_id, -1, '' from out_pages union all select page_id, -3, '' from out_pages where page_id > (select min(page_id) from out_pages)
 union all select page_id, r * 2, '| ' || replace(array_to_string(list_transform(texts, lambda x: replace(x, '|', '\\|')), ' ~ '), ' ~ ', ' | ') || ' |' from out_rows union all select page_id, 1, '|---|---|---|---|---|' from out_pages""",
    ("out_rows", "out_pages"),
)
def export_md(t: Tables) -> DataFrame:
    return export.markdown_lines(out_grid(t), out_pages(t))


@query(
    "export_json",
    """select page_id, cast(0 as bigint) as section, cast(0 as bigint) as r, cast(0 as bigint) as c, '{"name":' || to_json(name)::varchar || ',"title":' || to_json(title)::varchar || ',"mode":' || to_json(mode)::varchar || ',"rows":[' as part from out_pages
 union all select page_id, 1, r, 0, case when r > 0 then ',' else '' end || to_json(texts)::varchar from out_rows
 union all select page_id, 2, 0, c, case when c > 0 then ',' else '' end || '[0,' || c || ',1,2]' from cell_boxes where r = 0 and c in (0, 2)
 union all select page_id, 3, r, c, case when row_number() over (partition by page_id order by r, c) > 1 then ',' else '' end || '"' || r || ',' || c || '":' || cast(round(score, 3) as varchar) from out_grid where score is not null
 union all select page_id, s.s, -1, 0, s.p from out_pages, (values (2, '],"merges":['), (3, '],"scores":{'), (4, '}}')) s(s, p)""",
    ("out_rows", "out_pages", "cell_boxes"),
)
def export_json(t: Tables) -> DataFrame:
    merges = t.cell_boxes.filter("r = 0 and c in (0, 2)").select("page_id", "r", "c", F.lit(1).alias("rspan"), F.lit(2).alias("cspan"))
    return export.json_parts(out_grid(t), out_pages(t), merges)


@query(
    "unique_names",
    r"""select p_partkey as seq, case when k = 1 then n else left(n, cast(31 - length('(' || k || ')') as int)) || '(' || k || ')' end as sheet_name from
 (select p_partkey, n, row_number() over (partition by n order by p_partkey) as k from (select p_partkey, left(coalesce(nullif(trim(regexp_replace(p_name || case when p_size % 2 = 0 then ' / a very long sheet title' else '' end, '[\\/*?:\[\]]', '_', 'g')), ''), 'Sheet'), 31) as n from part))""",
)
def unique_names(t: Tables) -> DataFrame:
    long_title = F.when(F.col("p_size") % 2 == 0, " / a very long sheet title").otherwise("")
    pages = t.part.select(F.col("p_partkey").alias("seq"), F.concat("p_name", long_title).alias("name"))
    return export.unique_names(pages).select("seq", "sheet_name")


@query(
    "seq_names",
    """with p as (select p_partkey as seq, case when p_size % 5 = 0 then '' else '月计表（国库）' || p_name end as title, case p_size % 3 when 0 then '' when 1 then '月计表第一页' else p_type || '/页' end as tp, 'pic' || p_partkey as name from part),
 q as (select *, trim(coalesce(nullif(title, ''), nullif(tp, ''), name)) as pick from p),
 k as (select *, row_number() over (partition by pick, tp order by seq) as k, count(*) over (partition by pick, tp) as n, regexp_replace(pick, '[/*?:\\[\\]]', '_', 'g') as base from q),
 c as (select *, (select max(i) from range(0, cast(length(tp) as bigint) + 1) r(i) where contains(base, left(tp, i))) as cut from k),
 t as (select *, case when substr(tp, cut + 1) <> '' then '#' || regexp_replace(substr(tp, cut + 1), '[/*?:\\[\\]]', '_', 'g') else '' end || case when n > 1 then '#' || k else '' end as tail from c)
 select seq, case when length(base) + length(tail) <= 31 then base when length(replace(base, '（国库）', '')) + length(tail) <= 31 then replace(base, '（国库）', '') else left(base, 31 - length(tail)) end || tail as sheet_name from t""",
)
def seq_names(t: Tables) -> DataFrame:
    size = F.col("p_size")
    pages = t.part.select(
        F.col("p_partkey").alias("seq"), F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("月计表（国库）"), "p_name")).alias("title"),
        F.when(size % 3 == 0, "").when(size % 3 == 1, "月计表第一页").otherwise(F.concat("p_type", F.lit("/页"))).alias("tpl_page"),
        F.concat(F.lit("pic"), "p_partkey").alias("name"),
    )
    return export.sequence_names(pages).select("seq", "sheet_name")


@query(
    "redact_numeric",
    "select workbook, sheet, r, cast(c as int) as c, case when not (c = 3 and r >= 3 and r % 2 = 1) then v end as v from sheet_cells",
    ("sheet_cells",),
)
def redact_numeric(t: Tables) -> DataFrame:
    keys = ["workbook", "sheet", "r", "c"]
    numeric = t.sheet_cells.filter("c = 3 and r >= 3 and r % 2 = 1")
    return export.redact(t.sheet_cells, numeric, keys)


@query("local_paths", r"select page_id, v from (select page_id, case page_id % 3 when 0 then 'C:\out\' || page_id when 1 then 'D:/keep/a.xlsx' else url end as v from pages) where v like 'C:%'")
def local_paths(t: Tables) -> DataFrame:
    p = F.col("page_id")
    v = F.when(p % 3 == 0, F.concat(F.lit("C:\\out\\"), p)).when(p % 3 == 1, "D:/keep/a.xlsx").otherwise(F.regexp_replace("url", "^[a-z]+:", ""))
    return export.local_paths(t.pages.select("page_id", v.alias("v")), "/keep/a.xlsx")


@query(
    "sha_manifest",
    "select o_orderkey, sha256(concat_ws(chr(31), cast(o_custkey as varchar), o_orderstatus, o_orderpriority)) as sha256 from orders",
)
def sha_manifest(t: Tables) -> DataFrame:
    return export.row_digests(t.orders, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])
