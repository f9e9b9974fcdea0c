"""Diff, accuracy, fingerprint and source queries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.layout import grid_text
from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import MONEY, Tables
from ledgerloom.operators import diff
from ledgerloom.sources.html import html_tables as read_html_tables
from ledgerloom.sources.listing import latest_file as latest_of
from ledgerloom.sources.listing import safe_map as map_safely
from ledgerloom.sources.listing import split_listing
from ledgerloom.sources.workbook import cells_of, parse_workbooks

_NUMBER = r"regexp_full_match(v, '[0-9]+(\.[0-9]+)?')"
define(
    "before",
    ("sheet_cells",),
    f"""before as (select workbook || '!' || sheet as sheet, r, c, case when c = 2 and r > 2 then 'formula' else 'value' end as kind, case when {_NUMBER} then 'number' else 'string' end as vtype, v,
 case when {_NUMBER} then cast(v as double) end as v_num from sheet_cells where coalesce(v, '') <> '')""",
)
define(
    "after",
    ("before",),
    """after as (select sheet, r, case when r % 17 = 0 then c + 10 else c end as c, kind, case when r % 13 = 0 and c = 3 then 'string' else vtype end as vtype,
 case when r % 19 = 0 and c = 4 then v || 'x' when kind = 'formula' and r % 5 = 0 then ' ' || v when kind = 'formula' and r % 23 = 0 then '=' || v else v end as v, case when r % 29 = 0 then v_num * (1 + 1e-16::double) when r % 31 = 0 then v_num + 0.5::double else v_num end as v_num from before where r % 11 <> 0)""",
)
_DIFF = """diffs as (select sheet, kind, chr(cast(64 + c as int)) || r as address, r, cast(c as int) as c, case when a.v is null then '缺失' when b.v is null then '多出' else '不一致' end as problem, b.v as before, a.v as after
 from before b full join after a using (sheet, r, c, kind) where a.v is null or b.v is null or case when kind = 'formula' then trim(a.v) <> trim(b.v)
 when a.vtype <> b.vtype then true when a.vtype = 'number' then a.v_num <> b.v_num and abs(a.v_num - b.v_num) > 1e-15::double * greatest(abs(a.v_num), abs(b.v_num)) else a.v <> b.v end)"""
define("diffs", ("before", "after"), _DIFF)


def before(t: Tables) -> DataFrame:
    v = F.col("v")
    number = F.regexp_like(v, F.lit(r"^[0-9]+(\.[0-9]+)?$"))
    return t.sheet_cells.filter(F.coalesce(v, F.lit("")) != "").select(
        F.concat_ws("!", "workbook", "sheet").alias("sheet"), "r", "c",
        F.when((F.col("c") == 2) & (F.col("r") > 2), "formula").otherwise("value").alias("kind"),
        F.when(number, "number").otherwise("string").alias("vtype"), "v", F.when(number, v.try_cast("double")).alias("v_num"),
    )


def after(t: Tables) -> DataFrame:
    r, c, formula = F.col("r"), F.col("c"), F.col("kind") == "formula"
    text = (
        F.when((r % 19 == 0) & (c == 4), F.concat("v", F.lit("x"))).when(formula & (r % 5 == 0), F.concat(F.lit(" "), "v"))
        .when(formula & (r % 23 == 0), F.concat(F.lit("="), "v")).otherwise(F.col("v"))
    )
    return before(t).filter(r % 11 != 0).select(
        "sheet", "r", F.when(r % 17 == 0, c + 10).otherwise(c).alias("c"), "kind",
        F.when((r % 13 == 0) & (c == 3), "string").otherwise(F.col("vtype")).alias("vtype"), text.alias("v"),
        F.when(r % 29 == 0, F.col("v_num") * (1 + F.lit(1e-16))).when(r % 31 == 0, F.col("v_num") + 0.5).otherwise(F.col("v_num")).alias("v_num"),
    )


@query("table_diff", "select * from diffs", ("diffs",))
def table_diff(t: Tables) -> DataFrame:
    return diff.table_diff(before(t), after(t))


@query("diff_top8", "select * from diffs order by sheet, kind <> 'formula', r, c limit 8", ("diffs",))
def diff_top8(t: Tables) -> DataFrame:
    return diff.first_problems(diff.table_diff(before(t), after(t)), 8)


@query(
    "sheet_names_eq",
    """with s as (select o_custkey as k, o_orderkey as no, 'S' || o_orderkey as n from orders), a as (select k, list(n order by no) as l from s group by 1), b as (select k, list(n order by case when k % 7 = 0 then -no else no end) as l from s where k % 5 <> 0 or no % 2 = 0 group by 1)
 select cast(coalesce(a.k, b.k) as varchar) as workbook, a.l is not distinct from b.l as same from a full join b using (k)""",
)
def sheet_names_eq(t: Tables) -> DataFrame:
    k, no = F.col("o_custkey"), F.col("o_orderkey")
    sheets = t.orders.select(k.cast("string").alias("workbook"), F.concat(F.lit("S"), no).alias("sheet"), no.alias("sheet_no"), k)
    moved = sheets.filter((k % 5 != 0) | (F.col("sheet_no") % 2 == 0)).withColumn(
        "sheet_no", F.when(k % 7 == 0, -F.col("sheet_no")).otherwise(F.col("sheet_no"))
    )
    return diff.sheet_names_equal(sheets, moved)


define("want_grid", ("grid_text",), "want_grid as (select page_id, r, c, case when (r + c) % 6 = 0 then '（' || text || '）' else text end as text from grid_text)")
define("got_grid", ("grid_text",), "got_grid as (select page_id, r, c, case when (r + c) % 6 = 0 then '( ' || text || ')' when (r * c) % 5 = 4 then text || 'z' else text end as text from grid_text where r <> 3)")
_HIT = "replace(replace(replace(w.text, '（', '('), '）', ')'), ' ', '') = replace(coalesce(g.text, ''), ' ', '')"


def want_grid(t: Tables) -> DataFrame:
    odd = (F.col("r") + F.col("c")) % 6 == 0
    return grid_text(t).select("page_id", "r", "c", F.when(odd, F.concat(F.lit("（"), "text", F.lit("）"))).otherwise(F.col("text")).alias("text"))


def got_grid(t: Tables) -> DataFrame:
    r, c = F.col("r"), F.col("c")
    text = F.when((r + c) % 6 == 0, F.concat(F.lit("( "), "text", F.lit(")"))).when(r * c % 5 == 4, F.concat("text", F.lit("z"))).otherwise(F.col("text"))
    return grid_text(t).filter(r != 3).select("page_id", "r", "c", text.alias("text"))


@query(
    "grid_accuracy",
    f"""select w.page_id, count(*) filter ({_HIT}) as matched, count(*) as total, count(*) filter ({_HIT}) / count(*) as accuracy from want_grid w left join got_grid g using (page_id, r, c) where w.text <> '' group by 1""",
    ("want_grid", "got_grid"),
)
def grid_accuracy(t: Tables) -> DataFrame:
    return diff.grid_accuracy(want_grid(t), got_grid(t), ["page_id"])


@query(
    "grid_mismatches",
    f"select w.page_id, w.r, w.c, w.text as expected, coalesce(g.text, '') as got from want_grid w left join got_grid g using (page_id, r, c) where w.text <> '' and not ({_HIT})",
    ("want_grid", "got_grid"),
)
def grid_mismatches(t: Tables) -> DataFrame:
    return diff.mismatches(want_grid(t), got_grid(t), ["page_id"])


@query(
    "fingerprint",
    """with f as (select sheet, max(r) as rows, cast(max(c) as int) as cols, arg_max(v, r * 100 + c) as last from before group by 1), g as (select sheet, max(r) as rows, cast(max(c) as int) as cols, arg_max(v, r * 100 + c) as last from after group by 1)
 select sheet, coalesce(f.rows, g.rows) as rows, f.rows is not distinct from g.rows and f.cols is not distinct from g.cols and f.last is not distinct from g.last as agree from f full join g using (sheet)""",
    ("before", "after"),
)
def fingerprint(t: Tables) -> DataFrame:
    return diff.fingerprints_agree(before(t), after(t))


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zipped(shared: str, names: list[str], bodies: list[str]) -> bytes:
    """An XLSX file of finished sheet bodies; style 1 is a date."""
    sheets = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        book.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{shared}</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {_MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, body in enumerate(bodies, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _as_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "content": [_zipped(*x) for x in zip(batch["shared"], batch["names"], batch["bodies"])]})


def order_books(t: Tables) -> DataFrame:
    """(path, content): the orders as XLSX files of 1024 order keys, one sheet per status."""
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.concat(F.lit("/in/B"), F.floor(k / 1024), F.lit(".xlsx")).alias("path"), (k % 1024 + 1).cast("int").alias("r"),
        F.col("o_orderstatus").alias("sheet"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").cast(MONEY).cast("string").alias("price"), F.date_diff("o_orderdate", F.lit("1899-12-30")).alias("day"),
    )

    def cell(x: Column, letter: str, inner: Column, attributes: str = "") -> Column:
        return F.concat(F.lit(f'<c r="{letter}'), x["r"], F.lit(f'"{attributes}>'), inner, F.lit("</c>"))

    def value(c: Column | str) -> Column:
        return F.concat(F.lit("<v>"), c if isinstance(c, Column) else F.lit(c), F.lit("</v>"))

    def row(x: Column, i: Column) -> Column:
        formula = F.concat(F.lit("<f>A"), x["r"], F.lit("*1</f>"), value(x["cust"]))
        text = F.concat(F.lit("<is><t>"), x["sheet"], F.lit(" &amp; </t><t>x</t></is>"))
        return F.concat(
            F.lit("<row>"), cell(x, "A", value(x["cust"])), cell(x, "B", value(i), ' t="s"'), cell(x, "C", value(x["price"])),
            cell(x, "D", value(x["day"]), ' s="1"'), cell(x, "E", value(F.when(x["sheet"] == "O", "1").otherwise("0")), ' t="b"'),
            cell(x, "F", formula), cell(x, "AA", text, ' t="inlineStr"'), F.lit("</row>"),
        )

    books = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("r", "sheet", "priority", "cust", "price", "day"))).alias("rows"))
    lines = F.transform("rows", lambda x, i: F.struct(x["sheet"].alias("sheet"), row(x, i).alias("xml")))
    made = books.withColumn("lines", lines).withColumn("names", F.array_sort(F.array_distinct(F.transform("rows", lambda x: x["sheet"]))))
    of_sheet = lambda n: F.array_join(F.transform(F.filter("lines", lambda x: x["sheet"] == n), lambda x: x["xml"]), "")
    shared = F.array_join(F.transform("rows", lambda x: F.concat(F.lit("<si><t>"), x["priority"], F.lit("</t></si>"))), "")
    parts = made.select("path", shared.alias("shared"), "names", F.transform("names", of_sheet).alias("bodies"))
    return parts.mapInPandas(_as_files, "path string, content binary")


@query(
    "scan_cells",
    """with o as (select *, 'B' || (o_orderkey // 1024) || '.xlsx' as workbook, o_orderstatus as sheet, cast(o_orderkey % 1024 + 1 as int) as r, date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as day from orders),
 n as (select workbook, sheet, cast(row_number() over (partition by workbook order by sheet) - 1 as int) as sheet_no from (select distinct workbook, sheet from o))
 select workbook, sheet, sheet_no, r, u.c, u.vtype, u.v, cast(u.num as double) as v_num, case when u.vtype = 'date' then strftime(o_orderdate, '%Y-%m-%d') end as v_date, u.formula
 from o join n using (workbook, sheet), lateral (values (1, 'number', cast(o_custkey as varchar), cast(o_custkey as double), null), (2, 'string', o_orderpriority, null, null),
  (3, 'number', cast(cast(o_totalprice as decimal(18,2)) as varchar), cast(cast(o_totalprice as decimal(18,2)) as double), null), (4, 'date', cast(day as varchar), cast(day as double), null),
  (5, 'bool', case when sheet = 'O' then 'true' else 'false' end, null, null), (6, 'number', cast(o_custkey as varchar), cast(o_custkey as double), 'A' || r || '*1'),
  (27, 'string', sheet || ' & x', null, null)) u(c, vtype, v, num, formula)""",
)
def scan_cells(t: Tables) -> DataFrame:
    """The orders written as XLSX files and read back by the workbook reader."""
    cells = cells_of(parse_workbooks(order_books(t)))
    return cells.withColumn("v_date", F.date_format("v_ts", "yyyy-MM-dd")).drop("v_ts")


define(
    "conv_html",
    (),
    """conv_rows as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as k, count(*) over (partition by conv_id) as n from conversations)""",
)


@query(
    "html_tables",
    """select conv_id as page_id, 0 as table_no, 0 as r, 0 as c, cast(n as int) as rspan, 1 as cspan, 'conv' as text from conv_rows where k = 0
 union all select conv_id, 0, cast(k as int), 1, 1, case when k % 2 = 0 then 2 else 1 end, role from conv_rows union all select conv_id, 0, cast(k as int), case when k % 2 = 0 then 3 else 2 end, 1, 1, cast(turn as varchar) || ' & ' || length(text) from conv_rows""",
    ("conv_html",),
)
def html_tables(t: Tables) -> DataFrame:
    """Each conversation as a table: a first cell over all rows, then role and turn."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    row = lambda x, i: F.concat(
        F.when(i == 0, F.concat(F.lit("<tr><td rowspan="), F.size("turns"), F.lit(">conv</td>"))).otherwise("<tr>"),
        F.when(i % 2 == 0, "<td colspan='2'>").otherwise("<td>"), x["role"], F.lit("</td><td> "), x["turn"], F.lit(" &amp; "), x["n"], F.lit("</td></tr>"),
    )
    pages = t.conversations.groupBy(F.col("conv_id").alias("page_id")).agg(turns.alias("turns")).select(
        "page_id", F.concat(F.lit("<html><table>"), F.array_join(F.transform("turns", row), "\n"), F.lit("</table></html>")).alias("html")
    )
    return read_html_tables(pages).withColumns({c: F.col(c).cast("int") for c in ("r", "c", "rspan", "cspan")})


@query(
    "file_filter",
    """select distinct path, case when not regexp_matches(lower(path), '\\.(jpg|png)$') then '跳过非图片文件：' || regexp_extract(path, '[^/]*$', 0) end as reason
 from (select regexp_replace(url, '[?#].*$', '') || case page_id % 4 when 0 then '.jpg' when 1 then '.PNG' when 2 then '.txt' else '' end as path from pages union all select regexp_replace(url, '[?#].*$', '') || '.jpg' from pages where page_id % 8 = 0)""",
)
def file_filter(t: Tables) -> DataFrame:
    p, url = F.col("page_id"), F.regexp_replace("url", r"[?#].*$", "")
    ext = F.when(p % 4 == 0, ".jpg").when(p % 4 == 1, ".PNG").when(p % 4 == 2, ".txt").otherwise("")
    files = t.pages.select(F.concat(url, ext).alias("path"))
    again = t.pages.filter(p % 8 == 0).select(F.concat(url, F.lit(".jpg")).alias("path"))
    return split_listing(files.unionByName(again))


@query(
    "latest_file",
    """select o_orderpriority as folder, arg_max(path, strftime(o_orderdate, '%Y%m%d') || path) as path from
 (select o_orderpriority, o_orderdate, '/out/' || case when o_orderkey % 3 = 0 then '识别结果_' else '宽表_' end || o_orderkey || case when o_orderkey % 5 = 0 then '.csv' else '.xlsx' end as path from orders)
 where path like '/out/识别结果_%.xlsx' group by 1""",
)
def latest_file(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("/out/"), F.when(k % 3 == 0, "识别结果_").otherwise("宽表_"), k, F.when(k % 5 == 0, ".csv").otherwise(".xlsx"))
    files = t.orders.select(F.col("o_orderpriority").alias("folder"), name.alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return latest_of(files, ["folder"])


def _checked_length(text: str) -> int:
    if "the" in text.lower():
        raise ValueError("stop word")
    return len(text)


@query(
    "safe_map",
    """select doc_id, case when contains(lower(text), 'the') then 'failed' else 'ok' end as status, case when contains(lower(text), 'the') then 'ValueError: stop word' end as error,
 case when not contains(lower(text), 'the') then cast(length(text) as varchar) end as payload from documents""",
)
def safe_map(t: Tables) -> DataFrame:
    return map_safely(t.documents, "doc_id", "text", _checked_length)
