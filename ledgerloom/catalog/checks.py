"""Row, subtotal and rule checks, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import MONEY, Tables
from ledgerloom.operators import checks, ranges
from ledgerloom.scale import number_within

_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "row_balance",
    f"""select {_ID}, l_extendedprice * 1.0::double - l_quantity + l_discount - l_tax
 - (l_extendedprice - (l_quantity + case when l_linenumber % 4 = 0 then 0.02::double else 0.0::double end)) as gap from lineitem
 where abs(l_extendedprice * 1.0::double - l_quantity + l_discount - l_tax - (l_extendedprice - (l_quantity + case when l_linenumber % 4 = 0 then 0.02::double else 0.0::double end))) > 0.005""",
)
def row_balance(t: Tables) -> DataFrame:
    off = F.when(F.col("l_linenumber") % 4 == 0, 0.02).otherwise(0.0)
    rows = t.lineitem.select(
        *_IDS, F.col("l_extendedprice").alias("prev_dr"), F.col("l_quantity").alias("prev_cr"), F.col("l_discount").alias("cur_dr"),
        F.col("l_tax").alias("cur_cr"), F.col("l_extendedprice").alias("end_dr"), (F.col("l_quantity") + off).alias("end_cr"),
    )
    found = checks.row_balance(rows, ["prev_dr", "prev_cr", "cur_dr", "cur_cr", "end_dr", "end_cr"])
    return found.select(*_IDS, "gap")


@query(
    "subtotal_check",
    """select o_orderkey, cast(stated as decimal(18,2)) as stated, cast(summed as decimal(18,2)) as summed, cast(stated - summed as decimal(18,2)) as gap
 from (select o.o_orderkey, any_value(cast(o.o_totalprice as decimal(18,2))) as stated, coalesce(sum(cast(l.l_extendedprice as decimal(18,2))), 0) as summed
 from orders o left join lineitem l on l.l_orderkey = o.o_orderkey group by 1) where abs(stated - summed) > 0.005""",
)
def subtotal_check(t: Tables) -> DataFrame:
    detail = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(False).alias("is_total"), F.col("l_extendedprice").cast(MONEY).alias("value"))
    total = t.orders.select("o_orderkey", F.lit(True).alias("is_total"), F.col("o_totalprice").cast(MONEY).alias("value"))
    found = checks.subtotal_check(detail.unionByName(total), ["o_orderkey"], F.col("is_total"), "value")
    return found.select("o_orderkey", *[F.col(c).cast(MONEY).alias(c) for c in ("stated", "summed", "gap")])


RULES = [
    ("qty_price", "l_returnflag = 'A'", "l_extendedprice < l_quantity * 1000"),
    ("late_tax", "l_tax > 0.05", "abs(l_discount - l_tax) > 0.005"),
    ("max_side", "true", "greatest(l_discount, l_tax) > 0.09"),
    ("div", "l_discount = 0", "try_divide(l_tax, l_discount) > 1"),
    ("div_zero", "true", "l_tax / l_discount > 1"),
    ("bad_cast", "l_linenumber = 1", "cast(l_returnflag as int) > 0"),
    ("half", "true", "2 * l_quantity > order_qty"),
    ("broken", "true", "no_such_column > 1"),
]


@query(
    "rule_checks",
    f"""select 'qty_price' as rule_id, {_ID} from lineitem where l_returnflag = 'A' and l_extendedprice < l_quantity * 1000
 union all select 'late_tax', {_ID} from lineitem where l_tax > 0.05::double and abs(l_discount - l_tax) > 0.005::double
 union all select 'max_side', {_ID} from lineitem where greatest(l_discount, l_tax) > 0.09::double
 union all select 'div', {_ID} from lineitem where false
 union all select 'div_zero', {_ID} from lineitem where l_discount <> 0 and l_tax / l_discount > 1
 union all select 'half', {_ID} from (select *, sum(l_quantity) over (partition by l_orderkey) as q from lineitem) where 2 * l_quantity > q""",
)
def rule_checks(t: Tables) -> DataFrame:
    rows = checks.with_totals(t.lineitem, [("order_qty", "true", "sum(l_quantity)")], ["l_orderkey"])
    return checks.rule_checks(rows, RULES).select("rule_id", *_IDS)


# Sheets of the book `orders`: one line per order and column (A key, B total), one per lineitem in `Lines`.
define(
    "rule_cells",
    (),
    """rule_orders as (select *, 'B' || o_custkey % 7 as workbook, row_number() over (partition by o_custkey % 7 order by o_orderkey) as r from orders),
rule_cells as (select workbook, 'Orders' as sheet, r, 2 as c, cast(o_totalprice as double) as v from rule_orders
 union all select workbook, 'Orders', r, 3, cast(o_orderkey % 10 as double) from rule_orders
 union all select workbook, 'Lines', r, l_linenumber, cast(l_extendedprice as double) from lineitem join rule_orders on l_orderkey = o_orderkey)""",
)


def rule_cells(t: Tables) -> DataFrame:
    """Two sheets for each of seven books: orders with their total and a mark, and the lines of the same orders side by side."""
    o = t.orders.select("o_orderkey", F.concat(F.lit("B"), F.col("o_custkey") % 7).alias("workbook"), F.col("o_totalprice").cast("double").alias("total"))
    numbered = number_within(o, ["workbook"], "o_orderkey", "r", 4096)
    own = numbered.select("workbook", F.lit("Orders").alias("sheet"), "r", F.inline(F.array(
        F.struct(F.lit(2).alias("c"), F.col("total").alias("v_num")), F.struct(F.lit(3).alias("c"), (F.col("o_orderkey") % 10).cast("double").alias("v_num"))
    )))
    lines = t.lineitem.join(numbered, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "workbook", F.lit("Lines").alias("sheet"), "r", F.col("l_linenumber").cast("int").alias("c"), F.col("l_extendedprice").cast("double").alias("v_num")
    )
    return own.unionByName(lines).withColumn("v", F.col("v_num").cast("string"))


# The books grow with the orders, beyond the rows of a spreadsheet; the first two rules are for all of them.
RANGE_RULES = [
    ranges.RangeRule("sum", "Orders!B1:B2147483647", "abs(value - lines) > 0.5 * lines", {"lines": ("sum", "Lines!A1:G1")}),
    ranges.RangeRule("most", "Orders!B1:B2147483647", "most > 0.9 * value", {"most": ("max", "Lines!$A1:$G1")}),
    ranges.RangeRule("mark", "Orders!C1:C400", "value = top and n > 5 * value", {"top": ("max", "$C$1:$C$400"), "n": ("count", "Lines!$A$1:$G$100")}),
    ranges.RangeRule("window", "Orders!C3:C50,Orders!C100:C120", "low > 2", {"low": ("min", "C3:C5")}),
    ranges.RangeRule("broken", "Orders!B1:B9", "no_such_name > 1"),
]


@query(
    "range_rules",
    """with s as (select workbook, r, sum(cast(v as decimal(28,6))) as t, max(v) as m from rule_cells where sheet = 'Lines' and c <= 7 group by all),
n as (select workbook, count(*) as n from rule_cells where sheet = 'Lines' and c <= 7 and r <= 100 group by all),
h as (select workbook, max(v) as top from rule_cells where sheet = 'Orders' and c = 3 and r <= 400 group by all),
w as (select a.workbook, a.r, min(b.v) as low from rule_cells a join rule_cells b on a.workbook = b.workbook and b.sheet = 'Orders' and b.c = 3 and b.r between a.r and a.r + 2 where a.sheet = 'Orders' and a.c = 3 group by all),
o as (select * from rule_cells where sheet = 'Orders')
select o.workbook, o.sheet, o.r, o.c, 'sum' as rule_id, o.v as value from o left join s using (workbook, r) where c = 2 and abs(o.v - coalesce(t, 0)) > 0.5 * coalesce(t, 0)
union all select o.workbook, o.sheet, o.r, o.c, 'most', o.v from o join s using (workbook, r) where c = 2 and m > 0.9 * o.v
union all select o.workbook, o.sheet, o.r, o.c, 'mark', o.v from o join h using (workbook) join n using (workbook) where c = 3 and r <= 400 and o.v = top and n > 5 * o.v
union all select o.workbook, o.sheet, o.r, o.c, 'window', o.v from o join w using (workbook, r) where c = 3 and (r between 3 and 50 or r between 100 and 120) and low > 2""",
    ("rule_cells",),
)
def range_rules(t: Tables) -> DataFrame:
    """Rules over ranges of the same and of another sheet; the rule that does not resolve is left out."""
    return ranges.range_checks(rule_cells(t), RANGE_RULES)


define(
    "bad_rows",
    (),
    "bad_rows as (select o_custkey as page_id, o_orderkey as r, o_orderstatus as code, o_orderpriority as name from orders where o_totalprice > 150000 and o_orderstatus <> 'P')",
)


def bad_rows(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > 150000 and o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("r"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("name")
    )


@query(
    "page_summary",
    """with ranked as (select *, row_number() over (partition by page_id order by r) as k, count(*) over (partition by page_id) as n from bad_rows),
 d as (select page_id, max(n) as n, string_agg('第' || (r + 1) || '行[' || code || ' ' || name || ']', '；' order by k) filter (k <= 8) as t from ranked group by 1)
 select c_custkey as page_id, case when c_nationkey % 3 = 0 then '' else 'T' || c_nationkey end as template,
 case when c_nationkey % 3 = 0 then '未套模板' when d.n > 0 then '✗ ' || d.n || ' 行不平' else '✓ 平衡' end as verdict,
 coalesce(d.t, '') || case when d.n > 8 then '…（共 ' || d.n || ' 行）' else '' end as detail,
 c_nationkey || ' 行匹配' || case when c_nationkey % 4 > 0 then '，' || c_nationkey % 4 || ' 未找到' else '' end || case when c_nationkey % 2 > 0 then '，' || c_nationkey % 2 || ' 多余' else '' end as alignment
 from customer left join d on d.page_id = c_custkey""",
    ("bad_rows",),
)
def page_summary(t: Tables) -> DataFrame:
    n = F.col("c_nationkey")
    pages = t.customer.select(F.col("c_custkey").alias("page_id"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("T"), n)).alias("template"))
    aligned = t.customer.select(F.col("c_custkey").alias("page_id"), n.alias("matched"), (n % 4).alias("unmatched"), (n % 2).alias("extra"))
    return checks.page_summary(pages, bad_rows(t), aligned)


@query(
    "overall_summary",
    """select count(*) as total, count(*) filter (tpl) as templated, count(*) filter (n > 0) as bad, count(*) filter (done and tpl and n = 0) as ok from
 (select c_nationkey % 3 <> 0 as tpl, c_nationkey % 5 <> 0 as done, (select count(*) from bad_rows b where b.page_id = c_custkey) as n from customer)""",
    ("bad_rows",),
)
def overall_summary(t: Tables) -> DataFrame:
    counts = bad_rows(t).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("c_nationkey")
    pages = t.customer.select(
        F.col("c_custkey").alias("page_id"), F.when(n % 3 != 0, "T").otherwise("").alias("template"),
        F.when(n % 5 != 0, "完成").otherwise("等待").alias("status"),
    ).join(counts, "page_id", "left").withColumn("n_bad", F.coalesce("n", F.lit(0)))
    return checks.overall_summary(pages)


@query(
    "topk_details",
    """select page_id, r, code, name, cast(k as int) as rank, n as n_all from (select *, row_number() over (partition by page_id order by r) as k,
 count(*) over (partition by page_id) as n from bad_rows) where k <= 6""",
    ("bad_rows",),
)
def topk_details(t: Tables) -> DataFrame:
    return checks.top_details(bad_rows(t), ["page_id"], ["r"], 6)
