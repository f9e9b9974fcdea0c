"""Consolidation queries: merge, upsert, totals, read-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import MONEY, REGIONS, WHITELIST, Tables
from ledgerloom.functions.number import code_text, num_lenient
from ledgerloom.operators import checks, series

MEMBERS = [name for name, _kw, role, _none in REGIONS if role == "member"]
NO_DATA = [name for name, _kw, _role, none in REGIONS if none]

_TOTALS = """select p.period, '总分校验' as source, p.code, case when w.code is not null then '总分不平 (白名单指标)' else '总分校验不平' end as detail,
 p.value as v1, cast(coalesce(m.total, 0) as decimal(18,2)) as v3, cast(p.value - coalesce(m.total, 0) as decimal(18,2)) as d13
 from obs_city p left join (select code, period, sum(value) as total from obs where region in (select name from regions where role = 'member')
 group by 1, 2) m using (code, period) left join whitelist w on w.code = p.code where abs(p.value - coalesce(m.total, 0)) > 0.01"""
define("totals_issues", ("obs_city", "regions", "whitelist"), f"totals_issues as ({_TOTALS})")


def totals(t: Tables) -> DataFrame:
    found = checks.totals_check(t.saved, "CITY", MEMBERS, 0.01, WHITELIST)
    return found.select("period", "source", "code", "detail", "v1", "v3", "d13")


@query("totals_check", "select * from totals_issues", ("totals_issues",))
def totals_check(t: Tables) -> DataFrame:
    return totals(t)


@query(
    "totals_check_adjusted",
    """select i.period, i.code, i.detail || case when abs(i.v1 - (case when cast(i.code as int) % 2 = 0 then i.v1 - 5 else i.v1 end)) > 0.01 then ' - 费用调整' else '' end as detail,
 cast(case when cast(i.code as int) % 2 = 0 then i.v1 - 5 else i.v1 end as decimal(18,2)) as v2,
 cast(case when cast(i.code as int) % 2 = 0 then 5 else 0 end as decimal(18,2)) as d12 from totals_issues i""",
    ("totals_issues",),
)
def totals_check_adjusted(t: Tables) -> DataFrame:
    pre = t.obs_city.filter(F.col("code").cast("int") % 2 == 0).select(
        "period", "code", (F.col("value") - 5).cast(MONEY).alias("pre")
    )
    found = checks.totals_check(t.saved, "CITY", MEMBERS, 0.01, WHITELIST, pre_adjust=pre)
    return found.select("period", "code", "detail", "v2", "d12")


@query(
    "member_totals",
    "select code, period, cast(sum(value) as decimal(18,2)) as total from saved where region in (select name from regions where role = 'member') group by 1, 2",
    ("saved", "regions"),
)
def member_totals(t: Tables) -> DataFrame:
    return series.member_totals(t.saved, MEMBERS).select("code", "period", F.col("total").cast(MONEY).alias("total"))


@query(
    "no_data_check",
    """select period, region as source, code, value as v1, value as d13 from obs where region in (select name from regions where no_data)
 and region in (select distinct upper(r_name) from region where r_regionkey >= 3) and abs(value) > 0.01""",
    ("obs", "regions"),
)
def no_data_check(t: Tables) -> DataFrame:
    touched = t.region.filter("r_regionkey >= 3").select(F.upper("r_name").alias("region"))
    return checks.no_data_check(t.saved, NO_DATA, touched).select("period", "source", "code", "v1", "d13")


_CODE = "cast(code as int)"
define(
    "readback_saved",
    ("obs",),
    f"""readback_saved as (select region, code, period, case when {_CODE} % 13 = 0 then null when {_CODE} % 17 = 0 then value + 0.02
 when {_CODE} % 19 = 0 then value + 0.01 else value end as value from obs where region <> 'EUROPE' and {_CODE} % 11 <> 0
 and not (region = 'ASIA' and period like '1996%'))""",
)


def _saved_with_faults(t: Tables) -> DataFrame:
    n = F.col("code").cast("int")
    value = (
        F.when(n % 13 == 0, F.lit(None))
        .when(n % 17 == 0, F.col("value") + F.lit("0.02").cast(MONEY))
        .when(n % 19 == 0, F.col("value") + F.lit("0.01").cast(MONEY))
        .otherwise(F.col("value"))
    )
    lost = (F.col("region") == "EUROPE") | (n % 11 == 0) | ((F.col("region") == "ASIA") & F.startswith("period", F.lit("1996")))
    return t.obs.filter(~lost).select("region", "code", "period", value.alias("value"))


_READBACK = """select o.period, o.region as source, o.code, '写入核对不符' || case when sr.region is null then '：缺少地区工作表' when sp.period is null then '：缺少月份列'
 when sc.code is null then '：缺少指标行' when s.value is null then '：时序值为空' else '：金额不一致' end as detail, cast(o.value as double) as v1,
 cast(s.value as double) as v3, cast(o.value as double) - cast(s.value as double) as d13
 from obs o left join readback_saved s using (region, code, period) left join (select distinct region from readback_saved) sr on sr.region = o.region
 left join (select distinct region, period from readback_saved) sp on sp.region = o.region and sp.period = o.period left join (select distinct region, code from readback_saved) sc on sc.region = o.region and sc.code = o.code
 where sr.region is null or sp.period is null or sc.code is null or s.value is null and abs(o.value) > 0.01 or abs(cast(o.value as double) - cast(s.value as double)) > 0.010000001"""


def readback(t: Tables) -> DataFrame:
    expected = t.obs.withColumns({"name": F.lit(""), "source_file": F.lit("")})
    return checks.verify_readback(expected, _saved_with_faults(t), 0.01)


@query("verify_readback", _READBACK, ("readback_saved",))
def verify_readback(t: Tables) -> DataFrame:
    return readback(t).select("period", "source", "code", "detail", "v1", "v3", "d13")


_MERGE_IN = """rows as (select 'S' || l_suppkey % 12 as region, cast(l_partkey as varchar) as code, strftime(l_shipdate, '%Y.%m') as period,
 case when l_linenumber <> 5 then cast(l_extendedprice as decimal(18,2)) end as value, case when l_linenumber % 3 = 0 then '' else l_returnflag || l_linenumber end as name,
 case when l_linenumber % 2 = 0 then cast(l_linenumber as varchar) end as row_no,
 (l_orderkey * 8 + l_linenumber) * 100000000 + cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) as o from lineitem)"""


@query(
    "merge_dups",
    f"""with {_MERGE_IN}, codes as (select region, code, min(o) as top, arg_min(name, o) filter (name <> '') as name,
 arg_min(row_no, o) filter (row_no <> '') as row_no from rows group by 1, 2),
 months as (select region, code, period, arg_max(value, o) filter (value is not null) as value, min(o) as first_o from rows group by 1, 2, 3)
 select m.region, m.code, m.period, c.name, c.row_no, m.value,
 case when m.first_o = c.top then (select any_value(r.value) from rows r where r.region = m.region and r.code = m.code and r.o = c.top) end as own
 from months m join codes c using (region, code)""",
)
def merge_dups(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    rows = t.lineitem.select(
        F.concat(F.lit("S"), F.col("l_suppkey") % 12).alias("region"), F.col("l_partkey").cast("string").alias("code"),
        F.date_format("l_shipdate", "yyyy.MM").alias("period"),
        F.when(line != 5, F.col("l_extendedprice").cast(MONEY)).alias("value"),
        F.when(line % 3 == 0, "").otherwise(F.concat("l_returnflag", line)).alias("name"),
        F.when(line % 2 == 0, line.cast("string")).alias("row_no"),
        "l_orderkey", line, "l_extendedprice",
    )
    return series.merge_duplicates(rows, F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))


@query(
    "last_wins",
    """select region, code, arg_max(value, o) as value, arg_max(flag, o) as flag from (select 'S' || l_suppkey % 12 as region, cast(l_partkey as varchar) as code,
 cast(l_extendedprice as decimal(18,2)) as value, l_linenumber as flag,
 (l_orderkey * 8 + l_linenumber) * 100000000 + cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) as o from lineitem) group by 1, 2""",
)
def last_wins(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.concat(F.lit("S"), F.col("l_suppkey") % 12).alias("region"), F.col("l_partkey").cast("string").alias("code"),
        F.col("l_extendedprice").cast(MONEY).alias("value"), F.col("l_linenumber").alias("flag"), "l_orderkey",
    )
    return series.last_wins(rows, ["region", "code"], ["value", "flag"], F.struct("l_orderkey", "flag", "value"))


_UPSERT = f"""select region, code, period, coalesce(n.value, o.value) as value, o.value as old_value,
 n.value is not null and n.value is distinct from o.value as changed, n.value is not null as written, o.value is null as is_new
 from (select * from obs where {_CODE} % 3 <> 0) o full join (select region, code, period, cast(value + {_CODE} % 2 as decimal(18,2)) as value from obs where period >= '1995.06') n
 using (region, code, period)"""
define("upserted", ("obs",), f"upserted as ({_UPSERT})")


def upserted(t: Tables) -> DataFrame:
    n = F.col("code").cast("int")
    old = t.obs.filter(n % 3 != 0)
    new = t.obs.filter(F.col("period") >= "1995.06").withColumn("value", (F.col("value") + n % 2).cast(MONEY))
    return series.upsert(old, new)


@query("upsert_series", "select * from upserted", ("upserted",))
def upsert_series(t: Tables) -> DataFrame:
    return upserted(t)


@query(
    "ingest_log",
    """select region || ' ' || period as source_file, region, period, case when bool_or(changed) then '[数据更新]' else '[数据导入]' end as message
 from upserted where written group by 1, 2, 3""",
    ("upserted",),
)
def ingest_log(t: Tables) -> DataFrame:
    cells = upserted(t).filter("written").withColumn("source_file", F.concat_ws(" ", "region", "period"))
    return checks.ingest_log(cells)


_MONTHS = [f"{m:02d}" for m in range(1, 13)]


@query(
    "series_wide",
    "select region, code, period[:4] as year, "
    + ", ".join(f"max(value) filter (period[6:] = '{m}') as m{m}" for m in _MONTHS)
    + " from saved group by 1, 2, 3",
    ("saved",),
)
def series_wide(t: Tables) -> DataFrame:
    split = t.saved.select(
        "region", "code", F.left("period", F.lit(4)).alias("year"), F.right("period", F.lit(2)).alias("period"), "value"
    )
    return series.pivot(split, _MONTHS, ["region", "code", "year"], prefix="m")


@query(
    "series_unpivot",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, u.period, u.value from lineitem, lateral (values
 ('1996.01', cast(cast(l_quantity as int) as double) + 1000), ('1996.02', case when l_linenumber <> 3 then 0.0 end), ('1996.10', case when l_linenumber <> 4 then cast(l_linenumber as double) end)) u(period, value)
 where u.value is not null""",
)
def series_unpivot(t: Tables) -> DataFrame:
    qty, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    wide = t.lineitem.select(
        *ids, F.concat(F.lit(" 1,"), F.lpad((qty).cast("string"), 3, "0")).alias("1996.01"),
        F.when(line == 3, "").otherwise("--").alias("1996-02"),
        F.when(line != 4, line).alias("199610"),
    )
    return series.unpivot(wide, ids)


@query(
    "col_alloc",
    """with months as (select o_orderpriority as region, strftime(o_orderdate, '%Y.%m') as period, min(o_orderkey) as seq from orders group by 1, 2),
 known as (select region, period, cast(3 + row_number() over (partition by region order by period) as int) as col from months where period < '1996'),
 fresh as (select m.* from months m left join known k using (region, period) where k.col is null)
 select * from known union all select f.region, f.period, cast(coalesce((select max(col) from known k where k.region = f.region), 3)
 + row_number() over (partition by f.region order by f.seq) as int) from fresh f""",
)
def col_alloc(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    incoming = t.orders.select(
        F.col("o_orderpriority").alias("region"), F.date_format("o_orderdate", "yyyy.MM").alias("period"),
        F.col("o_orderkey").alias("seq"),
    )
    w = Window.partitionBy("region").orderBy("period")
    known = incoming.filter("period < '1996'").select("region", "period").distinct().withColumn("col", 3 + F.row_number().over(w))
    return series.allocate_columns(known, incoming)


@query(
    "row_alloc",
    """with codes as (select o_orderpriority as region, cast(o_custkey as varchar) as code, min(o_orderkey) as seq, min(o_custkey) as n, bool_or(o_orderdate < timestamp '1996-01-01') as old from orders group by 1, 2),
 known as (select region, code, n as row_seq from codes where old),
 top as (select region, max(row_seq) as t from known group by 1)
 select region, code, row_seq from known union all select c.region, c.code, coalesce(t.t, 0) + row_number() over (partition by c.region order by c.seq)
 from codes c left join top t using (region) where not c.old""",
)
def row_alloc(t: Tables) -> DataFrame:
    incoming = t.orders.select(
        F.col("o_orderpriority").alias("region"), F.col("o_custkey").cast("string").alias("code"), F.col("o_orderkey").alias("seq"),
        "o_orderdate",
    )
    early = incoming.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    known = early.select("region", "code").distinct().withColumn("row_seq", F.col("code").cast("long"))
    return series.append_codes(known, incoming)


@query(
    "scan_indicator",
    r"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_partkey as varchar) as code, l_returnflag as name,
 coalesce(try_cast(regexp_replace(value_raw, '[\s,]', '', 'g') as double), try_cast(nullif(regexp_extract(regexp_replace(value_raw, '[\s,]', '', 'g'), '^[-+]?\d+', 0), '') as double), 0.0) as value
 from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, case l_linenumber when 1 then '12,5' when 2 then ' ' || cast(l_partkey as varchar) || 'x' when 3 then '--' else null end as value_raw
 from lineitem where l_linenumber <> 4)""",
)
def scan_indicator(t: Tables) -> DataFrame:
    from ledgerloom.sources.tables import scan_indicator as scan

    line = F.col("l_linenumber")
    sheet = t.lineitem.select(
        F.when(line != 4, F.concat(F.lit(" "), "l_partkey", F.lit(".0"))).otherwise("  ").alias("指标代码"),
        F.concat("l_returnflag", F.lit(" ")).alias("指标名称"), line.cast("string").alias("行序号"),
        F.when(line == 1, "12,5").when(line == 2, F.concat(F.lit(" "), "l_partkey", F.lit("x"))).when(line == 3, "--").alias(" 余额 "),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return scan(sheet, "余额", keep).select(*keep, "code", "name", "value")


@query(
    "run_stats",
    """select (select count(distinct source_file) from (select region || ' ' || period as source_file from upserted where written)) as files,
 (select count(distinct region) from upserted where written and region not in (select region from upserted where not is_new)) as regions_new,
 (select count(*) from upserted where written) as cells, (select count(*) from upserted where written) as write_checks,
 (select count(*) from totals_issues) as total_bad, 0 as no_data_bad, (select count(*) from totals_issues where detail like '%白名单%') as wl_hit,
 0 as write_mismatches, (select count(*) from totals_issues) as issues""".replace(" 0 as", " cast(0 as bigint) as"),
    ("upserted", "totals_issues"),
)
def run_stats(t: Tables) -> DataFrame:
    cells = upserted(t)
    old = cells.filter(~F.col("is_new")).select("region").distinct().withColumn("_old", F.lit(True))
    written = (
        cells.filter("written").join(old, "region", "left")
        .withColumns({"source_file": F.concat_ws(" ", "region", "period"), "region_is_new": F.col("_old").isNull()})
    )
    return series.run_stats(written, totals(t).withColumn("name", F.lit("")))


@query(
    "issues_all",
    f"""with rb as ({_READBACK}) select period, source, code, detail, cast(v1 as double) as v1, cast(v3 as double) as v3, cast(d13 as double) as d13 from totals_issues
 union all select period, region, code, '不应有数', cast(value as double), null, cast(value as double) from obs where region in (select name from regions where no_data) and abs(value) > 0.01
 union all select period, source, code, detail, v1, v3, d13 from rb""",
    ("totals_issues", "readback_saved", "regions"),
)
def issues_all(t: Tables) -> DataFrame:
    touched = t.saved.select("region")
    every = checks.union_issues(
        totals(t), checks.no_data_check(t.saved, NO_DATA, touched), readback(t)
    )
    return every.select("period", "source", "code", "detail", "v1", "v3", "d13")


@query(
    "issue_view",
    "select period, source as region, code, detail, detail like '%白名单%' as wl, v1, v3 from totals_issues",
    ("totals_issues",),
)
def issue_view(t: Tables) -> DataFrame:
    issues = checks.totals_check(t.saved, "CITY", MEMBERS, 0.01, WHITELIST)
    return checks.issue_view(issues).select("period", "region", "code", "detail", "wl", "v1", "v3")


@query(
    "load_rules",
    """select s_suppkey, trim(s_name) as name, case when s_suppkey % 3 = 0 then trim(s_name) else 'K' || s_suppkey end as kw,
 case when s_suppkey % 2 = 0 then '成员' else 'base' end as role, s_suppkey % 5 in (0, 1, 2, 3) as no_data,
 case when s_suppkey % 7 = 0 then 0.01 else s_acctbal end as tolerance from supplier""",
)
def load_rules(t: Tables) -> DataFrame:
    from ledgerloom.sources.rules import region_rules, tolerance_of

    k = F.col("s_suppkey")
    tokens = F.array(*[F.lit(x) for x in ("是", "1", "y", " Y ", "否")])
    sheet = t.supplier.select(
        "s_suppkey", F.concat(F.lit(" "), "s_name").alias("name"),
        F.when(k % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("K"), k)).alias("kw"),
        F.when(k % 2 == 0, F.lit(None)).otherwise("base").alias("role"),
        F.get(tokens, (k % 5).cast("int")).alias("no_data"),
        F.when(k % 7 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("tol"),
    )
    return region_rules(sheet, ["s_suppkey", "tol"]).withColumn("tolerance", tolerance_of(F.col("tol"))).drop("tol")


@query(
    "extract_rules",
    """select p_partkey, case when p_partkey % 6 = 0 then '规则' || p_partkey else trim(p_name) end as name, trim(p_brand) as wb_keyword, p_type as sheet_keyword,
 cast(case p_partkey % 4 when 0 then 1 when 1 then p_size when 2 then 28 else 1 end as int) as row_header_col, case when p_size % 3 = 0 then '1' when p_size % 3 = 1 then p_size || '' else '1,' || p_size end as header_rows,
 cast(case when p_size % 2 = 0 then p_size else 0 end as int) as row_start, 0 as row_end, 3 as col_start, cast(case when p_size % 2 = 0 then 0 else 8 end as int) as col_end,
 case when p_partkey % 2 = 0 then '合计' else '' end as skip_keywords, 'T' || p_size as target, '' as dedup, p_partkey % 3 <> 1 as write from part where p_partkey % 5 not in (1, 3)""",
)
def extract_rules(t: Tables) -> DataFrame:
    """The parts as lines of a rule sheet."""
    from ledgerloom.sources.rules import extract_rules as typed

    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pick = lambda values, by: F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), by.cast("int"))
    sheet = t.part.select(
        "p_partkey", pick(["是", "否", "1", "false", "Y"], k % 5).alias("enabled"), F.when(k % 6 == 0, " ").otherwise(F.col("p_name")).alias("name"),
        F.concat(F.lit(" "), "p_brand").alias("wb_keyword"), F.col("p_type").alias("sheet_keyword"),
        pick(["A", size, "ab", "?"], k % 4).alias("row_header_col"),
        pick(["x,", size, F.concat(F.lit("1, "), size, F.lit(",b"))], F.col("p_size") % 3).alias("header_rows"),
        F.when(F.col("p_size") % 2 == 0, size).otherwise("n").alias("row_start"), F.lit("").alias("row_end"), F.lit("C").alias("col_start"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise("H").alias("col_end"), F.when(k % 2 == 0, "合计").otherwise("").alias("skip_keywords"),
        F.concat(F.lit("T"), size).alias("target"), F.lit("").alias("dedup"), pick(["", " No ", "y"], k % 3).alias("write"),
    )
    return typed(sheet, ["p_partkey"], "p_partkey").withColumn("header_rows", F.array_join("header_rows", ","))
