"""Backfill queries: ledger lookup, triggers, roll-up and preview."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import BACKFILL_MAP, MONEY, PARENTS, REGIONS, Tables
from ledgerloom.functions.number import num_lenient
from ledgerloom.functions.period import ledger_period
from ledgerloom.operators import backfill, checks

FEES = ["11067", "11068", "11069", "11070"]
INCREMENT = "11031"
WATCHED = [*FEES, INCREMENT]
PLACES = [r[0] for r in REGIONS if r[2] == "member" and not r[3]]

_IN_WATCHED = "code in ('11067','11068','11069','11070','11031')"
define(
    "src_files",
    ("obs",),
    f"""src_files as (select region || ' ' || period as file, region, period, code, case when code like '%7' then '' else 'N' || code end as name,
 case when {_IN_WATCHED} and cast(period[6:] as int) % 2 = 0 then cast(0 as decimal(18,2)) else value end as value from obs)""",
)
define(
    "ledger",
    (),
    """ledger as (select strftime(o_orderdate, '%Y.%m') as period, o_orderkey + 2 as r, cast(500 + o_custkey % 20 as varchar) as fee_code, o_orderpriority as name,
 cast(o_totalprice as decimal(18,2)) as v7, cast(cast(o_totalprice as decimal(18,2)) * 2 as decimal(18,2)) as v8 from orders where month(o_orderdate) <> 12)""",
)
define(
    "fees",
    ("ledger", "backfill_map"),
    """fees as (select l.period, m.code, cast(arg_min(case when m.fee_col = 7 then v7 else v8 end, r) as double) as value
 from ledger l join backfill_map m on m.fee_code = l.fee_code group by 1, 2)""",
)
define(
    "eligible",
    ("src_files", "ledger"),
    f"""eligible as (select file, region, period from src_files where region in ('AFRICA','AMERICA','ASIA') and period in (select period from ledger)
 group by 1, 2, 3 having coalesce(sum(abs(value)) filter ({_IN_WATCHED}), 0) < 0.01)""",
)
define(
    "fills",
    ("eligible", "fees"),
    """fills as (select s.file, s.region, s.period, s.code, cast(f.value as decimal(18,2)) as v1, s.value as v2, case when s.code = '11031' then 'B' else 'A' end as grp,
 cast(cast(f.value as decimal(18,2)) - s.value as decimal(18,2)) as d12 from src_files s join eligible e using (file) join fees f on f.period = s.period and f.code = s.code)""",
)
define(
    "moves",
    ("fills", "parents"),
    """moves as (select s.file, s.region, s.period, s.code, p.grp, cast(s.value + d.delta as decimal(18,2)) as v1, s.value as v2, cast(d.delta as decimal(18,2)) as d12
 from src_files s join parents p using (code) join (select file, grp, sum(d12) as delta from fills group by 1, 2) d on d.file = s.file and d.grp = p.grp where abs(d.delta) >= 0.01)""",
)
define(
    "corrected",
    ("moves",),
    """corrected as (select s.file, s.region, s.period, s.code, coalesce(x.v1, s.value) as value, s.value as old_value, x.v1 is not null as corrected
 from src_files s left join (select file, code, v1 from fills union all select file, code, v1 from moves) x using (file, code))""",
)


def src_files(t: Tables) -> DataFrame:
    even = F.right("period", F.lit(2)).cast("int") % 2 == 0
    zeroed = F.when(F.col("code").isin(WATCHED) & even, F.lit(0).cast(MONEY)).otherwise(F.col("value"))
    return t.obs.select(
        F.concat_ws(" ", "region", "period").alias("file"), "region", "period", "code",
        F.when(F.endswith("code", F.lit("7")), "").otherwise(F.concat(F.lit("N"), "code")).alias("name"), zeroed.alias("value"),
    )


def ledger(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast(MONEY)
    cells = F.array(*[
        F.struct(F.lit(c).alias("c"), v.alias("v"))
        for c, v in [
            (1, F.concat((500 + F.col("o_custkey") % 20).cast("string"), F.lit(".0"))), (2, F.col("o_orderpriority")),
            (7, price.cast("string")), (8, (price * 2).cast("string")),
        ]
    ])
    return t.orders.filter(F.month("o_orderdate") != 12).select(
        F.date_format("o_orderdate", "yyyy.MM").alias("period"), (F.col("o_orderkey") + 2).alias("r"), F.inline(cells)
    )


def fees(t: Tables) -> DataFrame:
    return backfill.ledger_values(ledger(t), BACKFILL_MAP)


def eligible(t: Tables) -> DataFrame:
    return backfill.eligible_files(src_files(t), WATCHED, PLACES, ledger(t))


def fills(t: Tables) -> DataFrame:
    return backfill.backfill_values(src_files(t), eligible(t), fees(t), INCREMENT)


def moves(t: Tables) -> DataFrame:
    return backfill.parent_rollup(src_files(t), fills(t), PARENTS)


def corrected(t: Tables) -> DataFrame:
    return backfill.apply_overrides(src_files(t), fills(t), moves(t)).drop("name")


@query(
    "fee_period",
    """select o_orderkey, case when o_orderkey % 5 = 0 then 'ERR' else strftime(o_orderdate, '%Y-%m') end as period from orders""",
)
def fee_period(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    title = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-MM")).otherwise(
        F.concat(F.lit("余额表 "), F.year(day), F.lit("年"), F.month(day), F.lit("月末"))
    )
    return t.orders.select("o_orderkey", ledger_period(title).alias("period"))


@query("fee_lookup", "select * from fees", ("fees",))
def fee_lookup(t: Tables) -> DataFrame:
    return fees(t)


@query("fee_names", "select period, fee_code, arg_max(name, r) as name from ledger group by 1, 2", ("ledger",))
def fee_names(t: Tables) -> DataFrame:
    return backfill.ledger_names(ledger(t))


@query(
    "needs_backfill",
    f"select file, region, period, coalesce(sum(abs(value)) filter ({_IN_WATCHED}), 0) < 0.01 as needed from src_files group by 1, 2, 3",
    ("src_files",),
)
def needs_backfill(t: Tables) -> DataFrame:
    return backfill.needs_backfill(src_files(t), WATCHED)


_AUDIT = "file, region, period, code, v1, v2, grp, d12"


@query("backfill_values", f"select {_AUDIT}, '会计补录' as source, '已补录费用数据' as detail from fills", ("fills",))
def backfill_values(t: Tables) -> DataFrame:
    return fills(t)


@query("parent_rollup", f"select {_AUDIT}, '会计父项补录' as source, '父项已同步补录' as detail from moves", ("moves",))
def parent_rollup(t: Tables) -> DataFrame:
    return moves(t)


@query("corrected_copy", "select * from corrected", ("corrected",))
def corrected_copy(t: Tables) -> DataFrame:
    return corrected(t)


@query(
    "identity_check",
    """select file, region, period, cast(coalesce(sum(value) filter (code = '11031'), 0) as decimal(18,2)) as v1,
 cast(coalesce(sum(value) filter (code in ('11067','11068','11069','11070')), 0) as decimal(18,2)) as v2 from corrected join eligible using (file, region, period) group by 1, 2, 3
 having abs(coalesce(sum(value) filter (code = '11031'), 0) - coalesce(sum(value) filter (code in ('11067','11068','11069','11070')), 0)) > 0.01""",
    ("corrected", "eligible"),
)
def identity_check(t: Tables) -> DataFrame:
    found = backfill.identity_check(corrected(t), eligible(t), FEES, INCREMENT)
    return found.select("file", "region", "period", F.col("v1").cast(MONEY).alias("v1"), F.col("v2").cast(MONEY).alias("v2"))


@query(
    "backfill_preview",
    """with names as (select period, fee_code, arg_max(name, r) as name from ledger group by 1, 2),
 lines as (select e.file, m.ord as line_no, m.code, coalesce(nullif(s.name, ''), n.name, m.fee_code) as name, m.fee_code || coalesce(' ' || n.name, '') as from_code,
 coalesce(f.value, 0) as value from eligible e, backfill_map m left join fees f on f.period = e.period and f.code = m.code
 left join src_files s on s.file = e.file and s.code = m.code left join names n on n.period = e.period and n.fee_code = m.fee_code),
 sums as (select file, cast(coalesce(sum(cast(value as decimal(18,2))) filter (code <> '11031'), 0) as double) as s4, coalesce(max(value) filter (code = '11031'), 0) as inc from lines group by 1)
 select file, line_no, code, name, from_code, round(value, 2) as value, cast(null as boolean) as ok from lines
 union all select file, 5, 'Σ11067~11070', '四项费用之和', '', round(s4, 2), null from sums
 union all select file, 6, '11031', '其他收入(增加值)', '', round(inc, 2), abs(s4 - inc) <= 0.01 from sums""",
    ("src_files", "eligible", "fees", "ledger", "backfill_map"),
)
def backfill_preview(t: Tables) -> DataFrame:
    names = backfill.ledger_names(ledger(t))
    return backfill.preview(src_files(t), eligible(t), fees(t), names, BACKFILL_MAP, FEES, INCREMENT)


@query(
    "no_data_src",
    """select period, region as source, code, '不应有数' as detail, 'source' as stage, value as v1, cast(0 as decimal(18,2)) as v2, value as d12, value as d13, name, file
 from src_files where region in ('EUROPE','MIDDLE EAST') and abs(value) > 0.01""",
    ("src_files",),
)
def no_data_src(t: Tables) -> DataFrame:
    return checks.source_no_data_check(src_files(t), ["EUROPE", "MIDDLE EAST"])


@query(
    "zero_watch",
    f"""select s.period, s.region as source, s.code, '未调整或调整后仍为0' as detail, s.value as v1, cast(s.value - coalesce(m.d12, 0) as decimal(18,2)) as v2, s.name, s.file from src_files s
 left join (select period, code, sum(d12) as d12 from fills group by 1, 2) m on m.period = s.period and m.code = s.code
 where s.region = 'ASIA' and s.{_IN_WATCHED} and abs(s.value) < 0.01 and s.code in (select code from obs where region = 'ASIA')""",
    ("src_files", "obs", "fills"),
)
def zero_watch(t: Tables) -> DataFrame:
    changes = fills(t).groupBy("period", "code").agg(F.sum("d12").alias("change"))
    return checks.zero_watch(src_files(t), t.obs, "ASIA", WATCHED, changes)
