"""Registered queries with their DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.fixtures import Tables

Build = Callable[[Tables], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

REGIONS_SQL = """regions(ord, name, kw, role, no_data) as (values (0,'CITY','CITY','base',false),
 (1,'AFRICA','AFRICA','member',false),(2,'AMERICA','AMERICA','member',false),(3,'ASIA','ASIA','member',false),
 (4,'EUROPE','EUROPE','member',true),(5,'MIDDLE EAST','MIDDLE EAST','member',true))"""

# name -> (CTEs it needs, CTE text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "regions": ((), REGIONS_SQL),
    "whitelist": ((), "whitelist as (select cast(k as varchar) as code from range(11000, 11097) t(k) where k % 21 = 0)"),
    "backfill_map": ((), """backfill_map(ord, code, fee_code, fee_col) as (values (0,'11067','512',7),(1,'11068','513',7),
 (2,'11069','514',7),(3,'11070','515',7),(4,'11031','502',8))"""),
    "parents": ((), "parents(code, grp) as (values ('11064','A'),('11001','A'),('11028','B'),('11071','B'))"),
    "obs": ((), """obs as (select r.r_name as region, cast(11000 + o.o_custkey % 97 as varchar) as code,
 strftime(o.o_orderdate, '%Y.%m') as period,
 cast(sum(cast(o.o_totalprice as decimal(18,2))) as decimal(18,2)) as value
 from orders o join customer c on o.o_custkey = c.c_custkey
 join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by 1, 2, 3)"""),
    "obs_city": (("obs",), """obs_city as (select 'CITY' as region, code, period, cast(sum(value)
 + case when cast(code as int) % 7 = 0 then 1.00 when cast(code as int) % 5 = 0 then 0.01 else 0.00 end
 as decimal(18,2)) as value from obs group by code, period)"""),
    "saved": (("obs_city",), "saved as (select * from obs union all select * from obs_city)"),
    "src": ((), """src as (select l_orderkey, l_linenumber, l_suppkey % 12 as file_seq,
 case when l_orderkey % 2 = 0 then concat(cast(l_partkey as varchar), '.0') else concat(' ', cast(l_partkey as varchar), ' ') end as code_raw,
 case l_linenumber when 1 then cast(cast(l_extendedprice as decimal(18,2)) as varchar)
  when 2 then concat(cast(cast(l_quantity as int) as varchar), ',000.5') when 3 then concat(cast(cast(l_quantity as int) as varchar), 'abc')
  when 4 then '--' when 5 then '' when 6 then concat('  -', cast(cast(l_quantity as int) as varchar), '  ') else null end as value_raw
 from lineitem)"""),
    "items": ((), """items as (select user_id as page_id, event_id as item_no, (event_id * 37) % 1000 as x0, (event_id * 53) % 1400 as y0,
 (event_id * 37) % 1000 + 20 + event_id % 40 as x1, (event_id * 53) % 1400 + 14 + event_id % 6 as y1,
 case when event_id % 3 = 0 then cast(11000 + event_id % 97 as varchar) else event_type end as text,
 cast(50 + event_id % 50 as double) / 100 as score from events)"""),
    "cell_boxes": ((), """cell_boxes as (select p.page_id, cast(a.k as int) as r, cast(b.k as int) as c, cast(b.k * 200 as int) as x,
 cast(a.k * 100 as int) as y, 200 as w, 100 as h from (select distinct user_id as page_id from events) p, range(14) a(k), range(5) b(k))"""),
    "ignore_rects": ((), """ignore_rects as (select p.page_id, v.x, v.y, v.w, v.h from (select distinct user_id as page_id from events where user_id % 2 = 0) p,
 (values (0.0::double, 0.0::double, 0.25::double, 0.125::double), (0.5, 0.5, 0.25, 0.25)) v(x, y, w, h))"""),
    "tpl_rows": ((), """tpl_rows as (select 'DOC' as doc, 'P' || cast(p_size % 4 as varchar) as page, cast(p_partkey % 194 as int) as r,
 cast(11000 + (p_partkey % 194) % 97 as varchar) as code, min(p_name) as name from part group by all)"""),
    "sheet_cells": ((), """sheet_cells as (select '月报_2024-0' || (o_custkey % 9 + 1) || '-15.xlsx' as workbook, 'C' || o_custkey as sheet, o_orderkey * 2 + 3 + i.i as r, u.c, u.v
 from orders, range(2) i(i), lateral (values (1, case when i.i = 0 then (11000 + o_orderkey % 97) || '.0' end), (2, o_orderpriority),
 (3, cast(cast(o_totalprice as decimal(18,2)) * (i.i + 1) as varchar)), (4, case when o_orderstatus <> 'P' then o_orderstatus end),
 (5, case when o_orderkey % 3 = 0 then '' else cast(o_orderkey as varchar) end)) u(c, v)
 union all select '月报_2024-0' || (k % 9 + 1) || '-15.xlsx', 'C' || k, h.r, h.c, h.v from (select distinct o_custkey as k from orders),
 (values (1,1,'车间'),(1,2,'名称'),(1,3,'一月'),(1,5,'二月'),(2,2,'名称'),(2,3,'计划'),(2,4,'实际'),(2,5,'计划')) h(r, c, v))"""),
    "sheet_merges": ((), """sheet_merges as (select '月报_2024-0' || (k % 9 + 1) || '-15.xlsx' as workbook, 'C' || k as sheet, h.r0, h.c0, h.r1, h.c1 from (select distinct o_custkey as k from orders),
 (values (1,1,2,1),(1,3,1,4)) h(r0, c0, r1, c1) union all select '月报_2024-0' || (o_custkey % 9 + 1) || '-15.xlsx', 'C' || o_custkey, o_orderkey * 2 + 3, 1, o_orderkey * 2 + 4, 1 from orders where o_orderkey % 3 <> 0)"""),
    "grid": ((), """grid as (select 'lineitem' as workbook, 'S' || l_suppkey as sheet, l_orderkey * 8 + l_linenumber as r, u.c, u.v
 from lineitem, lateral (values (1, cast(l_partkey as varchar)), (2, l_returnflag), (3, cast(cast(l_quantity as int) as varchar)),
 (4, cast(cast(l_extendedprice as decimal(18,2)) as varchar))) u(c, v))"""),
}


def define(name: str, needs: tuple[str, ...], text: str) -> None:
    CTES[name] = (needs, text)


def with_ctes(needs: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    ctes = [CTES[n][1] for n in ordered]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[len("with "):]
    return "with " + ",\n".join(ctes) + "\n" + body


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = with_ctes(needs, oracle)
        return build

    return register


def runner(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))
