"""De-duplicated append queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import define, query
from ledgerloom.fixtures import Tables
from ledgerloom.operators import append
from ledgerloom.session import shared_folder

KEYS = ["day", "head"]

define(
    "batch",
    (),
    """batch as (select o_orderkey as seq, cast(o_orderdate as date) as day, cast(o_custkey % 50 as double) as head, o_orderstatus as status, o_totalprice as amount from orders)""",
)
define(
    "target",
    ("batch",),
    """target as (select day, head, status from batch where seq % 3 = 0 union all select null, null, '' from batch where seq % 1000 = 1)""",
)
define(
    "fresh",
    ("target",),
    """fresh as (select b.seq, b.day, b.head, b.status, b.amount from (select * from batch qualify row_number() over (partition by cast(day as date), head order by seq) = 1) b
 where not exists (select 1 from target x where cast(x.day as date) = cast(b.day as date) and x.head = b.head))""",
)


def batch(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 50).cast("double").alias("head"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
    )


def target(t: Tables) -> DataFrame:
    """A third of the rows as the existing target, with blank rows in it."""
    b = batch(t)
    blank = b.filter("seq % 1000 = 1").select(
        F.lit(None).cast(b.schema["day"].dataType).alias("day"), F.lit(None).cast("double").alias("head"), F.lit("").alias("status")
    )
    return b.filter("seq % 3 = 0").select("day", "head", "status").unionByName(blank)


@query("dedup_first", "select * from batch qualify row_number() over (partition by cast(day as date), head order by seq) = 1", ("batch",))
def dedup_first(t: Tables) -> DataFrame:
    return append.dedup_first(batch(t), KEYS, F.col("seq"))


@query("append_new", "select * from fresh", ("fresh",))
def append_new(t: Tables) -> DataFrame:
    return append.new_rows(batch(t), target(t), KEYS, F.col("seq"))


@query(
    "append_stats",
    "select (select count(*) from batch) as input, (select count(*) from (select distinct cast(day as date), head from batch)) as batch, (select count(*) from fresh) as added",
    ("fresh",),
)
def append_stats(t: Tables) -> DataFrame:
    counts = append.append_stats(batch(t), target(t), KEYS)
    return counts.select("input", "batch", "added")


@query(
    "append_evolve",
    "select day, head, status, null::bigint as seq, null::double as amount from target where day is not null union all select day, head, status, seq, amount from fresh",
    ("fresh",),
)
def append_evolve(t: Tables) -> DataFrame:
    return append.append(batch(t), target(t), KEYS, F.col("seq"))


@query(
    "append_guard",
    """select 'full' as target, true as fits, count(*) filter (o_orderkey % 2 = 1) as added from orders union all select 'short', false, 0::bigint""",
)
def append_guard(t: Tables) -> DataFrame:
    """Two stored targets, one without a key column: the header of the files decides whether rows are added."""
    keys, root, out = ["o_orderkey", "o_custkey"], shared_folder(t.spark), []
    for name, stored in (("full", t.orders.filter("o_orderkey % 2 = 0")), ("short", t.orders.drop("o_orderkey"))):
        stored.write.parquet(f"{root}/{name}")
        target = t.spark.read.parquet(f"{root}/{name}")
        fits = append.header_fits(target.columns, keys)
        added = append.new_rows(t.orders, target, keys, F.col("o_orderdate")) if fits else t.orders.limit(0)
        out.append(added.agg(F.lit(name).alias("target"), F.lit(fits).alias("fits"), F.count(F.lit(1)).alias("added")))
    return out[0].unionByName(out[1])


@query(
    "force_text",
    r"""select l_orderkey, l_linenumber, regexp_replace(trim(code_raw), '^([-+]?\d+)\.0+$', '\1') as "科目代码", cast(cast(file_seq as bigint) as varchar) as "行头路径_x", value_raw as other from src""",
    ("src",),
)
def force_text(t: Tables) -> DataFrame:
    rows = t.src.select(
        "l_orderkey", "l_linenumber", F.col("code_raw").alias("科目代码"), F.col("file_seq").cast("double").alias("行头路径_x"), F.col("value_raw").alias("other")
    )
    return append.force_text(rows)
