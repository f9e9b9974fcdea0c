"""The data model derived from the TPC-H-like test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

REGIONS = [
    ("CITY", "CITY", "base", False),
    ("AFRICA", "AFRICA", "member", False),
    ("AMERICA", "AMERICA", "member", False),
    ("ASIA", "ASIA", "member", False),
    ("EUROPE", "EUROPE", "member", True),
    ("MIDDLE EAST", "MIDDLE EAST", "member", True),
]
WHITELIST = [str(c) for c in range(11000, 11097) if c % 21 == 0]
BACKFILL_MAP = [("11067", "512", 7), ("11068", "513", 7), ("11069", "514", 7), ("11070", "515", 7), ("11031", "502", 8)]
PARENTS = [("11064", "A"), ("11001", "A"), ("11028", "B"), ("11071", "B")]


class Tables:
    """Reads the parquet tables of one scale factor; derived frames are plain plans."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def obs(self) -> DataFrame:
        orders = self.read("orders").select(
            "o_custkey", "o_orderdate", F.col("o_totalprice").cast(MONEY).alias("value")
        )
        places = (
            self.read("nation")
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("r_name").alias("region"))
        )
        customers = self.read("customer").select("c_custkey", "c_nationkey")
        return (
            orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(
                "region",
                (11000 + F.col("o_custkey") % 97).cast("string").alias("code"),
                F.date_format("o_orderdate", "yyyy.MM").alias("period"),
            )
            .agg(F.sum("value").cast(MONEY).alias("value"))
        )

    @cached_property
    def obs_city(self) -> DataFrame:
        n = F.col("code").cast("int")
        offset = F.when(n % 7 == 0, F.lit("1.00")).when(n % 5 == 0, F.lit("0.01")).otherwise(F.lit("0.00"))
        return (
            self.obs.groupBy("code", "period")
            .agg(F.sum("value").alias("total"))
            .select(
                F.lit("CITY").alias("region"), "code", "period",
                (F.col("total") + offset.cast(MONEY)).cast(MONEY).alias("value"),
            )
        )

    @cached_property
    def saved(self) -> DataFrame:
        """The stored series: member regions and the city level."""
        return self.obs.unionByName(self.obs_city)

    @cached_property
    def src(self) -> DataFrame:
        li = self.read("lineitem")
        part, qty = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
        line = F.col("l_linenumber")
        return li.select(
            "l_orderkey", "l_linenumber",
            (F.col("l_suppkey") % 12).alias("file_seq"),
            F.when(F.col("l_orderkey") % 2 == 0, F.concat(part, F.lit(".0")))
            .otherwise(F.concat(F.lit(" "), part, F.lit(" "))).alias("code_raw"),
            F.when(line == 1, F.col("l_extendedprice").cast(MONEY).cast("string"))
            .when(line == 2, F.concat(qty, F.lit(",000.5")))
            .when(line == 3, F.concat(qty, F.lit("abc")))
            .when(line == 4, "--")
            .when(line == 5, "")
            .when(line == 6, F.concat(F.lit("  -"), qty, F.lit("  "))).alias("value_raw"),
        )

    @cached_property
    def items(self) -> DataFrame:
        e = F.col("event_id")
        x0, y0 = (e * 37) % 1000, (e * 53) % 1400
        return self.read("events").select(
            F.col("user_id").alias("page_id"), e.alias("item_no"),
            x0.alias("x0"), y0.alias("y0"), (x0 + 20 + e % 40).alias("x1"), (y0 + 14 + e % 6).alias("y1"),
            F.when(e % 3 == 0, (11000 + e % 97).cast("string")).otherwise(F.col("event_type")).alias("text"),
            ((50 + e % 50).cast("double") / 100).alias("score"),
        )

    @cached_property
    def cell_boxes(self) -> DataFrame:
        pages = self.read("events").select(F.col("user_id").alias("page_id")).distinct()
        return (
            pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("r"))
            .select("page_id", "r", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c"))
            .select(
                "page_id", "r", "c", (F.col("c") * 200).alias("x"), (F.col("r") * 100).alias("y"),
                F.lit(200).alias("w"), F.lit(100).alias("h"),
            )
        )

    @cached_property
    def ignore_rects(self) -> DataFrame:
        """Two per even page, as fractions of the 1000 x 1400 page."""
        pages = self.read("events").select(F.col("user_id").alias("page_id")).distinct().filter("page_id % 2 = 0")
        rects = F.array(
            F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.25).alias("w"), F.lit(0.125).alias("h")),
            F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(0.25).alias("w"), F.lit(0.25).alias("h")),
        )
        return pages.select("page_id", F.inline(rects))

    @cached_property
    def tpl_rows(self) -> DataFrame:
        """Template library: 4 pages of up to 194 rows, each code on two rows of a page."""
        r = (F.col("p_partkey") % 194).cast("int")
        return (
            self.read("part")
            .groupBy(F.concat(F.lit("P"), (F.col("p_size") % 4).cast("string")).alias("page"), r.alias("r"))
            .agg(F.min("p_name").alias("name"))
            .select(
                F.lit("DOC").alias("doc"), "page", "r",
                (11000 + F.col("r") % 97).cast("string").alias("code"), "name",
            )
        )

    @cached_property
    def library(self) -> DataFrame:
        """A template library that grows with part: one row for each part on four long pages. Codes share the
        first digits of one chart of accounts; every name is its own."""
        key = F.col("p_partkey")
        return self.read("part").select(
            F.lit("LIB").alias("doc"), F.concat(F.lit("T"), key % 4).alias("page"), F.floor(key / 4).cast("int").alias("r"),
            F.when(key % 11 == 10, "").otherwise((11000000 + key * 7).cast("string")).alias("code"), own_name(key, F.col("p_name")).alias("name"),
        )

    @cached_property
    def library_lines(self) -> DataFrame:
        """Every part read once as a line of a photo page: its code whole, with a wrong digit, cut off or lost, its
        name whole, with wrong letters or lost."""
        key = F.col("p_partkey")
        line, code, name = F.floor(key / 40).cast("int"), (11000000 + key * 7).cast("string"), own_name(key, F.col("p_name"))
        how = F.floor(key / 40) % 6
        wrong = F.concat(F.left(code, F.lit(6)), F.lit("x"), F.right(code, F.lit(1)))
        read_code = F.when(how == 0, code).when(how == 1, wrong).when(how == 2, F.right(code, F.lit(4))).otherwise("")
        letters = F.concat(F.left(name, F.lit(4)), F.lit("##"), F.substr(name, F.lit(7)))
        read_name = F.when(how == 3, name).when(how == 4, letters).when(how == 5, "").otherwise(F.left(name, F.lit(2)))
        text = F.when(how == 5, F.concat(F.lit("#"), code, F.lit(";"))).otherwise(F.concat(read_code, read_name))
        return self.read("part").select(
            (key % 40).alias("page_id"), line.alias("line_no"), (line * 20).cast("double").alias("y"), read_code.alias("code"), read_name.alias("name"), text.alias("text"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """lineitem as sheets: one sheet per supplier, columns 1..4 of each row."""
        cols = F.array(
            F.struct(F.lit(1).alias("c"), F.col("l_partkey").cast("string").alias("v")),
            F.struct(F.lit(2).alias("c"), F.col("l_returnflag").alias("v")),
            F.struct(F.lit(3).alias("c"), F.col("l_quantity").cast("int").cast("string").alias("v")),
            F.struct(F.lit(4).alias("c"), F.col("l_extendedprice").cast(MONEY).cast("string").alias("v")),
        )
        return self.read("lineitem").select(
            F.lit("lineitem").alias("workbook"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("sheet"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("r"), F.inline(cols),
        )

    @cached_property
    def grid_rows(self) -> DataFrame:
        """The sheet rows of `grid`."""
        return self.read("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("sheet"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("r")
        )

    @cached_property
    def sheet_cells(self) -> DataFrame:
        """orders as sheets: one per customer, two header rows, two rows per order."""
        o = self.read("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast(MONEY).alias("price"))
        k = F.col("o_orderkey")
        row = lambda i: F.array(*[
            F.struct((k * 2 + 3 + i).alias("r"), F.lit(c).alias("c"), v.cast("string").alias("v"))
            for c, v in [
                (1, F.when(F.lit(i == 0), F.concat(11000 + k % 97, F.lit(".0")))),
                (2, F.col("o_orderpriority")),
                (3, F.col("price") * (i + 1)),
                (4, F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))),
                (5, F.when(k % 3 == 0, "").otherwise(k.cast("string"))),
            ]
        ])
        book, sheet = book_of(F.col("o_custkey")), F.concat(F.lit("C"), "o_custkey")
        data = o.select(book.alias("workbook"), sheet.alias("sheet"), F.inline(F.concat(row(0), row(1))))
        heads = [(1, 1, "车间"), (1, 2, "名称"), (1, 3, "一月"), (1, 5, "二月"), (2, 2, "名称"), (2, 3, "计划"), (2, 4, "实际"), (2, 5, "计划")]
        head = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(c).alias("c"), F.lit(v).alias("v")) for r, c, v in heads])
        return data.unionByName(
            self.read("orders").select("o_custkey").distinct().select(book.alias("workbook"), sheet.alias("sheet"), F.inline(head))
        )

    @cached_property
    def sheet_merges(self) -> DataFrame:
        """Two header merges per sheet, and the head cell of an order's two rows."""
        book, sheet = book_of(F.col("o_custkey")), F.concat(F.lit("C"), "o_custkey")
        box = lambda r0, c0, r1, c1: F.struct(
            r0.cast("long").alias("r0"), F.lit(c0).alias("c0"), r1.cast("long").alias("r1"), F.lit(c1).alias("c1")
        )
        heads = F.array(box(F.lit(1), 1, F.lit(2), 1), box(F.lit(1), 3, F.lit(1), 4))
        k = F.col("o_orderkey")
        o = self.read("orders")
        return (
            o.select("o_custkey").distinct().select(book.alias("workbook"), sheet.alias("sheet"), F.inline(heads))
            .unionByName(o.filter(k % 3 != 0).select(
                book.alias("workbook"), sheet.alias("sheet"), F.inline(F.array(box(k * 2 + 3, 1, k * 2 + 4, 1)))
            ))
        )


def book_of(custkey):
    return F.concat(F.lit("月报_2024-0"), custkey % 9 + 1, F.lit("-15.xlsx"))


def own_name(partkey, name):
    """The part's name with its number in letters."""
    return F.concat(name, F.lit("-"), F.translate(partkey.cast("string"), "0123456789", "abcdefghij"))
