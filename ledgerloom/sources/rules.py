"""Rule tables: typed defaults, `;` lists and yes/no tokens."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.geometry import column_index
from ledgerloom.functions.number import code_text
from ledgerloom.functions.text import strip


def tolerance_of(c: Column) -> Column:
    return F.coalesce(strip(c).try_cast("double"), F.lit(fv.DEFAULT_TOLERANCE))


def list_of(c: Column) -> Column:
    """'a; b;' -> ['a', 'b']"""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def region_rules(sheet: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(name, kw, role, no_data, *keep); rows without a name are dropped, kw defaults to the name."""
    name, kw = strip(F.col("name")), strip(F.col("kw"))
    role = strip(F.coalesce(F.nullif("role", F.lit("")), F.lit("成员")))
    return sheet.filter(name != "").select(
        *keep, name.alias("name"), F.when(kw == "", name).otherwise(kw).alias("kw"), role.alias("role"),
        strip(F.col("no_data")).isin(fv.YES_TOKENS).alias("no_data"),
    )


def extract_rules(sheet: DataFrame, keep: Sequence[str] = (), seq: str | None = None) -> DataFrame:
    """Typed extract rules. A blank `enabled` means disabled; a blank `write` means enabled. With `seq`,
    the line's number in the sheet, a rule without a name is called after it."""
    text = lambda c: strip(F.col(c))
    number = lambda c: F.coalesce(text(c).try_cast("int"), F.lit(0))
    rows = F.transform(F.filter(F.transform(F.split(text("header_rows"), ","), strip), lambda x: F.regexp_like(x, F.lit(r"^\d+$"))), lambda x: x.cast("int"))
    index = column_index(F.col("row_header_col"))
    return sheet.filter(~text("enabled").isin("", "否", "0", "false")).select(
        *keep, (F.when(text("name") == "", F.concat(F.lit("规则"), F.col(seq))).otherwise(text("name")) if seq else text("name")).alias("name"), text("wb_keyword").alias("wb_keyword"), text("sheet_keyword").alias("sheet_keyword"),
        F.when(index == 0, 1).otherwise(index).alias("row_header_col"),
        F.when(F.size(rows) == 0, F.array(F.lit(1))).otherwise(rows).alias("header_rows"),
        number("row_start").alias("row_start"), number("row_end").alias("row_end"),
        column_index(F.col("col_start")).alias("col_start"), column_index(F.col("col_end")).alias("col_end"),
        text("skip_keywords").alias("skip_keywords"), text("target").alias("target"), text("dedup").alias("dedup"),
        (~F.lower(text("write")).isin(fv.NO_TOKENS)).alias("write"),
    )


@dataclass
class ReconcileConfig:
    """Settings of a reconciliation run. Small by nature, so held on the driver."""

    value_col: str = fv.DEFAULT_VALUE_COLUMN
    tolerance: float = fv.DEFAULT_TOLERANCE
    base_region: str = fv.DEFAULT_BASE_REGION
    regions: list[tuple[str, str, str, bool]] = field(default_factory=lambda: list(fv.DEFAULT_REGIONS))
    whitelist: list[str] = field(default_factory=list)
    backfill_regions: list[str] = field(default_factory=lambda: list(fv.DEFAULT_BACKFILL_REGIONS))
    backfill_map: list[tuple[str, str, int]] = field(default_factory=lambda: list(fv.DEFAULT_BACKFILL_MAP))
    backfill_parents: list[str] = field(default_factory=lambda: list(fv.DEFAULT_BACKFILL_PARENTS))
    fee_codes: list[str] = field(default_factory=lambda: list(fv.DEFAULT_FEE_CODES))
    increment_code: str = fv.DEFAULT_INCREMENT_CODE
    group_a_parents: list[str] = field(default_factory=lambda: list(fv.DEFAULT_GROUP_A_PARENTS))
    source_no_data_regions: list[str] = field(default_factory=lambda: list(fv.DEFAULT_SOURCE_NO_DATA_REGIONS))

    @property
    def members(self) -> list[str]:
        return [r[0] for r in self.regions if r[0] != self.base_region]

    @property
    def no_data_regions(self) -> list[str]:
        return [r[0] for r in self.regions if r[3]]

    @property
    def parent_groups(self) -> list[tuple[str, str]]:
        return [(p, "A" if p in self.group_a_parents else "B") for p in self.backfill_parents]

    @property
    def watched(self) -> list[str]:
        return [*self.fee_codes, self.increment_code]


def load_config(
    settings: DataFrame, regions: DataFrame | None = None, mapping: DataFrame | None = None, whitelist: DataFrame | None = None
) -> ReconcileConfig:
    """Configuration tables (key, value), (name, kw, role, no_data), (code, fee_code, fee_col), (code) -> settings.

    These are hand-written rule sheets of at most a few hundred lines.
    """
    found = ReconcileConfig()
    typed = settings.select(strip(F.col("key")).alias("k"), strip(F.col("value")).alias("v"), tolerance_of(F.col("value")).alias("tol"),
                            list_of(F.col("value")).alias("items"), F.transform(list_of(F.col("value")), code_text).alias("codes"))
    for row in typed.filter("v <> ''").collect():
        if row.k == "取数列":
            found.value_col = row.v
        elif row.k == "容差":
            found.tolerance = row.tol
        elif row.k == "市级基准":
            found.base_region = row.v
        elif row.k == "补录父项":
            found.backfill_parents = list(row.codes)
        elif row.k == "补录地区":
            found.backfill_regions = list(row["items"])
    if regions is not None:
        rows = [(r["name"], r.kw, r.role, r.no_data) for r in region_rules(regions).collect()]
        found.regions = rows or found.regions
    if mapping is not None:
        column = strip(F.col("fee_col")).try_cast("double").cast("int")
        typed = mapping.select(
            code_text(F.col("code")).alias("code"), code_text(F.col("fee_code")).alias("fee_code"),
            F.coalesce(F.nullif(column, F.lit(0)), F.lit(fv.DEFAULT_FEE_COLUMN)).alias("fee_col"),
        ).filter("code <> '' and fee_code <> ''")
        found.backfill_map = [(r.code, r.fee_code, r.fee_col) for r in typed.collect()] or found.backfill_map
    if whitelist is not None:
        found.whitelist = [r.code for r in whitelist.select(code_text(F.col("code")).alias("code")).filter("code <> ''").distinct().collect()]
    return found
