"""De-duplicated append with schema evolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.number import code_text, double_text, text_key
from ledgerloom.scale import first_row


def resolve_dedup(config: str, header: Sequence[str]) -> list[str]:
    """Key columns by name, else by column letter or number; the default when nothing is configured."""
    found = []
    for part in (p.strip() for p in (config or "").split(";")):
        if not part:
            continue
        if part in header:
            found.append(part)
            continue
        index = int(part) if part.isdigit() else 0
        if part.isascii() and part.isalpha():
            for letter in part.upper():
                index = index * 26 + ord(letter) - 64
        if 1 <= index <= len(header):
            found.append(header[index - 1])
    return found or list(fv.DEFAULT_DEDUP)


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({f"_k{i}": text_key(F.col(f"`{k}`"), types[k]) for i, k in enumerate(keys)})


def key_names(keys: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def dedup_first(batch: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key by an explicit order; keys compare as text."""
    return first_row(keyed(batch, keys), key_names(keys), *order).drop(*key_names(keys))


def filled_rows(target: DataFrame) -> DataFrame:
    """Target rows with at least one non-empty cell."""
    blank = F.lit(True)
    for c in target.columns:
        blank &= F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) == ""
    return target.filter(~blank)


def new_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Batch rows to add: first per key, key not in the target yet.

    Existing keys are made distinct first, so a hot key crosses the shuffle once per task.
    """
    names = key_names(keys)
    fresh = first_row(keyed(batch, keys), names, *order)
    existing = keyed(filled_rows(target), keys).select(*names).distinct()
    return fresh.join(existing, names, "left_anti").drop(*names)


def header_fits(target_columns: Sequence[str], required: Sequence[str] = tuple(fv.PATH_COLUMNS)) -> bool:
    return all(c in target_columns for c in required)


def evolve(target: DataFrame, added: DataFrame) -> DataFrame:
    """Target and added rows; target columns first, then the new ones."""
    return target.unionByName(added, allowMissingColumns=True)


def append(batch: DataFrame, target: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return evolve(filled_rows(target), new_rows(batch, target, keys, *order))


def append_stats(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """input, batch and added row counts; one pass over each side's keys."""
    names = key_names(keys)
    counted = keyed(batch, keys).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    existing = keyed(filled_rows(target), keys).select(*names).distinct().withColumn("_old", F.lit(True))
    return counted.join(existing, names, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("input"), F.count(F.lit(1)).alias("batch"), F.count_if(F.col("_old").isNull()).alias("added")
    )


def force_text(df: DataFrame) -> DataFrame:
    """Code-like columns (by name) as text; whole numbers lose their decimals."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if any(word in name for word in fv.CODE_COLUMN_WORDS):
            c = double_text(c.cast("double")) if dtype in ("double", "float") else F.when(c.isNotNull(), code_text(c))
        out.append(c.alias(name))
    return df.select(*out)


def route(rows: DataFrame, rule: str, targets: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Rows with the target of their rule; rules without a target or switched off are dropped."""
    live = [(r, t) for r, t, on in targets if on and t]
    target = F.coalesce(*[F.when(F.col(rule) == r, F.lit(t)) for r, t in live])
    return rows.withColumn("target", target).filter(F.col("target").isNotNull())
