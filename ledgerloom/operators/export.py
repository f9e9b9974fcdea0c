"""Page grids as CSV, text, Markdown and JSON lines; names, redaction and manifests.

Exports are rows of text with a position, so a page of any size is written by many tasks;
only one sheet row is gathered at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.text import safe_sheet_name, strip, text_or_empty
from ledgerloom.scale import number_within

LIMIT = fv.EXCEL_NAME_LIMIT


def row_arrays(grid: DataFrame) -> DataFrame:
    """(page_id, r, texts): the cells of one row, left to right."""
    cells = F.sort_array(F.collect_list(F.struct("c", text_or_empty(F.col("text")).alias("t"))))
    return grid.groupBy("page_id", "r").agg(F.transform(cells, lambda x: x["t"]).alias("texts"))


def csv_field(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp_like(c, F.lit('[",\r\n]')), quoted).otherwise(c)


def csv_lines(grid: DataFrame) -> DataFrame:
    line = F.array_join(F.transform("texts", csv_field), ",")
    lone = (F.size("texts") == 1) & (F.element_at("texts", 1) == "")
    return row_arrays(grid).select("page_id", "r", F.when(lone, '""').otherwise(line).alias("line"))


def text_lines(grid: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, pos, line): a heading per page, cells joined by two spaces."""
    heading = pages.select("page_id", F.lit(-1).cast("bigint").alias("pos"), F.concat(F.lit("===== "), _title(), F.lit(" =====")).alias("line"))
    rows = row_arrays(grid).select("page_id", F.col("r").cast("bigint").alias("pos"), F.array_join("texts", "  ").alias("line"))
    return heading.unionByName(rows).unionByName(_gap(pages, -2))


def _title() -> Column:
    return F.coalesce(F.nullif("title", F.lit("")), "name")


def _gap(pages: DataFrame, pos: int) -> DataFrame:
    """Blank line before every page but the first."""
    later = pages.filter(F.col("page_id") > pages.select(F.min("page_id")).scalar())
    return later.select("page_id", F.lit(pos).cast("bigint").alias("pos"), F.lit("").alias("line"))


def markdown_lines(grid: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, pos, line): heading, header row, rule and rows padded to the widest row."""
    widest = grid.groupBy("page_id").agg((F.max("c") + 1).alias("_n"), F.min("r").alias("_top"))
    rows = row_arrays(grid).join(widest, "page_id")
    padded = F.concat("texts", F.array_repeat(F.lit(""), F.col("_n") - F.size("texts")))
    escaped = F.transform(padded, lambda x: F.replace(x, F.lit("|"), F.lit("\\|")))
    line = F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))
    body = rows.select("page_id", (F.col("r") * 2).cast("bigint").alias("pos"), line.alias("line"))
    rule = widest.select("page_id", (F.col("_top") * 2 + 1).cast("bigint").alias("pos"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("_n"))).alias("line"))
    heads = pages.select("page_id", F.inline(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("pos"), F.concat(F.lit("## "), _title()).alias("line")),
        F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("line")),
    )))
    return heads.unionByName(body).unionByName(rule).unionByName(_gap(pages, -3))


def json_parts(grid: DataFrame, pages: DataFrame, merges: DataFrame) -> DataFrame:
    """(page_id, section, r, c, part): pieces whose concatenation in that order is the JSON document.

    Sections: 0 head, 1 rows, 2 merges, 3 scores, 4 end. Every list item carries its own comma.
    """
    zero = lambda n: F.lit(n).cast("bigint")
    # One-element array without its brackets: the JSON form of a single value.
    string = lambda c: F.regexp_replace(F.to_json(F.array(text_or_empty(c))), r"^\[|\]$", "")
    head = pages.select(
        "page_id", zero(0).alias("section"), zero(0).alias("r"), zero(0).alias("c"),
        F.concat(F.lit('{"name":'), string(F.col("name")), F.lit(',"title":'), string(F.col("title")), F.lit(',"mode":'), string(F.col("mode")), F.lit(',"rows":[')).alias("part"),
    )
    top = grid.groupBy("page_id").agg(F.min("r").alias("_top"))
    rows = row_arrays(grid).join(top, "page_id").select(
        "page_id", zero(1).alias("section"), F.col("r").cast("bigint").alias("r"), zero(0).alias("c"),
        F.concat(F.when(F.col("r") == F.col("_top"), "").otherwise(","), F.to_json("texts")).alias("part"),
    )
    comma = lambda first: F.when(first, "").otherwise(",")
    m_first = merges.groupBy("page_id").agg(F.min(F.struct("r", "c")).alias("_at"))
    merged = merges.join(m_first, "page_id").select(
        "page_id", zero(2).alias("section"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"),
        F.concat(comma(F.struct("r", "c") == F.col("_at")), F.to_json(F.array("r", "c", "rspan", "cspan"))).alias("part"),
    )
    scored = grid.filter(F.col("score").isNotNull())
    s_first = scored.groupBy("page_id").agg(F.min(F.struct("r", "c")).alias("_at"))
    scores = scored.join(s_first, "page_id").select(
        "page_id", zero(3).alias("section"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"),
        F.concat(comma(F.struct("r", "c") == F.col("_at")), F.lit('"'), "r", F.lit(","), "c", F.lit('":'), F.round("score", 3).cast("string")).alias("part"),
    )
    joints = pages.select("page_id", F.inline(F.array(*[
        F.struct(zero(s).alias("section"), zero(-1).alias("r"), zero(0).alias("c"), F.lit(p).alias("part"))
        for s, p in ((2, '],"merges":['), (3, '],"scores":{'), (4, "}}"))
    ])))
    out = head
    for part in (rows, merged, scores, joints):
        out = out.unionByName(part)
    return out


def unique_names(pages: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Sheet names of at most 31 characters; repeats get `(2)`, `(3)` in order of `seq`."""
    cleaned = pages.withColumn("_clean", safe_sheet_name(F.col(name)))
    ranked = number_within(cleaned, ["_clean"], seq, "_k")
    suffix = F.concat(F.lit("("), F.col("_k"), F.lit(")"))
    full = F.concat(F.left("_clean", LIMIT - F.length(suffix)), suffix)
    return ranked.withColumn("sheet_name", F.when(F.col("_k") == 1, F.col("_clean")).otherwise(full)).drop("_clean", "_k")


def sequence_names(pages: DataFrame) -> DataFrame:
    """(seq, title, tpl_page, name) -> base name with the template page and `#k` where a title repeats.

    The tail is never cut: the title gives way first.
    """
    clean = lambda c: strip(F.regexp_replace(text_or_empty(c), r"[/*?:\[\]]", "_"))
    pick = F.coalesce(F.nullif(strip(F.col("title")), F.lit("")), F.nullif(strip(F.col("tpl_page")), F.lit("")), F.nullif(strip(F.col("name")), F.lit("")), F.lit("Sheet"))
    named = pages.withColumn("_pick", pick).withColumn("_tp", strip(F.col("tpl_page")))
    base = F.coalesce(F.nullif(clean(F.col("_pick")), F.lit("")), F.lit("Sheet"))
    counts = named.groupBy("_pick", "_tp").agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_within(named, ["_pick", "_tp"], "seq", "_k").join(counts, ["_pick", "_tp"]).withColumn("_base", base)
    fits = F.filter(F.sequence(F.lit(0), F.length("_tp")), lambda k: F.contains("_base", F.left("_tp", k)))
    rest = F.substring(F.col("_tp"), F.array_max(fits) + 1, F.length("_tp"))
    tail = F.concat(
        F.when(rest != "", F.concat(F.lit("#"), clean(rest))).otherwise(""),
        F.when(F.col("_n") > 1, F.concat(F.lit("#"), F.col("_k"))).otherwise(""),
    )
    tailed = ranked.withColumn("_tail", tail)
    squeezed = F.replace("_base", F.lit(fv.SQUEEZE_WORD), F.lit(""))
    room = LIMIT - F.length("_tail")
    short = F.when(F.length("_base") <= room, F.col("_base")).when(F.length(squeezed) <= room, squeezed).otherwise(F.left("_base", room))
    return tailed.withColumn("sheet_name", F.concat(short, F.col("_tail"))).drop("_pick", "_tp", "_n", "_k", "_base", "_tail")


LOCAL_PATH = r"[A-Za-z]:[\\/]"


def redact(cells: DataFrame, numeric: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values inside the numeric region become null; places and all other cells stay."""
    marked = cells.join(numeric.select(*keys).distinct().withColumn("_hide", F.lit(True)), list(keys), "left")
    return marked.withColumn("v", F.when(F.col("_hide").isNull(), F.col("v"))).drop("_hide")


def local_paths(cells: DataFrame, allowed_suffix: str = "") -> DataFrame:
    """Cells with a machine-local path that is not an allowed one; publishing must stop on any row."""
    found = cells.filter(F.regexp_like("v", F.lit(LOCAL_PATH)))
    if allowed_suffix:
        found = found.filter(~F.endswith(F.replace("v", F.lit("\\"), F.lit("/")), F.lit(allowed_suffix)))
    return found


def row_digests(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values]), 256).alias("sha256"))
