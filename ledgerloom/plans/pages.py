"""Recognised pages: ignore regions, template match, alignment, fill, checks and report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.number import num_lenient
from ledgerloom.operators import align, checks, choose, layout
from ledgerloom.scale import materialized


@dataclass
class PageResult:
    pages: DataFrame  # page_id, doc, page of the pages with a template
    lines: DataFrame
    aligned: DataFrame
    filled: DataFrame  # page_id, r, c, text
    report: DataFrame
    summary: DataFrame
    choice: DataFrame | None = None  # page_id, doc, page, score, note of every page with a candidate


# Share of a template page's codes that a page must hold to be laid over it.
CANDIDATE = 0.1


def run(
    items: DataFrame, cells: DataFrame, ignore: DataFrame, tpl: DataFrame, tpl_cells: DataFrame, bad_rows: DataFrame | None = None,
    page_w: float = 1000.0, page_h: float = 1400.0, balance: Sequence[int] = (), geometry: DataFrame | None = None,
    forced: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = (),
) -> PageResult:
    """`tpl_cells` (doc, page, r, c, text, kind) are the frozen texts and numeric places of the templates.

    With `geometry` (cells of the template pages as fractions) the template is chosen by structure and row keys among
    the pages whose codes are seen, and `forced` may name a page's template; else by the share of codes alone.

    `rules` are user checks over the filled rows, which have code, name and the amounts c<number>; `balance` lists the columns of opening debit and credit, movements and closing debit and credit;
    rows that do not add up are then the bad rows. Without it and without `bad_rows` the summary says
    that nothing was checked. Every page with a text is in the summary, also those no template fits.
    """
    kept = materialized(layout.drop_ignored(items, ignore, page_w, page_h))
    lined = layout.photo_line_items(kept)
    lines = materialized(layout.photo_lines(kept))
    shares, choice = align.template_scores(kept, tpl), None
    if geometry is None:
        pages = align.best_template(shares).select("page_id", "doc", "page")
    else:
        candidates = shares.filter(F.col("score") >= CANDIDATE)
        choice = materialized(choose.choose_page(kept, lines, choose.frames_of(cells), candidates, geometry, tpl, forced))
        pages = choice.filter("doc is not null").select("page_id", "doc", "page")
    pages = materialized(pages)
    coded = materialized(align.align_fuzzy(pages, tpl, lines).select("page_id", "r", "line_no"))
    claimed = materialized(align.claim_nearest(pages, tpl, lines, coded).select("page_id", "r", "line_no"))
    aligned = coded.unionByName(claimed)
    wanted = pages.join(tpl_cells, ["doc", "page"])
    # Only numeric columns take numbers, and only lines that stand for a template row vote on their places.
    bands = layout.column_bands(cells).join(wanted.filter("kind = 'num'").select("page_id", "c").distinct(), ["page_id", "c"], "left_semi")
    codes = lines.select("page_id", "line_no", F.col("code").alias("line_code"))
    used = lined.join(codes, ["page_id", "line_no"]).join(aligned.select("page_id", "line_no"), ["page_id", "line_no"], "left_semi")
    numbers = layout.band_items(used.drop("h", "cx", "cy"), bands, page_w)
    placed = layout.nearest_column(numbers, layout.column_median(numbers))
    values = placed.groupBy("page_id", "line_no", F.col("new_c").alias("c")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "item_no", "text"))), lambda x: x["text"]), "").alias("text")
    )
    filled = align.fill_vlookup(wanted.select("page_id", "r", "c", "text", "kind"), aligned, values)
    report = align.align_report(pages, tpl, lines, coded, claimed)
    checked = bad_rows is not None or bool(balance) or bool(rules)
    if bad_rows is None:
        bad_rows = _unbalanced(filled, pages, tpl, balance)
        if rules:
            bad_rows = bad_rows.unionByName(_against_rules(filled, pages, tpl, tpl_cells, rules)).distinct()
    listed = items.select("page_id").distinct().join(pages, "page_id", "left").select(
        "page_id", F.concat_ws("·", "doc", "page").alias("template"), F.lit(checked).alias("checked")
    )
    summary = checks.page_summary(listed, bad_rows, report)
    return PageResult(pages, lines, aligned, filled, report, summary, choice)


def _unbalanced(filled: DataFrame, pages: DataFrame, tpl: DataFrame, balance: Sequence[int]) -> DataFrame:
    """(page_id, r, code, name) of filled rows whose movements do not lead from opening to closing."""
    named = pages.join(tpl, ["doc", "page"]).select("page_id", "r", "code", "name")
    if not balance:
        return named.limit(0)
    terms = [f"t{i}" for i in range(len(balance))]
    amounts = filled.filter(F.col("c").isin(list(balance))).groupBy("page_id", "r").agg(
        *[F.max(F.when(F.col("c") == c, num_lenient(F.col("text")))).alias(t) for c, t in zip(balance, terms)]
    )
    return checks.row_balance(amounts, terms).select("page_id", "r").join(named, ["page_id", "r"])


def _against_rules(filled: DataFrame, pages: DataFrame, tpl: DataFrame, tpl_cells: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, r, code, name) of filled rows for which a user rule is true."""
    numeric = sorted(r.c for r in tpl_cells.filter("kind = 'num'").select("c").distinct().collect())  # columns of a sheet
    amounts = filled.groupBy("page_id", "r").agg(*[F.max(F.when(F.col("c") == c, num_lenient(F.col("text")))).alias(f"c{c}") for c in numeric])
    named = pages.join(tpl, ["doc", "page"]).select("page_id", "r", "code", "name")
    return checks.rule_checks(amounts.join(named, ["page_id", "r"]), rules).select("page_id", "r", "code", "name").distinct()
