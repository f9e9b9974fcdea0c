"""Template matching and row alignment of recognised pages.

`lines` are (page_id, line_no, y, code, name, text) and `pages` pairs each page with its
template page (page_id, doc, page). Template rows (doc, page, r, code, name) are sheet rows,
text lines of a page are bounded by its height; the arrays below hold nothing larger.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.fuzzy import coded_match, codes_match, key_match, near_keys_match, squeezed_match, text_match
from ledgerloom.functions.number import looks_numeric, numeric_text
from ledgerloom.functions.text import digits, has_meaning, key_code, squeeze, strip
from ledgerloom.operators.fuzzy_index import bits_by_place, contained_pairs, digit_pairs, near_pairs, parts_for
from ledgerloom.scale import first_row, materialized, number_within, shuffled

TPL = ["doc", "page"]
# Stands for a missing line number in the walk: before all others.
_NO_LINE = -(1 << 63)
# Lines of a row that are looked at together.
_AT_ONCE = 256


def coded(c: Column) -> Column:
    return key_code(c) != ""


def align_exact(pages: DataFrame, tpl: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, r, line_no): the k-th template row of a code takes the k-th line of that code."""
    rows = number_within(tpl.filter(coded(F.col("code"))).select(*TPL, "r", "code"), [*TPL, "code"], "r", "k", many=True)
    read = number_within(lines.filter(F.col("code") != "").select("page_id", "line_no", "code"), ["page_id", "code"], "line_no", "k", many=True)
    return read.join(pages, "page_id").join(rows, [*TPL, "code", "k"]).select("page_id", "r", "line_no")


def _candidates(tpl: DataFrame, spare: DataFrame) -> DataFrame:
    """(page_id, r, line_no, by_key, by_name) for spare lines that resemble a template row; lines with
    neither code nor name only where their text holds the code.

    The fuzzy tests run once per distinct (code, name) of a template page, on the candidates of the key index. Texts
    are written with a number each, so that pairs are told apart and sent on as two numbers.
    """
    rows = tpl.select(*TPL, "r", F.col("code").alias("t_code"), F.col("name").alias("t_name"))
    number = F.monotonically_increasing_id()
    seen = materialized(spare.filter("code <> '' or name <> ''").select(*TPL, "code", "name").distinct().withColumn("_s", number))
    wanted = materialized(rows.select(*TPL, "t_code", "t_name").distinct().withColumn("_t", number))
    names = squeeze(F.col("t_name"))
    bits = bits_by_place(wanted.select(names.alias("_n")), "_n")
    like = matching_keys(seen, wanted, parts_for(spare.sparkSession, seen.count() + wanted.count()), bits)
    texts = spare.filter("code = ''").select(*TPL, "text").distinct()
    coded_rows = rows.filter(coded(F.col("t_code")))
    by_text = contained_pairs(coded_rows.select(*TPL, "t_code").distinct(), texts, TPL, "t_code", "text")
    # All of these are as many as rows or lines; their files and columns are small enough to be taken for few.
    glued = spare.filter("code = ''").join(shuffled(by_text), [*TPL, "text"]).join(shuffled(coded_rows), ["t_code", *TPL])
    lines_of = spare.join(shuffled(seen), ["code", "name", *TPL]).select("page_id", "line_no", "_s")
    rows_of = rows.join(shuffled(wanted), ["t_code", "t_name", *TPL]).select("r", "_t")
    found = like.join(shuffled(lines_of), "_s").join(shuffled(rows_of), "_t")
    return found.select("page_id", "r", "line_no", "by_key", "by_name").unionByName(
        glued.select("page_id", "r", "line_no", F.lit(True).alias("by_key"), F.lit(False).alias("by_name"))
    )


def candidate_keys(seen: DataFrame, wanted: DataFrame, parts: int | None = None, bits: dict[int, list[float]] | None = None) -> DataFrame:
    """(what tells a row of `seen` and of `wanted`, by_key, by_name): pairs that name the same row, from key lookups.

    `seen` (doc, page, code, name) and `wanted` (doc, page, t_code, t_name) are told by their numbers `_s` and `_t`, or
    by their texts where they have none. One lookup for each way in which `row_key_match` can be true: nearly equal codes,
    digits inside one another, names inside one another, equal and nearly equal names; each is tested as it is found, on
    the few columns its test needs. A pair may be found more than once. `parts`: tasks of the lookups of near values;
    `bits`: how the names are told apart (`bits_by_place`).
    """
    of_seen = ["_s"] if "_s" in seen.columns else ["code", "name"]
    of_want = ["_t"] if "_t" in wanted.columns else ["t_code", "t_name"]
    code, t_code = key_code(F.col("code")), key_code(F.col("t_code"))
    both, whole = key_code(F.concat("code", "name")), F.concat("code", "name")
    # Codes and names with their code count by key only for rows with a code.
    want = wanted.filter(t_code != "")
    # The code, and code and name together, each once for every text they make.
    texts = F.array_distinct(F.array(F.struct(code.alias("_x"), F.lit(True).alias("_own")), F.struct(both.alias("_x"), (both == code).alias("_own"))))
    keys = seen.select(*TPL, *of_seen, whole.alias("_whole"), F.inline(texts))
    # With its name in it, a code of fewer than three characters counts only if it is there as it is written.
    keys = keys.select(*TPL, *of_seen, "_x", "_own", F.when(F.length("_x") <= 3, F.col("_whole")).alias("_short"))
    codes = want.select(*TPL, *of_want, t_code.alias("_tk"), F.when(F.length(t_code) < 3, F.col("t_code")).alias("_tshort"))
    counts = F.col("_own") | (F.length("_tk") >= 3) | F.coalesce(F.contains("_short", F.col("_tshort")), F.lit(False))
    numbers = seen.select(*TPL, *of_seen, F.explode(F.array_distinct(F.array(digits(code), digits(both)))).alias("_x"))
    of_codes = want.select(*TPL, *of_want, digits(t_code).alias("_td"))
    read, long_named = seen.select(*TPL, *of_seen, whole.alias("_whole")), want.filter(F.length("t_name") >= 3).select(*TPL, *of_want, "t_name")
    named = seen.select(*TPL, *of_seen, squeeze(F.col("name")).alias("_n"), looks_numeric(squeeze(F.col("name"))).alias("_number")).filter("_n <> ''")
    called = wanted.select(*TPL, *of_want, squeeze(F.col("t_name")).alias("_tn"), looks_numeric(squeeze(F.col("t_name"))).alias("_tnumber"), (t_code != "").alias("_coded")).filter("_tn <> ''")
    plain = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.replace(c, F.lit(","), F.lit(""))))).alias("_e")
    same = squeezed_match(*[F.col(c) for c in ("_tn", "_n", "_tnumber", "_number")])
    by_key = [
        near_pairs(keys, codes, TPL, "_x", "_tk", 25, None, parts=parts).filter(near_keys_match(F.col("_tk"), F.col("_x")) & counts),
        digit_pairs(numbers, of_codes, TPL, "_x", "_td"),
        digit_pairs(of_codes, numbers, TPL, "_td", "_x"),
        contained_pairs(long_named, read, TPL, "t_name", "_whole"),
        contained_pairs(read, long_named, TPL, "_whole", "t_name"),
    ]
    by_name = [
        named.select("*", plain("_n")).join(shuffled(called.select("*", plain("_tn"))), ["_e", *TPL]).filter(same),
        near_pairs(named.filter(F.length("_n") >= 4), called.filter(F.length("_tn") >= 4), TPL, "_n", "_tn", 20, 20, parts=parts, bits=bits).filter(same),
    ]
    flags = lambda key, name: (key.alias("by_key"), name.alias("by_name"))
    found = [df.select(*of_seen, *of_want, *flags(F.lit(True), F.lit(False))) for df in by_key]
    found += [df.select(*of_seen, *of_want, *flags(F.col("_coded"), F.lit(True))) for df in by_name]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def matching_keys(seen: DataFrame, wanted: DataFrame, parts: int | None = None, bits: dict[int, list[float]] | None = None) -> DataFrame:
    """(_s, _t, by_key, by_name): the numbered texts that pass, each pair once: by_key (`row_key_match`), by_name (names that agree)."""
    found = candidate_keys(seen, wanted, parts, bits)
    return found.groupBy("_s", "_t").agg(F.max("by_key").alias("by_key"), F.max("by_name").alias("by_name"))


def _page_table(group: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    """The columns with the group's page in front."""
    n = len(next(iter(columns.values())))
    page = pa.repeat(group["page_id"][0], n)
    return pa.table({"page_id": page, **columns})


def _walked(page: pa.Table) -> pa.Table:
    """One page's pairs in template order: each open row takes its first free line; then, by name, each pair
    whose row and line are both free. A row's lines lie side by side in sorted arrays.

    Parts: 0 an open row (li = 1 if any line without code and name fits it), 1 such a line, 2 row and line by
    key, 3 row and line by name.
    """
    part, rs = page["part"].to_numpy(), page["r"].to_numpy()
    lis = pc.fill_null(page["li"], _NO_LINE).to_numpy()
    lines, places = np.unique(lis, return_inverse=True)
    used = np.zeros(len(lines), bool)

    def by_row(of: int, wanted: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """The lines' places of one part in order of row and line, and where those of each wanted row begin and end."""
        at = np.flatnonzero(part == of)
        at = at[np.lexsort((places[at], rs[at]))]
        return places[at], np.searchsorted(rs[at], wanted, "left").tolist(), np.searchsorted(rs[at], wanted, "right").tolist()

    def first_free(held: np.ndarray, begin: int, end: int) -> int | None:
        for lo in range(begin, end, _AT_ONCE):
            some = held[lo : min(lo + _AT_ONCE, end)]
            free = some[~used[some]]
            if len(free):
                return int(free[0])
        return None

    found: dict[int, tuple[int, str]] = {}
    opened = np.flatnonzero(part == 0)
    opened = opened[np.lexsort((lis[opened], rs[opened]))]
    blanks = np.sort(places[part == 1]).tolist()
    next_blank = 0
    for r, anything, begin, end in zip(rs[opened].tolist(), (lis[opened] == 1).tolist(), *(x := by_row(2, rs[opened]))[1:]):
        while next_blank < len(blanks) and used[blanks[next_blank]]:
            next_blank += 1
        best = first_free(x[0], begin, end)
        if anything and next_blank < len(blanks) and (best is None or blanks[next_blank] < best):
            best = blanks[next_blank]
        if best is not None:
            found[r] = (best, "key")
            used[best] = True
    named = np.unique(rs[part == 3])
    held, begins, ends = by_row(3, named)
    for r, begin, end in zip(named.tolist(), begins, ends):
        best = None if r in found else first_free(held, begin, end)
        if best is not None:
            found[r] = (best, "name")
            used[best] = True
    taken = pa.array(lines[[i for i, _ in found.values()]] if found else [], pa.int64())
    taken = pc.if_else(pc.equal(taken, _NO_LINE), pa.scalar(None, pa.int64()), taken)
    return _page_table(page, {"r": pa.array(list(found), pa.int32()), "line_no": taken.cast(pa.int32()), "stage": pa.array([s for _, s in found.values()], pa.string())})


def align_fuzzy(pages: DataFrame, tpl: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, r, line_no, stage): exact codes first, then row keys, then names, each 1:1 in template order.

    Exact pairs come from a join; candidates among what they leave come from key lookups, and only these are
    walked in order, page by page (a page is a sheet). Exact pairs and spare lines are written once, as
    several later joins read them.
    """
    exact = materialized(align_exact(pages, tpl, lines))
    spare = materialized(lines.join(exact, ["page_id", "line_no"], "left_anti").join(pages, "page_id"))
    row, line = F.col("r").cast("long").alias("r"), F.col("line_no").cast("long").alias("li")
    pairs = materialized(_candidates(tpl, spare))
    open_rows = pages.join(tpl.filter(coded(F.col("code"))), TPL).join(exact.select("page_id", "r"), ["page_id", "r"], "left_anti")
    nothing = F.lit(None).cast("long")
    parts = (
        open_rows.select("page_id", F.lit(0).alias("part"), row, (F.length("name") >= 3).cast("long").alias("li"))
        .unionByName(spare.filter("code = '' and name = ''").select("page_id", F.lit(1).alias("part"), nothing.alias("r"), line))
        .unionByName(pairs.filter("by_key").select("page_id", F.lit(2).alias("part"), row, line))
        .unionByName(pairs.filter("by_name").join(exact.select("page_id", "r"), ["page_id", "r"], "left_anti").select("page_id", F.lit(3).alias("part"), row, line))
    ).select("page_id", "part", F.coalesce("r", F.lit(-1)).alias("r"), "li")
    key = exact.schema["page_id"].dataType.simpleString()
    # Pages with neither candidates nor lines that fit anything have nothing to walk.
    busy = parts.filter("part > 0").select("page_id").distinct()
    found = parts.join(busy, "page_id", "left_semi").groupBy("page_id").applyInArrow(_walked, f"page_id {key}, r int, line_no int, stage string")
    return exact.withColumn("stage", F.lit("code")).unionByName(found)


def unmatched_rows(pages: DataFrame, tpl: DataFrame, aligned: DataFrame) -> DataFrame:
    """Template rows with a code that no line took."""
    wanted = pages.join(tpl.filter(coded(F.col("code"))), TPL)
    return wanted.join(aligned.select("page_id", "r"), ["page_id", "r"], "left_anti").select("page_id", "r", "code", "name")


def extra_lines(lines: DataFrame, aligned: DataFrame) -> DataFrame:
    """Lines with a code that no template row took."""
    return lines.filter(F.col("code") != "").join(aligned.select("page_id", "line_no"), ["page_id", "line_no"], "left_anti").select(
        "page_id", "line_no", "code"
    )


def unknown_lines(pages: DataFrame, tpl: DataFrame, lines: DataFrame, aligned: DataFrame) -> DataFrame:
    """Extra lines that are neither header nor total rows and whose code no template row resembles."""
    words = "|".join(fv.MID_HEADER_WORDS)
    both = F.concat("code", F.lit(" "), "name")
    spare = lines.filter(coded(F.col("code")) & ~F.regexp_like(both, F.lit(words)) & ~F.contains(both, F.lit(fv.TOTAL_WORD)))
    spare = spare.join(aligned.select("page_id", "line_no"), ["page_id", "line_no"], "left_anti")
    placed = spare.join(pages, "page_id")
    codes = materialized(tpl.filter(coded(F.col("code"))).select(*TPL, F.col("code").alias("_t")).distinct())
    seen = materialized(placed.select(*TPL, "code").distinct())
    parts = parts_for(lines.sparkSession, seen.count() + codes.count())
    read = seen.withColumns({"_k": key_code(F.col("code")), "_d": digits(key_code(F.col("code")))})
    want = codes.withColumns({"_tk": key_code(F.col("_t")), "_td": digits(key_code(F.col("_t")))})
    near = [near_pairs(read, want, TPL, "_k", "_tk", 25, None, parts=parts), digit_pairs(read, want, TPL, "_d", "_td"), digit_pairs(want, read, TPL, "_td", "_d")]
    maybe = near[0].select(*TPL, "code", "_t").unionByName(near[1].select(*TPL, "code", "_t")).unionByName(near[2].select(*TPL, "code", "_t"))
    known = maybe.filter(key_match(F.col("_t"), F.col("code"))).select(*TPL, "code").distinct()
    return placed.join(known, [*TPL, "code"], "left_anti").select("page_id", "line_no", "code")


# Rows and lines walked together while nothing between them competes.
RUN_ROWS = 4096


def _nearest_free(group: pa.Table) -> pa.Table:
    """Rows in order of r, each with the nearest line that is still free: a search in the sorted places, and
    links over taken places that shorten as they are followed, so n log n in all.

    Ties of distance go to the smaller line number. Lines of one place stand together, in the order of line_no.
    """
    is_row, nos, ys, reaches = (group[c].to_numpy() for c in ("is_row", "no", "y", "reach"))
    y, no = ys[~is_row], nos[~is_row]
    order = np.lexsort((no, y))
    y, no = y[order], no[order]
    n = len(y)
    up, down = np.arange(n + 1), np.arange(n + 1)  # next free place from i on; last free place before i, plus one

    def free(links: np.ndarray, i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return int(root)

    def first_of_place(i: int) -> int:
        """The free line of smallest number at the place of line i."""
        return free(up, int(np.searchsorted(y, y[i], "left")))

    rows, found = np.flatnonzero(is_row), []
    rows = rows[np.argsort(nos[rows], kind="stable")] if n else rows[:0]
    for r, want, reach in zip(nos[rows].tolist(), ys[rows].tolist(), reaches[rows].tolist()):
        at = int(np.searchsorted(y, want, "left"))
        above, below = free(up, at), free(down, at) - 1
        best = []
        if above < n and abs(y[above] - want) <= reach:
            best.append((abs(y[above] - want), no[above], above))
        if below >= 0 and abs(y[below] - want) <= reach:
            i = first_of_place(below)
            best.append((abs(y[i] - want), no[i], i))
        if best:
            _, line, i = min(best)
            found.append((r, line))
            up[i], down[i + 1] = i + 1, i
    return _page_table(group, {"r": pa.array([r for r, _ in found], pa.int32()), "line_no": pa.array([int(line) for _, line in found], pa.int32())})


def claim_nearest(pages: DataFrame, tpl: DataFrame, lines: DataFrame, aligned: DataFrame) -> DataFrame:
    """(page_id, r, line_no): rows without a code take the nearest unused line around the y their
    matched neighbours imply, within 1.3 x the median line distance.

    Neighbours come from windows over a page's rows. Rows and lines are cut into runs with no free line in
    reach of two of them; a run is walked alone, so a long page is many small groups unless all its rows
    compete.
    """
    y = F.col("y").cast("double")
    step = F.lag(y).over(Window.partitionBy("page_id").orderBy("line_no", y))
    between = lines.select("page_id", (y - step).alias("gap")).filter("gap is not null").groupBy("page_id").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    reach = between.select("page_id", (F.coalesce(F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1), F.lit(20.0)) * 1.3).alias("reach"))
    anchors = aligned.join(lines.select("page_id", "line_no", y.alias("y")), ["page_id", "line_no"]).groupBy("page_id", F.col("r").cast("long").alias("r")).agg(F.min("y").alias("lo_y"), F.max("y").alias("hi_y"))
    held = anchors.select("page_id").distinct()
    blank = pages.join(tpl.filter(~coded(F.col("code"))).select(*TPL, F.col("r").cast("long").alias("r")).distinct(), TPL).join(held, "page_id", "left_semi")
    blank = blank.select("page_id", "r").join(anchors.select("page_id", "r"), ["page_id", "r"], "left_anti")
    both = blank.select("page_id", "r", F.lit(None).cast("double").alias("lo_y"), F.lit(None).cast("double").alias("hi_y")).unionByName(anchors)
    # Of several lines on one row the last counts as the neighbour above, the first as the one below.
    here = F.when(F.col("lo_y").isNotNull(), F.struct("r", "lo_y", "hi_y"))
    # Both neighbours by frames that only grow; the one below by the opposite order.
    until = lambda *by: Window.partitionBy("page_id").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.last(here, ignorenulls=True).over(until("r")), F.last(here, ignorenulls=True).over(until(F.desc("r")))
    seen = both.select("page_id", "r", F.col("lo_y").isNull().alias("is_blank"), low.alias("low"), high.alias("high")).filter("is_blank")
    inner = F.col("low.hi_y") + (F.col("high.lo_y") - F.col("low.hi_y")) * (F.col("r") - F.col("low.r")) / (F.col("high.r") - F.col("low.r"))
    expected = F.when(F.col("low").isNull(), F.col("high.lo_y")).when(F.col("high").isNull(), F.col("low.hi_y")).otherwise(inner)
    rows = seen.join(reach, "page_id").select("page_id", F.lit(True).alias("is_row"), F.col("r").alias("no"), expected.alias("y"), "reach")
    spare = lines.join(aligned.select("page_id", "line_no"), ["page_id", "line_no"], "left_anti").join(held, "page_id", "left_semi")
    free = spare.join(reach, "page_id").select("page_id", F.lit(False).alias("is_row"), F.col("line_no").cast("long").alias("no"), y.alias("y"), "reach")
    # A gap of more than the reach between neighbours in y (rows or lines) parts the page into runs.
    order = Window.partitionBy("page_id").orderBy("y", "is_row", "no")
    cut = F.coalesce(y - F.lag("y").over(order) > F.col("reach"), F.lit(True))
    parted = rows.unionByName(free).withColumn("_start", F.when(cut, F.row_number().over(order)))
    # Short runs that stand side by side are walked together.
    start = F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = parted.withColumn("run", F.floor(start / RUN_ROWS).cast("int")).drop("_start")
    key = pages.schema["page_id"].dataType.simpleString()
    return runs.groupBy("page_id", "run").applyInArrow(_nearest_free, f"page_id {key}, r int, line_no int")


def template_hits(items: DataFrame, tpl: DataFrame) -> DataFrame:
    """(page_id, code): template codes that some text of the page resembles.

    The fuzzy test runs once per (text, code) for each way in which they agree on all but the places they may differ in.
    Texts and codes are written and counted first, as the number of tasks goes by them.
    """
    texts = materialized(items.select("page_id", key_code(F.col("text")).alias("key")).filter("key <> ''").distinct())
    codes = materialized(tpl.filter(F.regexp_like("code", F.lit(r"\d"))).select(F.col("code"), key_code(F.col("code")).alias("ckey")).distinct())
    keys = texts.select("key").distinct()
    parts = parts_for(items.sparkSession, keys.count() + codes.count())
    dealt = lambda df, *by: df.repartition(parts, *by) if parts else df
    near = near_pairs(keys, codes, [], "key", "ckey", 30, None, parts=parts)
    like = dealt(near.filter(coded_match(F.col("key"), F.col("ckey"))).select("key", "code"), "key").distinct()
    return dealt(texts.join(like, "key").select("page_id", "code"), "page_id", "code").distinct()


def template_scores(items: DataFrame, tpl: DataFrame) -> DataFrame:
    """(page_id, doc, page, score): share of a template page's codes seen on the page; pages without a hit are absent."""
    rows = tpl.filter(F.regexp_like("code", F.lit(r"\d")))
    size = rows.groupBy(*TPL).agg(F.count(F.lit(1)).alias("_size"))
    weights = rows.groupBy(*TPL, "code").agg(F.count(F.lit(1)).alias("_n"))
    hits = template_hits(items, tpl).join(weights, "code").groupBy("page_id", *TPL).agg(F.sum("_n").alias("_hit"))
    return hits.join(size, TPL).select("page_id", *TPL, (F.col("_hit") / F.col("_size")).alias("score"))


def best_template(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best template page per page; the first of equals wins, below the threshold there is none."""
    return first_row(scores, ["page_id"], F.desc("score"), F.col("doc"), F.col("page")).filter(F.col("score") >= threshold)


def structure_score(anchors: DataFrame) -> DataFrame:
    """Share of matched structure texts on visible rows (page_id, r, tpl_text, text, visible).

    Fewer than 4 or 30% visible texts score 0; a page is accepted from 0.55.
    """
    hit = text_match(F.col("tpl_text"), F.col("text"))
    page = anchors.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("vis"), F.count_if(F.col("visible") & hit).alias("hit")
    )
    score = F.when((F.col("vis") < 4) | (F.col("vis") < F.col("n") * 0.3), 0.0).otherwise(F.col("hit") / F.col("vis"))
    return page.select("page_id", score.alias("score"), (score >= 0.55).alias("accepted"))


def key_score(pages: DataFrame, tpl: DataFrame, lines: DataFrame, aligned: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Two-sided share of template rows and lines that found each other, at least the structure score."""
    rows = tpl.filter(coded(F.col("code"))).groupBy(*TPL).agg(F.count(F.lit(1)).alias("_rows"))
    codes = lines.groupBy("page_id").agg(F.count_if(F.col("code") != "").alias("_codes"))
    coded_rows = pages.join(tpl.filter(coded(F.col("code"))), TPL).select("page_id", "r")
    used = aligned.join(coded_rows, ["page_id", "r"], "left_semi").groupBy("page_id").agg(F.count_distinct("line_no").alias("_used"))
    joined = pages.join(rows, TPL, "left").join(codes, "page_id").join(used, "page_id", "left")
    n = F.coalesce("_used", F.lit(0))
    share_b = n / F.greatest(F.lit(1), F.coalesce("_rows", F.lit(0)))
    share_a = F.least(F.lit(1.0), n / F.col("_codes"))
    score = F.when(F.col("_codes") > 0, (share_a + share_b) / 2).otherwise(0.0)
    if base is not None:
        joined = joined.join(base.select("page_id", F.col("score").alias("_base")), "page_id", "left")
        score = F.greatest(score, F.coalesce("_base", F.lit(0.0)))
    return joined.select("page_id", score.alias("score"))


def align_report(pages: DataFrame, tpl: DataFrame, lines: DataFrame, aligned: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """Matched, unmatched and extra counts per page. Rows that claimed a line by its place count as
    matched; unmatched and extra tell what the codes and names left over."""
    count = lambda df, name: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    out = pages.select("page_id")
    matched = aligned if claimed is None else aligned.select("page_id", "r").unionByName(claimed.select("page_id", "r"))
    for df, name in ((matched, "matched"), (unmatched_rows(pages, tpl, aligned), "unmatched"), (extra_lines(lines, aligned), "extra")):
        out = out.join(count(df, name), "page_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def clean_value(c: Column) -> Column:
    """Amount text for a numeric cell; punctuation alone is blank."""
    return F.when(has_meaning(c), numeric_text(c)).otherwise("")


def fill_position(tpl_cells: DataFrame, values: DataFrame) -> DataFrame:
    """Template cells (page_id, r, c, text, kind); numeric ones take the value at their own place."""
    joined = tpl_cells.join(values.select("page_id", "r", "c", F.col("text").alias("_v")), ["page_id", "r", "c"], "left")
    return joined.select("page_id", "r", "c", F.when(F.col("kind") == "num", clean_value(F.col("_v"))).otherwise(F.col("text")).alias("text"))


def fill_vlookup(tpl_cells: DataFrame, aligned: DataFrame, values: DataFrame) -> DataFrame:
    """Numeric template cells take the value of their aligned line (page_id, line_no, c, text); rows
    without a line are blank, other cells keep the template text."""
    mapped = tpl_cells.join(aligned.select("page_id", "r", "line_no"), ["page_id", "r"], "left")
    joined = mapped.join(values.select("page_id", "line_no", "c", F.col("text").alias("_v")), ["page_id", "line_no", "c"], "left")
    return joined.select("page_id", "r", "c", F.when(F.col("kind") == "num", clean_value(F.col("_v"))).otherwise(F.col("text")).alias("text"))


def code_warnings(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Rows whose read code does not resemble the template code."""
    both = expected.join(got.select("page_id", "r", F.col("code").alias("got")), ["page_id", "r"])
    want = strip(F.col("code"))
    bad = both.filter((want != "") & (F.col("got") != "") & ~codes_match(F.col("got"), want))
    text = F.concat(F.lit("第"), F.col("r") + 1, F.lit("行代码：模板["), want, F.lit("] 疑似["), F.col("got"), F.lit("]"))
    return bad.select("page_id", "r", text.alias("warning"))


def heal_keys(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, key, page): stored keys; keys of no page move to the pages without geometry, in order,
    when their numbers agree. `stored` (book, key, seq), `pages` (book, page, seq)."""
    orphans = stored.join(pages.select("book", F.col("page").alias("key")), ["book", "key"], "left_anti")
    missing = pages.join(stored.select("book", F.col("key").alias("page")), ["book", "page"], "left_anti")
    n_o = orphans.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    n_m = missing.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    even = n_o.join(n_m, ["book", "n"]).select("book")
    left = number_within(orphans.join(even, "book", "left_semi"), ["book"], "seq", "k").select("book", "key", "k")
    right = number_within(missing.join(even, "book", "left_semi"), ["book"], "seq", "k").select("book", "page", "k")
    healed = left.join(right, ["book", "k"]).select("book", "key", "page")
    known = stored.join(pages.select("book", F.col("page").alias("key")), ["book", "key"], "left_semi").select("book", "key", F.col("key").alias("page"))
    return known.unionByName(healed)


def apply_corrections(grid: DataFrame, fixes: DataFrame) -> DataFrame:
    """Grid with corrected texts (page_id, r, c, text); later fixes of a cell are merged by the caller."""
    joined = grid.join(fixes.select("page_id", "r", "c", F.col("text").alias("_fix")), ["page_id", "r", "c"], "left")
    return joined.withColumn("corrected", F.col("_fix").isNotNull()).withColumn("text", F.coalesce("_fix", "text")).drop("_fix")


def rejected_corrections(grid: DataFrame, fixes: DataFrame) -> DataFrame:
    """Corrections outside the grid."""
    return fixes.join(grid.select("page_id", "r", "c"), ["page_id", "r", "c"], "left_anti")


def data_rows(rows: DataFrame, numeric_cells: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows below the header that hold a numeric cell."""
    below = rows.join(headers, list(keys), "left").filter(F.col("r") >= F.coalesce("header_rows", F.lit(0)))
    return below.join(numeric_cells.select(*keys, "r").distinct(), [*keys, "r"], "left_semi").drop("header_rows")
