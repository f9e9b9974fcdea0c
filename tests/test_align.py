"""Alignment against a brute-force walk in template order."""

from __future__ import annotations

import random

from ledgerloom.operators import align


def agreement(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


def keep(t, test):
    return "".join(ch for ch in t if test(ch))


def key_match(a, b):
    a, b = keep(a, str.isalnum), keep(b, str.isalnum)
    if not a or not b:
        return False
    if a == b:
        return True
    da, db = keep(a, str.isdigit), keep(b, str.isdigit)
    for s, t in ((da, db), (db, da)):
        if len(s) >= 3 and s in t and len(t) - len(s) <= len(t) * 0.6:
            return True
    return abs(len(a) - len(b)) <= 1 and agreement(a, b) >= 0.75


def text_match(a, b):
    a, b = a.replace(" ", ""), b.replace(" ", "")
    if not a or not b:
        return False
    if a == b:
        return True
    if a.isdigit() and b.isdigit():
        return False
    return len(a) >= 4 and len(b) >= 4 and agreement(a, b) >= 0.8


def row_match(tc, tn, c, n):
    both = c + n
    if tc and key_match(tc, both) and (tc in both or len(tc) >= 3):
        return True
    if len(tn) >= 3 and (tn in both or both in tn):
        return True
    return key_match(tc, c) or (tn != "" and text_match(tn, n))


def brute(tpl, lines):
    used, found = set(), {}

    def walk(rows, test):
        for r, code, name in rows:
            if r in found:
                continue
            for no, c, n, t in lines:
                if no not in used and test(code, name, c, n, t):
                    found[r] = no
                    used.add(no)
                    break

    coded = [x for x in tpl if x[1]]
    walk(coded, lambda code, name, c, n, t: c == code)
    walk(coded, lambda code, name, c, n, t: row_match(code, name, c, n) or (code in t and not c))
    walk([x for x in tpl if x[2]], lambda code, name, c, n, t: n != "" and text_match(name, n))
    return found


def test_align_fuzzy(spark):
    rnd = random.Random(11)
    names = ["中央预算支出", "中央预算收入", "地方预算支出", "其他", "合计", ""]
    tpl = {p: [(r, rnd.choice(["", str(rnd.randint(100, 130)), str(rnd.randint(10010, 10030))]), rnd.choice(names)) for r in range(25)] for p in ("A", "B")}
    pages = [(i, "D", "A" if i % 2 else "B") for i in range(12)]
    lines = []
    for page, _d, _p in pages:
        for no in range(18):
            code = rnd.choice(["", str(rnd.randint(100, 130)), str(rnd.randint(10010, 10030)), "1" + str(rnd.randint(10010, 10030))])
            name = rnd.choice([*names, "中央预算支山", "120中央预算支出"])
            lines.append((page, no, float(no), code, name, code + name + rnd.choice(["", "115"])))
    t = spark.createDataFrame([("D", p, r, c, n) for p, rows in tpl.items() for r, c, n in rows], "doc string, page string, r int, code string, name string")
    got = align.align_fuzzy(
        spark.createDataFrame(pages, "page_id bigint, doc string, page string"), t,
        spark.createDataFrame(lines, "page_id bigint, line_no int, y double, code string, name string, text string"),
    ).collect()
    for page, _d, p in pages:
        want = brute(tpl[p], [x[1:2] + x[3:] for x in lines if x[0] == page])
        assert {r.r: r.line_no for r in got if r.page_id == page} == want


def test_segments_cover_every_match(spark):
    """Blocking finds exactly the codes a full comparison finds."""
    from pyspark.sql import functions as F

    from ledgerloom.functions.fuzzy import codes_match

    rnd = random.Random(5)
    texts = sorted({"".join(rnd.choice("0123ab") for _ in range(rnd.randint(1, 9))) for _ in range(400)})
    codes = sorted({"".join(rnd.choice("0123") for _ in range(rnd.randint(1, 9))) for _ in range(80)})
    items = spark.createDataFrame([(1, x) for x in texts], "page_id bigint, text string")
    tpl = spark.createDataFrame([("D", "P", i, c, "") for i, c in enumerate(codes)], "doc string, page string, r int, code string, name string")
    pairs = spark.createDataFrame([(x, c) for x in texts for c in codes], "x string, c string")
    want = {r.c for r in pairs.filter(codes_match(F.col("x"), F.col("c"))).select("c").distinct().collect()}
    assert {r.code for r in align.template_hits(items, tpl).collect()} == want


def test_keys_of_one_chart_of_accounts_are_not_hot(spark):
    """All codes begin alike: no key holds many pairs, and candidates stay near the matches."""
    from pyspark.sql import functions as F

    from ledgerloom.functions.fuzzy import codes_match
    from ledgerloom.operators.fuzzy_index import near_keys, near_pairs

    codes = spark.range(6000).select(F.concat(F.lit("1100"), F.lpad((F.col("id") * 7919 % 100000).cast("string"), 5, "0")).alias("code"))
    keys = near_keys(codes, "code", 30, F.length("code") + 1).groupBy("len", "way", "piece").count()
    total, largest = keys.agg(F.sum("count"), F.max("count")).first()
    assert largest < 0.01 * total
    pairs = near_pairs(codes, codes.withColumnRenamed("code", "other"), [], "code", "other", 30, None).distinct()
    assert pairs.count() < 0.2 * 6000 * 6000
    some = codes.limit(40)
    want = some.crossJoin(codes.withColumnRenamed("code", "other")).filter(codes_match(F.col("code"), F.col("other"))).count()
    assert pairs.join(some, "code").filter(codes_match(F.col("code"), F.col("other"))).count() == want > 40


def test_kept_positions_leave_every_choice_of_differing_places():
    from itertools import combinations

    from ledgerloom.operators.fuzzy_index import kept_positions

    for length in range(1, 15):
        for differing in range(0, length * 30 // 100 + 1):
            ways = kept_positions(length, differing, 36)
            for wrong in combinations(range(1, length + 1), differing):
                assert any(all(not (at <= w < at + n) for at, n in way for w in wrong) for way in ways), (length, differing, wrong)


def test_contained_and_digit_pairs(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators.fuzzy_index import contained_pairs, digit_pairs

    rnd = random.Random(3)
    shorts = ["".join(rnd.choice("0123") for _ in range(rnd.randint(1, 20))) for _ in range(120)] + ["9", "7" * 30, "12" * 15]
    longs = ["".join(rnd.choice("0123") for _ in range(rnd.randint(1, 40))) for _ in range(200)] + ["9", "17" + "7" * 31, "12" * 16, ""]
    a = spark.createDataFrame([(1, x) for x in dict.fromkeys(shorts)], "p int, a string")
    b = spark.createDataFrame([(1, x) for x in dict.fromkeys(longs)], "p int, b string")
    want = {(x, y) for x in shorts for y in longs if x in y}
    assert {(r.a, r.b) for r in contained_pairs(a, b, ["p"], "a", "b").collect()} == want
    inside = {(x, y) for x, y in want if len(x) >= 3 and len(y) - len(x) <= len(y) * 0.6}
    assert {(r.a, r.b) for r in digit_pairs(a, b, ["p"], "a", "b").select("a", "b").collect()} == inside
    assert contained_pairs(a.limit(0), b, ["p"], "a", "b").isEmpty() and contained_pairs(a, b.withColumn("p", F.lit(2)), ["p"], "a", "b").isEmpty()


def nearest_by_hand(rows, lines, reach):
    free, found = list(lines), {}
    for r, y in sorted(rows):
        near = [(abs(ly - y), no) for no, ly in free if abs(ly - y) <= reach]
        if near:
            found[r] = min(near)[1]
            free = [x for x in free if x[0] != found[r]]
    return found


def test_claims_of_a_long_page(spark):
    """100,000 lines on one page, and a crowded page against a plain search."""
    from pyspark.sql import functions as F

    n = 50_000
    lines = spark.range(2 * n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("line_no"), (F.col("id") * 10.0).alias("y"))
    rows = spark.range(2 * n).select(F.lit("D").alias("doc"), F.lit("P").alias("page"), F.col("id").cast("int").alias("r"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("").alias("code"), F.lit("").alias("name"))
    pages = spark.createDataFrame([(1, "D", "P"), (2, "D", "Q")], "page_id long, doc string, page string")
    aligned = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), (F.col("id") * 2).cast("int").alias("r"), (F.col("id") * 2).cast("int").alias("line_no"))
    rnd = random.Random(8)
    places = [(i, float(rnd.randrange(0, 400))) for i in range(150)]
    crowd = spark.createDataFrame([(2, i, y) for i, y in sorted(places, key=lambda x: x[1])], lines.schema)
    few = spark.createDataFrame([("D", "Q", r, str(r) if r in (0, 70) else "", "") for r in range(71)], rows.schema)
    held = {0: 3, 70: 90}
    both = spark.createDataFrame([(2, r, li) for r, li in held.items()], aligned.schema).unionByName(aligned)
    got = align.claim_nearest(pages, rows.unionByName(few), lines.unionByName(crowd), both)
    assert got.filter("page_id = 1 and r = line_no").count() == n == got.filter("page_id = 1").count()
    at = dict(places)
    steps = [at[i + 1] - at[i] for i in range(149)]
    reach = 1.3 * sorted(steps)[len(steps) // 2]
    wanted = [(r, at[3] + (at[90] - at[3]) * r / 70) for r in range(1, 70)]
    plain = nearest_by_hand(wanted, [(i, y) for i, y in places if i not in held.values()], abs(reach) if reach > 0 else reach)
    assert {r.r: r.line_no for r in got.filter("page_id = 2").collect()} == plain


def test_exploded_keys_are_not_sent_through_the_driver(spark):
    """The planner takes the keys made by an explode for as few as the rows before; joins of them must shuffle."""
    from ledgerloom.operators.fuzzy_index import contained_pairs, digit_pairs, near_pairs

    left = spark.range(9).selectExpr("'A' as page", "cast(11000101 + id as string) as a")
    right = spark.range(9).selectExpr("'A' as page", "cast(11000107 + id as string) as b")
    joins = {
        2: near_pairs(left, right, ["page"], "a", "b", 25, None),
        1: digit_pairs(left, right, ["page"], "a", "b"),
        3: contained_pairs(left, right, ["page"], "a", "b"),
    }
    for many, pairs in joins.items():
        assert pairs._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == many


def test_candidates_are_the_pairs_that_match(spark):
    """Each lookup tests its own way to match; together they give what the whole test gives on all pairs."""
    from pyspark.sql import functions as F

    from ledgerloom.functions.fuzzy import row_key_match, text_match
    from ledgerloom.functions.text import key_code
    from ledgerloom.operators.fuzzy_index import bits_by_place

    rnd = random.Random(21)
    code = lambda: rnd.choice(["", "1", "1-2", "12", "7.", "1 2", "123", "11000104", "1100x107", str(11000000 + rnd.randrange(40) * 7), str(rnd.randrange(90, 140))])
    name = lambda: rnd.choice(["", "2", "-2", "ab", "1,234", "1234", "1,2,34", "１２", "a b,c", "ab,c", "red bolt-" + "abcde"[: rnd.randrange(2, 6)], "red bolt-bcdef", "合计red ##lt-bcdeg", "预算支出合计", "预算支山合计", "9" * 40, "9" * 39 + "8"])
    seen = sorted({("D", p, code(), name()) for _ in range(150) for p in "AB"} - {("D", p, "", "") for p in "AB"})
    wanted = sorted({("D", p, code(), name()) for _ in range(150) for p in "AB"})
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(seen)], "_s long, doc string, page string, code string, name string")
    w = spark.createDataFrame([(i, *x) for i, x in enumerate(wanted)], "_t long, doc string, page string, t_code string, t_name string")
    cols = [F.col(c) for c in ("t_code", "t_name", "code", "name")]
    by_name = F.when((cols[1] != "") & (cols[3] != ""), text_match(cols[1], cols[3])).otherwise(False)
    by_key = (key_code(cols[0]) != "") & (row_key_match(*cols) | by_name)
    want = {tuple(r) for r in s.join(w, ["doc", "page"]).select("_s", "_t", by_key, by_name).collect() if r[2] or r[3]}
    assert {tuple(r) for r in align.matching_keys(s, w, None, bits_by_place(w, "t_name")).collect()} == want
    assert len({r[2:] for r in want}) == 3 and len(want) > 1000
    told = {(*seen[i][1:], *wanted[j][2:]) for i, j, *_ in want}
    got = align.candidate_keys(s.drop("_s"), w.drop("_t")).filter("by_key or by_name").distinct()
    assert {tuple(r[:4]) for r in got.collect()} == {x[1:] for x in told}


def test_names_that_begin_alike_meet_by_where_they_differ(spark):
    """Key meetings stay near the matches, however much of the names is common to all."""
    from itertools import combinations

    from pyspark.sql import functions as F

    from ledgerloom.functions.fuzzy import agreement as agreement_of
    from ledgerloom.operators.fuzzy_index import bits_by_place, kept_positions, near_keys, near_pairs

    names = spark.range(4000).select(F.concat(F.lit("largewidget-"), F.lpad((F.col("id") * 7919 % 1000000).cast("string"), 6, "0")).alias("name"))
    bits = bits_by_place(names, "name")
    assert max(bits[18][1:12]) < 0.01 and min(bits[18][12:]) > 2 and bits[19] == [*bits[18], 0.0]
    held = near_keys(names, "name", 20, F.length("name"), 36, bits).groupBy("len", "way", "piece").count()
    meetings = held.select(F.sum(F.col("count") * F.col("count"))).first()[0]
    pairs = near_pairs(names, names.withColumnRenamed("name", "other"), [], "name", "other", 20, 20, bits=bits)
    assert meetings < 10 * pairs.distinct().count()
    some, others = names.limit(60), names.withColumnRenamed("name", "other")
    alike = lambda df: {tuple(r) for r in df.filter(agreement_of(F.col("name"), F.col("other")) >= 0.8).collect()}
    assert alike(near_pairs(some, others, [], "name", "other", 20, 20, bits=bits)) == alike(some.crossJoin(others))
    for told in ([0.0] * 15, [3.0] * 15, [9.0] + [0.0] * 14, [0.0] * 14 + [9.0]):
        ways = kept_positions(15, 3, 36, told)
        for wrong in combinations(range(1, 16), 3):
            assert any(all(not (at <= w < at + n) for at, n in way for w in wrong) for way in ways), (told, wrong)


def test_long_texts_are_looked_up_by_six_characters(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators.fuzzy_index import contained_pairs

    names = spark.range(300).select(F.lit(1).alias("p"), F.concat(F.lit("name-"), (F.col("id") + 100).cast("string")).alias("a"))
    plan = contained_pairs(names, names.select("p", F.col("a").alias("b")), ["p"], "a", "b")
    assert "[1,2,3]" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.filter("a = b").count() == plan.count() == 300


def test_walk_takes_first_free_lines():
    import pyarrow as pa

    from ledgerloom.operators.align import _walked

    def walk(*entries):
        page = pa.table({"page_id": pa.array([5] * len(entries), pa.int64()), **{c: pa.array([e[i] for e in entries], t) for i, (c, t) in enumerate((("part", pa.int32()), ("r", pa.int64()), ("li", pa.int64())))}})
        return {(x["r"], x["line_no"], x["stage"]) for x in _walked(page).to_pylist()}

    # Row 1 takes line 3, row 2 its next one, row 4 the blank; a repeated pair changes nothing; names come last.
    entries = [(0, 2, 0), (0, 1, 1), (0, 4, 1), (2, 1, 3), (2, 1, 3), (2, 2, 9), (2, 2, 3), (2, 2, 8), (1, -1, 6), (3, 7, 8), (3, 7, 9), (3, 8, 9), (3, 1, 9), (3, 3, 6)]
    assert walk(*entries) == {(1, 3, "key"), (2, 8, "key"), (4, 6, "key"), (7, 9, "name")}
    assert walk((0, 1, 1), (0, 2, None), (1, -1, 4)) == {(1, 4, "key")}
    assert walk((0, 1, 0), (2, 1, None)) == {(1, None, "key")}
    assert walk((0, 1, 0), (3, 2, 4)) == {(2, 4, "name")} and walk((0, 1, 0)) == set()
    many = walk(*[(0, r, 0) for r in range(700)], *[(2, r, li) for r in range(700) for li in range(700)])
    assert many == {(r, r, "key") for r in range(700)}


def test_texts_of_rows_and_lines_are_not_sent_through_the_driver(spark):
    """Only cutting patterns and lengths are broadcast: for the four kinds of keys of both near lookups, patterns once, lengths for short and long texts."""
    tpl = spark.range(40).selectExpr("'D' as doc", "'P' as page", "cast(id as int) as r", "cast(1100 + id * 3 as string) as code", "concat('name of ', id) as name")
    lines = tpl.selectExpr("cast(1 as long) as page_id", "r as line_no", "0D as y", "code", "name", "'' as text", "doc", "page")
    pages = spark.createDataFrame([(1, "D", "P")], "page_id long, doc string, page string")
    physical = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert physical(align._candidates(tpl, lines)).count("BroadcastHashJoin") == 8 * 3
    # The two frames of shifts; pages are few.
    assert physical(align.align_exact(pages, tpl, lines.drop("doc", "page"))).count("SortMergeJoin") == 2
