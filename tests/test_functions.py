"""Scalar functions against plain restatements and golden values."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import compare, fuzzy, geometry, number, period, text


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_num_lenient(spark):
    cases = [
        (None, 0.0), ("", 0.0), ("  ", 0.0), ("12", 12.0), (" 1,234.5 ", 1234.5), ("1，000", 1000.0), ("-7", -7.0), ("+.5", 0.5), ("1e3", 1000.0),
        ("12abc", 12.0), ("abc", 0.0), ("--", 0.0), ("1.0d", 1.0), ("1f", 1.0), ("1 2", 12.0), ("　3　", 3.0), ("４２", 42.0), ("1_000", 1000.0), ("5.", 5.0),
    ]
    got = values(spark, [(c[0],) for c in cases], "v string", n=number.num_lenient(F.col("v")))
    assert [g[0] for g in got] == [c[1] for c in cases]
    assert math.isnan(values(spark, [("nan",)], "v string", n=number.num_lenient(F.col("v")))[0][0])


def test_code_text(spark):
    cases = [("11600", "11600"), ("11600.0", "11600"), (" 11600 ", "11600"), (None, ""), ("1123P", "1123P"), ("-5.00", "-5"), ("1.50", "1.50")]
    got = values(spark, [(c[0],) for c in cases], "v string", n=number.code_text(F.col("v")))
    assert [g[0] for g in got] == [c[1] for c in cases]
    doubles = values(spark, [(11600.0,), (12345678.0,), (1.5,)], "v double", n=number.double_text(F.col("v")))
    assert [g[0] for g in doubles] == ["11600", "12345678", "1.5"]


def test_typed_text(spark):
    rows = [("null", None, None), ("bool", "true", None), ("number", "11344.0", 11344.0), ("string", " 11347.0 ", None)]
    got = values(
        spark, rows, "t string, v string, n double", code=number.typed_code_text(F.col("t"), F.col("v"), F.col("n")),
        key=number.typed_text_key(F.col("t"), F.col("v"), F.col("n"), F.lit(None).cast("timestamp")),
    )
    assert got == [("", ""), ("True", "true"), ("11344", "11344"), ("11347", " 11347.0 ")]


def test_numeric_tests(spark):
    rows = [("1.0d",), ("1,234",), ("12%",), ("",), ("-3.5",), ("1_0",), ("x",)]
    got = values(spark, rows, "v string", a=number.looks_numeric(F.col("v")), b=number.is_amount_text(F.col("v")))
    assert got == [(False, False), (True, True), (False, True), (False, False), (True, True), (True, False), (False, False)]


def test_coerce_number(spark):
    rows = [("12.5%",), ("1,234",), ("12,34",), ("1,234.50",), ("-7",), ("",), ("x1",)]
    got = values(spark, rows, "v string", k=number.coerce_number(F.col("v")))
    assert [(g[0]["kind"], g[0]["num"], g[0]["text"]) for g in got] == [
        ("percent", 0.125, None), ("int", 1234.0, None), ("text", None, "12,34"), ("decimal", 1234.5, None), ("int", -7.0, None), ("text", None, ""), ("text", None, "x1"),
    ]


def test_periods(spark):
    rows = [("2026-09",), ("202609",), ("2026/9",), ("2026.09.30",)]
    assert [g[0] for g in values(spark, rows, "v string", p=period.normalize_period(F.col("v")))] == ["2026.09", "2026.09", "2026/9", "2026.09"]
    heads = values(spark, [(2026.1,), (2026.11,), (202609.0,)], "v double", p=period.header_period(F.lit(None).cast("string"), F.col("v")))
    assert [h[0] for h in heads] == ["2026.1", "2026.11", "2026.09"]


def test_file_names(spark):
    rules = [("惠州市", "惠州市"), ("惠东县", "惠东"), ("惠", "惠")]
    rows = [("2026.09 惠州市.xls",), ("2026-09 惠东 报表.v2.xls",), ("无空格.xls",), (" 惠东.xls",)]
    got = values(spark, rows, "v string", p=period.file_period(F.col("v")), r=period.file_region(F.col("v"), rules))
    assert got == [("2026.09", "惠州市"), ("2026.09", "惠东县"), ("无空格", "未知区域"), ("", "未知区域")]


def test_ledger_period_and_data_date(spark):
    rows = [("2026年9月末",), ("余额表",), (None,)]
    assert [g[0] for g in values(spark, rows, "v string", p=period.ledger_period(F.col("v")))] == ["2026-09", "ERR", "ERR"]
    stems = [("识别结果_20260930",), ("a_2026-13-01",), ("none",)]
    got = values(spark, stems, "v string", d=period.data_date(F.col("v"), F.lit("2020-01-01")))
    assert [str(g[0]) for g in got] == ["2026-09-30", "2020-01-01", "2020-01-01"]


def plain_normalize(t: str) -> str:
    """Independent statement of the punctuation rule."""
    half = {ord(f): chr(ord(f) - 0xFEE0) for f in "０１２３４５６７８９" + "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))}
    chars = list(t.translate(half))
    full = dict(zip(",:;!?()", "，：；！？（）"))
    context = lambda ch: bool(ch) and ("一" <= ch <= "鿿" or ch in "，。；：！？（）")

    def neighbour(i, step):
        i += step
        while 0 <= i < len(chars) and chars[i] in " 　":
            i += step
        return chars[i] if 0 <= i < len(chars) else ""

    out = "".join(full[c] if c in full and (context(neighbour(i, -1)) or context(neighbour(i, 1))) else c for i, c in enumerate(chars))
    out = re.sub(r"\s+([，。；：！？）】》])", r"\1", out)
    out = re.sub(r"\s+([（【《])", r"\1", out)
    return re.sub(r"([（【《])\s+", r"\1", out)


def test_normalize_text(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("中文a1, :;!?()　，。（】《Ａ９ ") for _ in range(rnd.randint(0, 14))),) for _ in range(1500)]
    got = values(spark, rows, "v string", n=text.normalize_text(F.col("v")))
    assert [g[0] for g in got] == [plain_normalize(r[0]) for r in rows]


def test_title_and_names(spark):
    rows = [("国库月计表",), ("合计 123",), ("上期余额(借方)",), ("A/B:C",), ("",)]
    got = values(spark, rows, "v string", t=text.title_like(F.col("v")), s=text.safe_sheet_name(F.col("v")))
    assert got == [(True, "国库月计表"), (False, "合计 123"), (False, "上期余额(借方)"), (True, "A_B_C"), (False, "Sheet")]


def test_letters_and_ranges(spark):
    rows = [(i,) for i in (1, 26, 27, 52, 702, 703, 16384)]
    got = values(spark, rows, "v int", a=geometry.column_letter(F.col("v")), b=geometry.column_index(geometry.column_letter(F.col("v"))))
    assert got == [("A", 1), ("Z", 26), ("AA", 27), ("AZ", 52), ("ZZ", 702), ("AAA", 703), ("XFD", 16384)]
    refs = [("'表 1'!$B$2:$C$5",), ("D4",), ("bad!",), ("1A",)]
    got = values(spark, refs, "v string", p=geometry.parse_reference(F.col("v"), F.lit("S")))
    assert [tuple(g[0]) for g in got[:2]] == [("表 1", 1, 1, 4, 2), ("S", 3, 3, 3, 3)]
    assert got[2][0]["r0"] is None and got[3][0]["r0"] is None


def test_fuzzy(spark):
    rows = [("11012", "11013"), ("170", "170中央预算支出"), ("302", "30201"), ("ab", "xy"), ("", ""), ("12", "123456")]
    got = values(spark, rows, "a string, b string", c=fuzzy.codes_match(F.col("a"), F.col("b")), k=fuzzy.key_match(F.col("a"), F.col("b")))
    assert got == [(True, True), (False, True), (False, True), (False, False), (True, False), (False, False)]
    names = [("中央预算支出", "中央预算支山"), ("1,000", "1000"), ("1,000", "1001"), ("a b", "ab"), ("abc", "abd")]
    assert [g[0] for g in values(spark, names, "a string, b string", t=fuzzy.text_match(F.col("a"), F.col("b")))] == [True, True, False, True, False]


def test_compare(spark):
    rows = [(1.0, 1.004), (1.0, 1.006), (2.0, 1.0)]
    got = values(spark, rows, "a double, b double", ne=compare.approx("<>", F.col("a"), F.col("b")), lt=compare.approx("<", F.col("a"), F.col("b")), gt=compare.approx(">", F.col("a"), F.col("b")))
    assert got == [(False, False, False), (True, True, False), (True, False, True)]
    assert values(spark, [(0.1 + 0.2,)], "v double", s=number.sig15(F.col("v"))) == [(0.3,)]


def test_geometry(spark):
    got = values(spark, [([0.0, 0.25, 0.5, 1.0], 0.0, 10.0)], "f array<double>, a double, b double", e=geometry.lay_edges(F.col("f"), F.col("a"), F.col("b")))
    assert got[0][0] == [0, 2, 5, 10]  # 2.5 goes to the even side
    assert values(spark, [([10, 20, 40],)], "e array<int>", f=geometry.edge_fracs(F.col("e")))[0][0] == [0.0, 0.33333, 1.0]


def test_numbers_are_strict_and_exact(spark):
    rows = [("1 2",), (" 1,200.5 ",), ("-3e2",), ("123456789012345678901",), ("abc",), ("",), (None,)]
    got = values(spark, rows, "v string", p=number.plain_number(F.col("v")), w=number.coerce_number(F.col("v"))["whole"])
    assert [g[0] for g in got] == [None, 1200.5, -300.0, 123456789012345678901.0, None, None, None]
    assert str(got[3][1]) == "123456789012345678901"


def test_letters_end_at_three(spark):
    import pytest

    assert values(spark, [(18278,)], "v int", a=geometry.column_letter(F.col("v"))) == [("ZZZ",)]
    with pytest.raises(Exception, match="no column letters"):
        values(spark, [(18279,)], "v int", a=geometry.column_letter(F.col("v")))


def test_agreement_of_ascii_and_other_texts(spark):
    import random

    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice(rnd.choice(["ab", "0~", "a中é", "\x01 \x7f", "\U0001f600a"])) for _ in range(rnd.choice([1, 6, 7, 8, 14, 15, 20, 28, 35, 36])))
    rows = [(text(), text()) for _ in range(400)] + [("", "ab"), ("ab", ""), (None, "a")]
    got = [g[0] for g in values(spark, rows, "a string, b string", s=fuzzy.agreement(F.col("a"), F.col("b")))]
    want = [None if a is None else sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) for a, b in rows]
    assert got == want
