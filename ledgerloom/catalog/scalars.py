"""Scalar functions over columns of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query
from ledgerloom.fixtures import REGIONS, Tables
from ledgerloom.functions import compare, fuzzy, geometry, number, period, text

_ID = ("l_orderkey", "l_linenumber")

_NUM = r"""coalesce(try_cast(nullif(regexp_extract(regexp_replace({0}, '[\s,，]', '', 'g'), '^[-+]?(\d+\.?\d*|\.\d+)$', 0), '') as double),
 try_cast(nullif(regexp_extract(regexp_replace({0}, '[\s,，]', '', 'g'), '^[-+]?\d*\.?\d+', 0), '') as double), 0.0)"""


@query("num_lenient", f"select l_orderkey, l_linenumber, {_NUM.format('value_raw')} as num from src", ("src",))
def num_lenient(t: Tables) -> DataFrame:
    return t.src.select(*_ID, number.num_lenient(F.col("value_raw")).alias("num"))


@query(
    "code_text",
    r"select l_orderkey, l_linenumber, regexp_replace(trim(code_raw), '^([-+]?\d+)\.0+$', '\1') as code from src",
    ("src",),
)
def code_text(t: Tables) -> DataFrame:
    return t.src.select(*_ID, number.code_text(F.col("code_raw")).alias("code"))


@query(
    "text_key",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date_key,
 case when o_totalprice = floor(o_totalprice) then cast(cast(o_totalprice as bigint) as varchar) else cast(o_totalprice as varchar) end as price_key,
 coalesce(o_orderstatus, '') as status_key from orders""",
)
def text_key(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        number.text_key(F.col("o_orderdate"), "timestamp").alias("date_key"),
        number.text_key(F.col("o_totalprice"), "double").alias("price_key"),
        number.text_key(F.col("o_orderstatus"), "string").alias("status_key"),
    )


@query(
    "norm_period",
    """select o_orderkey, strftime(o_orderdate, '%Y.%m') as from_dash, strftime(o_orderdate, '%Y.%m') as from_plain,
 strftime(o_orderdate, '%Y') as from_short from orders""",
)
def norm_period(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        period.normalize_period(F.date_format(day, "yyyy-MM-dd")).alias("from_dash"),
        period.normalize_period(F.date_format(day, "yyyyMM")).alias("from_plain"),
        period.normalize_period(F.date_format(day, "yyyy")).alias("from_short"),
    )


@query(
    "header_period",
    """select o_orderkey, case when month(o_orderdate) in (1, 10) and month(o_orderdate) = 10 then concat(cast(year(o_orderdate) as varchar), '.1')
 else strftime(o_orderdate, '%Y.%m') end as numeric_header, strftime(o_orderdate, '%Y.%m') as text_header from orders""",
)
def header_period(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    as_number = F.date_format(day, "yyyy.MM").cast("double")
    as_text = F.concat(F.lit(" "), F.date_format(day, "yyyy/MM"))
    return t.orders.select(
        "o_orderkey",
        period.header_period(F.lit(None).cast("string"), as_number).alias("numeric_header"),
        period.header_period(as_text).alias("text_header"),
    )


_FILE = """select o.o_orderkey, concat(strftime(o.o_orderdate, '%Y-%m'), ' ', r.r_name, ' ', o.o_orderpriority, '.xls') as name,
 strftime(o.o_orderdate, '%Y.%m') as period, case when contains(r.r_name, ' ') then '未知区域' else r.r_name end as region
 from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
 join region r on n.n_regionkey = r.r_regionkey"""


def _file_names(t: Tables) -> DataFrame:
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return (
        t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey", "o_orderpriority",
            F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM"), "r_name",
                        F.concat("o_orderpriority", F.lit(".xls"))).alias("name"),
        )
    )


_RULES = [(name, kw) for name, kw, _role, _none in REGIONS]


@query("file_meta", _FILE)
def file_meta(t: Tables) -> DataFrame:
    name = F.col("name")
    return _file_names(t).select(
        "o_orderkey", "name",
        period.file_period(name).alias("period"),
        period.file_region(name, _RULES).alias("region"),
    )


@query(
    "region_match",
    """select p_partkey, coalesce((select v.name from (values (0,'SMALL','SMALL'),(1,'small ring','small ring'),(2,'ring','ring'),(3,'red','red'),(4,'bolt','bolt'))
 v(ord, name, kw) where contains(p_name || ' ' || p_type, v.kw) order by length(v.kw) desc, v.ord limit 1), '未知区域') as region from part""",
)
def region_match(t: Tables) -> DataFrame:
    rules = [(k, k) for k in ("SMALL", "small ring", "ring", "red", "bolt")]
    return t.part.select(
        "p_partkey", period.match_region(F.concat_ws(" ", "p_name", "p_type"), rules).alias("region")
    )


@query(
    "col_letters",
    """select p_partkey, case when i > 702 then chr(cast(64 + (i - 703) // 676 + 1 as int)) else '' end
 || case when i > 26 then chr(cast(65 + ((i - 27) // 26) % 26 as int)) else '' end || chr(cast(65 + (i - 1) % 26 as int)) as letters,
 cast(i as int) as back from (select p_partkey, p_partkey % 16384 + 1 as i from part)""",
)
def col_letters(t: Tables) -> DataFrame:
    letters = geometry.column_letter(F.col("p_partkey") % 16384 + 1)
    return t.part.select(
        "p_partkey", letters.alias("letters"), geometry.column_index(F.lower(letters)).alias("back")
    )


@query(
    "parse_ranges",
    """select p_partkey, u.part_no, u.sheet, cast(u.r0 as int) as r0, cast(u.c0 as int) as c0, cast(u.r1 as int) as r1, cast(u.c1 as int) as c1
 from (select p_partkey, p_size as n, p_brand from part), lateral (values
 (0, 'Main', n - 1, 1, n + 4, 5), (1, 'other sheet', 1, n % 26, 1, n % 26), (2, 'Main', null, null, null, null)) u(part_no, sheet, r0, c0, r1, c1)""",
)
def parse_ranges(t: Tables) -> DataFrame:
    n = F.col("p_size")
    refs = F.concat(
        F.lit("$B$"), n, F.lit(":$F$"), n + 5,
        F.lit(", 'other sheet'!"), F.char(65 + n % 26), F.lit("2,bad"),
    )
    return (
        t.part.select("p_partkey", F.posexplode(F.split(refs, ",")).alias("part_no", "part"))
        .select("p_partkey", "part_no", geometry.parse_reference(F.col("part"), F.lit("Main")).alias("ref"))
        .select("p_partkey", "part_no", "ref.*")
    )


@query(
    "rect_cells",
    """select p_partkey, cast(p_size % 5 + a.k as int) as r, cast(b.k as int) as c from part, range(3) a(k), range(4) b(k)
 where a.k <= p_size % 3 and b.k <= p_size % 4""",
)
def rect_cells(t: Tables) -> DataFrame:
    n = F.col("p_size")
    rects = t.part.select("p_partkey", (n % 5).alias("r0"), (n % 5 + n % 3).alias("r1"), (n % 4).alias("c1"))
    return rects.select("p_partkey", F.explode(F.sequence("r0", "r1")).alias("r"), "c1").select(
        "p_partkey", "r", F.explode(F.sequence(F.lit(0), F.col("c1"))).alias("c")
    )


@query("numeric_text", r"select l_orderkey, l_linenumber, regexp_replace(coalesce(value_raw, ''), '[\s,，]', '', 'g') as amount from src", ("src",))
def numeric_text(t: Tables) -> DataFrame:
    return t.src.select(*_ID, number.numeric_text(F.col("value_raw")).alias("amount"))


@query(
    "is_numeric",
    r"""select l_orderkey, l_linenumber,
 regexp_full_match(regexp_replace(coalesce(value_raw, ''), '[\s,]', '', 'g'), '[-+]?(\d+\.?\d*|\.\d+)') as numeric_like,
 regexp_full_match(trim(coalesce(value_raw, '')), '[-+]?[\d,]+(\.\d+)?%?') as amount_like from src""",
    ("src",),
)
def is_numeric(t: Tables) -> DataFrame:
    raw = F.col("value_raw")
    return t.src.select(
        *_ID, number.looks_numeric(raw).alias("numeric_like"), number.is_amount_text(raw).alias("amount_like")
    )


@query(
    "coerce_number",
    r"""with raw as (select l_orderkey, l_linenumber, case when l_linenumber = 4 then concat(cast(cast(l_quantity as int) as varchar), '.5%')
 when l_linenumber = 2 then concat(cast(cast(l_quantity as int) as varchar), ',000.5') when l_linenumber = 3 then concat(cast(cast(l_quantity as int) as varchar), ',00')
 when l_linenumber = 7 then concat(cast(cast(l_quantity as int) as varchar), '0000000000000000001') else cast(cast(l_quantity as int) as varchar) end as t from lineitem)
 select l_orderkey, l_linenumber, case when l_linenumber not in (2, 3, 4) then cast(t as decimal(38,0)) end as whole, case when l_linenumber = 4 then 'percent' when l_linenumber = 2 then 'decimal' when l_linenumber = 3 then 'text' else 'int' end as kind,
 case when l_linenumber = 4 then round(cast(replace(t, '%', '') as double) / 100, 6) when l_linenumber = 3 then null
 else cast(replace(t, ',', '') as double) end as num, case when l_linenumber = 3 then t end as text from raw""",
)
def coerce_number(t: Tables) -> DataFrame:
    qty, line = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    raw = (
        F.when(line == 4, F.concat(qty, F.lit(".5%")))
        .when(line == 2, F.concat(qty, F.lit(",000.5")))
        .when(line == 3, F.concat(qty, F.lit(",00")))
        .when(line == 7, F.concat(qty, F.lit("0000000000000000001")))
        .otherwise(qty)
    )
    return t.lineitem.select(*_ID, number.coerce_number(raw).alias("n")).select(*_ID, "n.*")


@query("meaningful", r"select doc_id, regexp_matches(text, '[\p{L}\p{N}]') as ok, regexp_matches(right(text, 1), '[\p{L}\p{N}]') as last_ok from documents")
def meaningful(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", text.has_meaning(F.col("text")).alias("ok"),
        text.has_meaning(F.right(F.col("text"), F.lit(1))).alias("last_ok"),
    )


_WS_SQL = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CONTEXT_SQL = "[一-鿿，。；：！？（）]"


def _normalized_sql(value: str) -> str:
    """Marks beside CJK text are flagged left and right, widened, and blanks around wide marks removed."""
    sql = f"translate({value}, '{text.FULL_WIDTH}', '{text.HALF_WIDTH}')"
    sql = f"regexp_replace({sql}, '({_CONTEXT_SQL}[ 　]*)([,:;!?()])', '\\1\ue000\\2', 'g')"
    sql = f"regexp_replace({sql}, '\ue000?([,:;!?()])([ 　]*{_CONTEXT_SQL})', '\ue000\\1\\2', 'g')"
    for half, full in zip(text.HALF_MARKS, text.FULL_MARKS):
        sql = f"replace({sql}, '\ue000{half}', '{full}')"
    sql = f"regexp_replace({sql}, '{_WS_SQL}+([，。；：！？）】》（【《])', '\\1', 'g')"
    return f"regexp_replace({sql}, '([（【《]){_WS_SQL}+', '\\1', 'g')"


@query(
    "normalize_text",
    f"""select doc_id, {_normalized_sql("coalesce(text, '')")} as text, {_normalized_sql("translate(coalesce(text, ''), 'aeon', '中（】Ａ')")} as mixed from documents""",
)
def normalize_text(t: Tables) -> DataFrame:
    """The texts as they are, and with four letters turned into CJK characters and marks."""
    mixed = F.translate("text", "aeon", "中（】Ａ")
    return t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("text"), text.normalize_text(mixed).alias("mixed"))


_STOP = "科目代码|科目名称|上期余额|本期发生额|本期余额|借方|贷方|合计|编制日期|编制单位|制表|审核|复核|共|第|页|单位"


@query(
    "title_like",
    rf"""select event_id, length(regexp_replace(regexp_replace(t, '{_STOP}', '', 'g'), '[\s0-9（）()：:．.、·—\-‐–]+', '', 'g')) >= 2 as ok
 from (select event_id, case event_id % 4 when 0 then event_type || ' 合计' when 1 then '第' || event_id || '页' when 2 then '科目代码 (' || event_id || ')' else substr(event_type, 1, 1) || '2024年' end as t from events)""",
)
def title_like(t: Tables) -> DataFrame:
    e = F.col("event_id")
    sample = (
        F.when(e % 4 == 0, F.concat("event_type", F.lit(" 合计")))
        .when(e % 4 == 1, F.concat(F.lit("第"), e, F.lit("页")))
        .when(e % 4 == 2, F.concat(F.lit("科目代码 ("), e, F.lit(")")))
        .otherwise(F.concat(F.substring("event_type", 1, 1), F.lit("2024年")))
    )
    return t.events.select("event_id", text.title_like(sample).alias("ok"))


@query("key_code", r"select p_partkey, regexp_replace(p_name || p_brand, '[^\p{L}\p{N}]', '', 'g') as code from part")
def key_code(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.key_code(F.concat("p_name", "p_brand")).alias("code"))


_AGREE = "(list_sum(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: case when {a}[i] = {b}[i] then 1 else 0 end)) / greatest(length({a}), length({b})))"
_PAIR = """pair as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(11000 + l_partkey % 97 as varchar) as a,
 case l_linenumber % 4 when 0 then cast(11000 + l_suppkey % 97 as varchar) when 1 then cast(110000 + l_partkey % 970 as varchar)
 when 2 then cast(11000 + l_partkey % 97 as varchar) || '中央' else 'x' end as b from lineitem)"""
# Both code columns are non-empty, letters or digits.
_CODES = f"(a = b or (abs(length(a) - length(b)) <= 1 and {_AGREE.format(a='a', b='b')} >= 0.7))"
_DIGIT = r"regexp_replace({0}, '[^0-9]', '', 'g')"
_DA, _DB = _DIGIT.format("a"), _DIGIT.format("b")
_KEYS = f"""(a = b or (length({_DB}) >= 3 and contains({_DA}, {_DB}) and length({_DA}) - length({_DB}) <= length({_DA}) * 0.6)
 or (length({_DA}) >= 3 and contains({_DB}, {_DA}) and length({_DB}) - length({_DA}) <= length({_DB}) * 0.6)
 or (abs(length(a) - length(b)) <= 1 and {_AGREE.format(a='a', b='b')} >= 0.75))"""
_NUMERIC_B = r"regexp_full_match(b, '[0-9]+')"
_TEXTS = f"(a = b or (not {_NUMERIC_B} and length(b) >= 4 and {_AGREE.format(a='a', b='b')} >= 0.8))"


def _pairs(t: Tables) -> DataFrame:
    p, s, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") % 4
    code = (11000 + p % 97).cast("string")
    other = (
        F.when(line == 0, (11000 + s % 97).cast("string"))
        .when(line == 1, (110000 + p % 970).cast("string"))
        .when(line == 2, F.concat(code, F.lit("中央")))
        .otherwise("x")
    )
    return t.lineitem.select(*_ID, "l_partkey", "l_suppkey", code.alias("a"), other.alias("b"))


_PAIR_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_PAIR_ID = (*_ID, "l_partkey", "l_suppkey")


@query("codes_match", f"with {_PAIR} select {_PAIR_COLS}, {_CODES} as hit from pair")
def codes_match(t: Tables) -> DataFrame:
    return _pairs(t).select(*_PAIR_ID, fuzzy.codes_match(F.col("a"), F.col("b")).alias("hit"))


@query("key_match", f"with {_PAIR} select {_PAIR_COLS}, {_KEYS} as hit from pair")
def key_match(t: Tables) -> DataFrame:
    return _pairs(t).select(*_PAIR_ID, fuzzy.key_match(F.col("a"), F.col("b")).alias("hit"))


@query("text_match", f"with {_PAIR} select {_PAIR_COLS}, {_TEXTS} as hit from pair")
def text_match(t: Tables) -> DataFrame:
    return _pairs(t).select(*_PAIR_ID, fuzzy.text_match(F.col("a"), F.col("b")).alias("hit"))


_COMB = _KEYS.replace("b,", "(b || nm),").replace("length(b)", "length(b || nm)").replace("a = b", "a = b || nm").replace("b[i]", "(b || nm)[i]")


@query(
    "row_key_match",
    f"""with {_PAIR}, named as (select *, case when l_partkey % 5 = 0 then '预算支出' || a else '其他' end as tn,
 case when l_suppkey % 3 = 0 then '预算支出' || a || '项' else '别名' end as nm from pair)
 select {_PAIR_COLS}, ({_COMB} or (length(tn) >= 3 and (contains(b || nm, tn) or contains(tn, b || nm))) or {_KEYS}
 or tn = nm or (length(tn) >= 4 and length(nm) >= 4 and {_AGREE.format(a='tn', b='nm')} >= 0.8)) as hit from named""",
)
def row_key_match(t: Tables) -> DataFrame:
    tpl_name = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("预算支出"), "a")).otherwise("其他")
    name = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("预算支出"), "a", F.lit("项"))).otherwise("别名")
    return _pairs(t).select(
        *_PAIR_ID, fuzzy.row_key_match(F.col("a"), tpl_name, F.col("b"), name).alias("hit")
    )


@query(
    "match_all_kw",
    """select p_partkey, contains(p_name, 'r') and contains(p_name, 'in') as both_words, true as blank,
 contains(p_name, split_part(p_name, ' ', 1)) and contains(p_name, p_type) as own_words from part""",
)
def match_all_kw(t: Tables) -> DataFrame:
    name = F.col("p_name")
    own = F.concat(F.element_at(F.split(name, " "), 1), F.lit("，,"), F.col("p_type"))
    return t.part.select(
        "p_partkey",
        text.match_all_keywords(name, F.lit("r;in")).alias("both_words"),
        text.match_all_keywords(name, F.lit("")).alias("blank"),
        text.match_all_keywords(name, own).alias("own_words"),
    )


@query("skip_any_kw", "select p_partkey, contains(p_name, 'ring') or contains(p_name, 'bolt') as skipped, false as none from part")
def skip_any_kw(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select(
        "p_partkey",
        text.has_any_keyword(name, F.lit(" ring ; bolt;")).alias("skipped"),
        text.has_any_keyword(name, F.lit(" ; ")).alias("none"),
    )


_D = "(l_extendedprice - (l_extendedprice + (l_linenumber - 4) * 0.003::double))"


@query(
    "approx_cmp",
    f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, abs({_D}) > 0.005 as ne, abs({_D}) <= 0.005 as eq, {_D} <= 0.005 as le,
 {_D} >= -0.005 as ge, {_D} < -0.005 as lt, {_D} > 0.005 as gt from lineitem""",
)
def approx_cmp(t: Tables) -> DataFrame:
    a = F.col("l_extendedprice")
    b = a + (F.col("l_linenumber") - 4) * F.lit(0.003)
    names = {"ne": "<>", "eq": "=", "le": "<=", "ge": ">=", "lt": "<", "gt": ">"}
    return t.lineitem.select(*_PAIR_ID, *[compare.approx(op, a, b).alias(n) for n, op in names.items()])


@query(
    "round2_cmp",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(18,2)), 2)
 <> round(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(18,2)), 2) as differs from lineitem""",
)
def round2_cmp(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    side = lambda c: price * F.col(c).cast("decimal(18,2)")
    return t.lineitem.select(
        *_PAIR_ID, compare.round2_differs(side("l_discount"), side("l_tax")).alias("differs")
    )


@query("sig15", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(printf('%.14e', l_extendedprice * (1 - l_discount)) as double) as cut from lineitem""")
def sig15(t: Tables) -> DataFrame:
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(*_PAIR_ID, number.sig15(value).alias("cut"))


@query(
    "safe_name",
    r"""select page_id, left(coalesce(nullif(trim(regexp_replace(url, '[\\/*?:\[\]]', '_', 'g')), ''), 'Sheet'), 31) as name from pages""",
)
def safe_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.safe_sheet_name(F.col("url")).alias("name"))


@query("safe_file", r"select page_id, regexp_replace(url, '[^\p{L}\p{N}_.\-]+', '_', 'g') as name from pages")
def safe_file(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query(
    "json_extract",
    "select event_id, 'k' as key, cast(json_extract(props, '$.k') as int) as value from events",
)
def json_extract(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value")
    )


@query(
    "lay_grid",
    """select p_partkey, cast(u.i as int) as i, cast(round_even(cast(p_size as double) + u.f * (p_retailprice - p_size), 0) as int) as edge,
 round(round_even(cast(p_size as double) + u.f * (p_retailprice - p_size), 0) - round_even(cast(p_size as double), 0), 5) as dist
 from part, lateral (values (0, 0.0::double), (1, 0.25), (2, 0.5), (3, 1.0)) u(i, f)""",
)
def lay_grid(t: Tables) -> DataFrame:
    fracs = F.array(*[F.lit(f) for f in (0.0, 0.25, 0.5, 1.0)])
    edges = geometry.lay_edges(fracs, F.col("p_size").cast("double"), F.col("p_retailprice"))
    laid = t.part.select("p_partkey", edges.alias("edges"))
    span = F.element_at("edges", -1) - F.element_at("edges", 1)
    back = F.transform(geometry.edge_fracs(F.col("edges")), lambda f: F.bround(f * F.greatest(span, F.lit(1))).cast("double"))
    return laid.select("p_partkey", F.posexplode(F.arrays_zip("edges", back.alias("dist"))).alias("i", "e")).select(
        "p_partkey", "i", F.col("e.edges").alias("edge"), F.col("e.dist").alias("dist")
    )
