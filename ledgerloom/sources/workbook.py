"""XLSX files -> typed cells and merges, one row per cell."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OUT = (
    "workbook string, sheet string, sheet_no int, kind string, r int, c int, r1 int, c1 int, vtype string, v string, v_num double, "
    "v_ts timestamp_ntz, formula string, _err string"
)
_NAMES = [part.split()[0] for part in _OUT.split(", ")]
# Built-in date formats of the file format.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
_BATCH = 20000


@lru_cache(maxsize=1024)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _tag(element: ET.Element) -> str:
    return _local(element.tag)


_LETTERS = re.compile(r"[A-Z]+")


@lru_cache(maxsize=16384)
def _column(letters: str) -> int:
    c = 0
    for ch in letters:
        c = c * 26 + ord(ch) - 64
    return c


def _address(ref: str) -> tuple[int, int]:
    letters = _LETTERS.match(ref).group(0)
    return int(ref[len(letters):]), _column(letters)


def _texts(element: ET.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def _part(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(book.read(name)) if name in book.namelist() else None


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    styles = _part(book, "xl/styles.xml")
    if styles is None:
        return set()
    custom = {
        int(f.get("numFmtId")) for f in styles.iter()
        if _tag(f) == "numFmt" and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))
    }
    formats = next((x for x in styles if _tag(x) == "cellXfs"), [])
    return {i for i, x in enumerate(formats) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _cells(name: str, content: bytes) -> Iterator[tuple]:
    """Rows in `_OUT` order of one workbook; sheets are parsed as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared_part = _part(book, "xl/sharedStrings.xml")
        shared = [] if shared_part is None else [_texts(si) for si in shared_part]
        dates = _date_styles(book)
        rels = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
        main = list(_part(book, "xl/workbook.xml").iter())
        sheets = [s for s in main if _tag(s) == "sheet"]
        late = any(_tag(x) == "workbookPr" and x.get("date1904") in ("1", "true") for x in main)
        epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        for no, sheet in enumerate(sheets):
            rid = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            target = rels[rid].lstrip("/")
            path = target if target.startswith("xl/") else posixpath.normpath(posixpath.join("xl", target))
            with book.open(path) as stream:
                for _event, e in ET.iterparse(stream):
                    tag = _local(e.tag)
                    if tag == "c":
                        row = _cell(e, shared, dates, epoch)
                        if row is not None:
                            yield (name, sheet.get("name"), no, "cell", *row, None)
                    elif tag == "row":
                        e.clear()
                    elif tag == "mergeCell":
                        a, _, b = e.get("ref").partition(":")
                        (r0, c0), (r1, c1) = _address(a), _address(b or a)
                        yield (name, sheet.get("name"), no, "merge", r0, c0, r1, c1, None, None, None, None, None, None)


def _cell(e: ET.Element, shared: list[str], dates: set[int], epoch: datetime) -> tuple | None:
    r, c = _address(e.get("r"))
    parts = {_tag(x): x for x in e}
    raw = parts["v"].text if "v" in parts else None
    formula = parts["f"].text if "f" in parts else None
    kind = e.get("t", "n")
    place = (r, c, None, None)
    if kind == "inlineStr":
        return (*place, "string", _texts(e), None, None, formula)
    if raw is None:
        return (*place, "null", None, None, None, formula) if formula else None
    if kind == "s":
        return (*place, "string", shared[int(raw)], None, None, formula)
    if kind == "b":
        return (*place, "bool", "true" if raw == "1" else "false", None, None, formula)
    if kind in ("str", "e"):
        return (*place, "string", raw, None, None, formula)
    number = float(raw)
    if int(e.get("s", 0)) in dates:
        return (*place, "date", raw, number, epoch + timedelta(days=number), formula)
    return (*place, "number", raw, number, None, formula)


def _batches(name: str, content: bytes) -> Iterator[list[tuple]]:
    """Rows of one file in batches, all or none: a file longer than one batch is read to its end once
    before its first row leaves, so a fault further down never yields half a file."""
    rows = _cells(name, content)
    first = list(islice(rows, _BATCH))
    if len(first) < _BATCH:
        yield first
        return
    for _ in rows:
        pass
    again = _cells(name, content)
    while batch := list(islice(again, _BATCH)):
        yield batch


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}
    types = [kinds[part.split()[1]] for part in _OUT.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(x, kind, from_pandas=True) for x, kind in zip(columns, types)], _NAMES)


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Cells and merges (column `kind`) of every workbook (path, content); a file that cannot be read gives one row with `_err`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.as_py().rsplit("/", 1)[-1]
                try:
                    for rows in _batches(name, content.as_py()):
                        yield _as_batch(rows)
                except Exception as error:  # noqa: BLE001 - a bad file is reported, the others go on
                    yield _as_batch([(name, *[None] * (len(_NAMES) - 2), f"{type(error).__name__}: {error}")])

    return files.select("path", "content").mapInArrow(run, _OUT)


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """`parse_workbooks` of the files under `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return parse_workbooks(files.select(F.url_decode("path").alias("path"), "content"))


def cells_of(book: DataFrame) -> DataFrame:
    return book.filter("kind = 'cell'").select("workbook", "sheet", "sheet_no", "r", "c", "vtype", "v", "v_num", "v_ts", "formula")


def merges_of(book: DataFrame) -> DataFrame:
    return book.filter("kind = 'merge'").select("workbook", "sheet", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("r1"), F.col("c1"))


def failed_files(book: DataFrame) -> DataFrame:
    return book.filter("_err is not null").select("workbook", "_err")
