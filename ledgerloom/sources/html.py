"""HTML tables -> grid cells with row and column spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = "page_id bigint, table_no int, r bigint, c bigint, rspan bigint, cspan bigint, text string"


class _Tables(HTMLParser):
    """Collects (table, r, c, rspan, cspan, text); a cell goes to the first place no span covers.

    Spans that reach into later rows are kept as column intervals with the row they end before, so
    memory follows the cells and not the area they cover. Rows without a cell do not count.
    """

    def __init__(self) -> None:
        super().__init__()
        self.cells: list[tuple[int, int, int, int, int, str]] = []
        self.table, self.row, self.col = -1, -1, 0
        self.fresh = False  # a row tag was seen, its first cell was not
        self.spans: list[tuple[int, int, int]] = []  # (first column, column after, row after), by column
        self.next = self.here = 0
        self.open: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.table, self.row, self.spans, self.fresh = self.table + 1, -1, [], False
        elif tag == "tr":
            self._close()
            self.fresh = True
        elif tag in ("td", "th") and self.table >= 0 and (self.fresh or self.row >= 0):
            self._close()
            if self.fresh:
                self.row, self.col, self.next, self.fresh = self.row + 1, 0, 0, False
                self.spans = sorted(span for span in self.spans if span[2] > self.row)
                self.here = len(self.spans)
            while self.next < self.here and self.spans[self.next][0] <= self.col:
                self.col = max(self.col, self.spans[self.next][1])
                self.next += 1
            spans = dict(attrs)
            rspan, cspan = (_span(spans.get(k)) for k in ("rowspan", "colspan"))
            self.open = [self.table, self.row, self.col, rspan, cspan, []]

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open[5].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def _close(self) -> None:
        if self.open is None:
            return
        table, r, c, rspan, cspan, parts = self.open
        if rspan > 1:
            self.spans.append((c, c + cspan, r + rspan))
        self.col = c + cspan
        self.cells.append((table, r, c, rspan, cspan, "".join(parts).replace(" ", " ").strip()))
        self.open = None


def _span(value: str | None) -> int:
    """A whole number of up to nine digits; anything else, and 0, is no span."""
    return max(int(value), 1) if value and re.fullmatch(r"\s*[0-9]{1,9}\s*", value) else 1


def html_tables(pages: DataFrame) -> DataFrame:
    """Grid cells of every table in (page_id, html); pages without a table are skipped before Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in GRID.split(", ")]
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                parser = _Tables()
                parser.feed(html)
                parser.close()
                rows += [(page_id, *cell) for cell in parser.cells]
            yield pd.DataFrame(rows, columns=names)

    with_table = pages.filter(F.regexp_like("html", F.lit("(?i)<table"))).select("page_id", "html")
    return with_table.mapInPandas(run, GRID)
