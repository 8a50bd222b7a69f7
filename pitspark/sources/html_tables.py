"""Tables of HTML pages as rows, by a Python table function over the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    """Rows of the outermost tables; a table within a cell is text of that cell. A cell or row without an end tag ends where the next one begins, or the table ends."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, list[str]]] = []
        self.table = self.row = -1
        self.depth = 0
        self.cell: list[str] | None = None

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1][2].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def begin_row(self) -> None:
        self.end_cell()
        self.row += 1
        self.rows.append((self.table, self.row, []))

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.table, self.row = self.table + 1, -1
        if self.depth != 1:
            return
        if tag == "tr":
            self.begin_row()
        elif tag in ("td", "th"):
            if self.row < 0:
                self.begin_row()
            self.end_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self.end_cell()
        if tag == "table":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close(self):
        super().close()
        self.end_cell()


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells)."""

    @F.udtf(returnType="table_no int, row_no int, cells array<string>")
    class Parse:
        def eval(self, html: str):
            parser = _Tables()
            parser.feed(html or "")
            parser.close()
            yield from parser.rows

    return pages.lateralJoin(Parse(F.col("html").outer())).select("page_id", "table_no", "row_no", "cells")
