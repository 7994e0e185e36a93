"""Rows and text out of HTML columns (SRC8, SRC9, TF6)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


# Tags that separate words inside a cell.
APART = ("p", "br", "div", "strong", "em", "b", "i", "span")


class _Rows(HTMLParser):
    """Cells of table rows, white space collapsed, and the text outside scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.text: list[str] = []
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cell = []
        elif tag in APART and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th") and self.cell is not None:
            self.cells.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.cells is not None:
            self.rows.append(self.cells)
            self.cells = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
        if not self.hidden:
            self.text.append(data)


def _parse(html: str | None) -> _Rows:
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    return parser


def table_rows(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, row_no, cells: table rows with a digit in some cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, r) for p, h in zip(batch[page_id], batch[html], strict=True) for i, r in enumerate(_parse(h).rows) if any(c.isdigit() for x in r for c in x)]
            yield pd.DataFrame(rows, columns=["page_id", "row_no", "cells"])

    return pages.select(page_id, html).mapInPandas(run, "page_id long, row_no int, cells array<string>")


def visible_text(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text: what a reader sees, white space collapsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch[page_id], "text": [" ".join(" ".join(_parse(h).text).split()) for h in batch[html]]})

    return pages.select(page_id, html).mapInPandas(run, "page_id long, text string")
