"""Rows of HTML tables as arrays of cells, optionally between two headings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = {"h1", "h2", "h3", "h4"}


class _Tables(HTMLParser):
    def __init__(self, first: str | None, end: str | None) -> None:
        super().__init__()
        self.first, self.end, self.inside = first, end, first is None
        self.rows: list[list[str]] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs) -> None:
        if tag in HEADINGS or self.inside and tag in ("td", "th"):
            self.text = []
        elif self.inside and tag == "tr":
            self.rows.append([])

    def handle_endtag(self, tag) -> None:
        if self.text is None or tag not in HEADINGS | {"td", "th"}:
            return
        said, self.text = " ".join("".join(self.text).split()), None
        if tag not in HEADINGS:
            self.rows and self.rows[-1].append(said)
        elif self.first is not None:
            self.inside = said == self.first or self.inside and said != self.end

    def handle_data(self, data) -> None:
        if self.text is not None:
            self.text.append(data)


def cells(pages: DataFrame, id_col: str, html_col: str, first: str | None = None, end: str | None = None) -> DataFrame:
    """id, row_number (from 0), cells. Rows without cells are left out; null pages have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, html in zip(batch["id"], batch["html"]):
                parser = _Tables(first, end)
                parser.feed(html or "")
                parser.close()
                yield pd.DataFrame([(key, n, row) for n, row in enumerate(r for r in parser.rows if r)], columns=["id", "row_number", "cells"])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInPandas(parse, "id string, row_number int, cells array<string>")


def duchies(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The duchy table's records: rows of 17 cells or more whose id starts with d_; the first cell is a colour mark."""
    # Which cell holds what.
    at = {"duchy_name": 1, "kingdom_name": 2, "empire_name": 5, "county_count": 8, "barony_count": 9, "average_development": 10, "special_buildings": 13, "alternative_names": 14, "capital_county_name": 15, "duchy_id": 16}
    rows = cells(pages, id_col, html_col, "De jure duchies", "Uncreatable duchies").where("size(cells) >= 17")
    return rows.select("id", *[F.get("cells", F.lit(k)).alias(name) for name, k in at.items()]).where("startswith(duchy_id, 'd_')")
