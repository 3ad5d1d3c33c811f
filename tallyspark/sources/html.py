"""Lists and tables in HTML columns."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class _Tables(HTMLParser):
    """Rows of the tables, each with the heading before its table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, list[str]]] = []
        self.links: list[tuple[str, str]] = []
        self.title, self.table = "", -1
        self._cell = self._heading = self._item = None
        self._href = None

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "h4", "caption"):
            self._heading = ""
        elif tag == "table":
            self.table += 1
        elif tag == "tr":
            self.rows.append((self.title, self.table, []))
        elif tag in ("td", "th"):
            self._cell = ""
        elif tag == "li":
            self._item, self._href = "", None
        elif tag == "a" and self._item is not None:
            self._href = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3", "h4", "caption") and self._heading is not None:
            self.title, self._heading = " ".join(self._heading.split()), None
        elif tag in ("td", "th") and self._cell is not None:
            if self.rows:
                self.rows[-1][2].append(" ".join(self._cell.split()))
            self._cell = None
        elif tag == "li" and self._item is not None:
            if self._href is not None:
                self.links.append((self._href, " ".join(self._item.split())))
            self._item = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell += data
        elif self._heading is not None:
            self._heading += data
        elif self._item is not None:
            self._item += data


def read_tables(page: str | None) -> Iterator[tuple[str, int, list[str]]]:
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    return (r for r in parser.rows if r[2])


def _per_page(df: DataFrame, column: str, added: str, rows):
    schema = T.StructType([f for f in df.schema if f.name != column] + list(T._parse_datatype_string(added)))
    names = [f.name for f in T._parse_datatype_string(added)]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [(k, *row) for k, page in enumerate(pdf[column]) for row in rows(page)]
            at = [f[0] for f in found]
            out = pdf.drop(columns=[column]).iloc[at].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame({n: pd.Series([f[i + 1] for f in found], dtype=object) for i, n in enumerate(names)})], axis=1)

    return df.mapInPandas(run, schema)


def tables(df: DataFrame, column: str) -> DataFrame:
    """One row per table row of the pages: heading, table_no, cells."""
    return _per_page(df, column, "heading string, table_no int, cells array<string>", read_tables)


def list_links(df: DataFrame, column: str) -> DataFrame:
    """One row per list item with a link: href and text."""

    def links(page):
        parser = _Tables()
        parser.feed(page or "")
        parser.close()
        return parser.links

    return _per_page(df, column, "href string, text string", links)
