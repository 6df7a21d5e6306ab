"""HTML pages: visible text, images, status tables. One parse per page, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: elements without visible text, end mark, classes of the status table
HIDDEN = frozenset(("head", "script", "style", "nav", "header", "footer"))
FOOTER_MARK = "[%file newfooter%]"
STATUS_CLASSES = {"colsd": "Draft", "colstu": "Trial Use", "colsi": "Informative", "colsn": "Normative"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open one of these ends where the next of its kind begins.
SIBLINGS = frozenset(("p", "li", "td", "th", "tr", "dt", "dd", "option"))


@dataclass
class Page:
    text: str = ""
    images: list[tuple[str, bool, bool]] = field(default_factory=list)
    status: str | None = None
    maturity: int | None = None
    ballot: str | None = None
    work_group: str | None = None


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.lines: list[str] = []
        self.page = Page()
        self.cell: str | None = None
        self.cells: dict[str, str] = {}
        self.table: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        if tag == "body" and "head" in self.open:
            self._close("head")
        if tag in SIBLINGS and tag in self.open and "table" not in self.open[self.open.index(tag) :]:
            self._close(tag)
        if tag == "img" and at.get("src"):
            self.page.images.append((at["src"], not (at.get("alt") or "").strip(), not (self.open and self.open[-1] == "figure")))
        if tag == "table" and self.table is None:
            known = [c for c in (at.get("class") or "").split() if c in STATUS_CLASSES]
            if known:
                self.table, self.page.status = known[0], STATUS_CLASSES[known[0]]
        if tag == "td" and at.get("id") in ("fmm", "ballot", "wg"):
            self.cell = at["id"]
            self.cells.setdefault(self.cell, "")
        if tag not in VOID:
            self.open.append(tag)

    def _close(self, tag: str) -> None:
        while self.open:
            last = self.open.pop()
            if last == "td":
                self.cell = None
            if last == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.cells[self.cell] += data
        if not HIDDEN.intersection(self.open) and data.strip():
            self.lines.append(unquote(data.strip()))

    def done(self) -> Page:
        page = self.page
        text = "\n".join(self.lines)
        page.text = text.split(FOOTER_MARK, 1)[0]
        behind = lambda s: s.rsplit(":", 1)[-1].strip()
        if "fmm" in self.cells and behind(self.cells["fmm"]).lstrip("-").isdigit():
            page.maturity = int(behind(self.cells["fmm"]))
        page.ballot = behind(self.cells["ballot"]) or None if "ballot" in self.cells else None
        # 'Work Group[%wg orders%]': what stands behind the first 'wg' or 'wgt'
        words = [w for w in re.split(r"[\s\[\]%]+", self.cells.get("wg", "")) if w]
        at = next((i for i, w in enumerate(words) if w.lower() in ("wg", "wgt")), len(words))
        page.work_group = words[at + 1] if at + 1 < len(words) else None
        return page


def read_page(html: str | None) -> Page:
    """A page's parts; broken markup is read as far as it goes."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.done()


def page_text(html: Column) -> Column:
    """Visible text, one line per text leaf; '' for null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([read_page(p).text for p in pages], dtype=object)

    return texts(html)


def page_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_id, status, maturity, ballot, work_group, images) of every page."""
    source = pages.select(F.col(key).alias("page_id"), F.col(html).alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_page(h) for h in batch["html"]]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "status": [p.status for p in read],
                    "maturity": pd.array([p.maturity for p in read], dtype="Int32"),
                    "ballot": [p.ballot for p in read],
                    "work_group": [p.work_group for p in read],
                    "images": [[{"source": s, "missing_alt": a, "not_in_figure": f} for s, a, f in p.images] for p in read],
                }
            )

    return source.mapInPandas(parts, f"page_id {kind}, status string, maturity int, ballot string, work_group string, images array<struct<source: string, missing_alt: boolean, not_in_figure: boolean>>")


def page_images(parts: DataFrame) -> DataFrame:
    """(page_id, source, missing_alt, not_in_figure): images with a fault, one row per page and source."""
    each = parts.select("page_id", F.explode("images").alias("i")).select("page_id", "i.*").where("missing_alt OR not_in_figure")
    return each.groupBy("page_id", "source").agg(F.bool_or("missing_alt").alias("missing_alt"), F.bool_or("not_in_figure").alias("not_in_figure"))


def page_status(parts: DataFrame) -> DataFrame:
    """Status rows of the pages that have a status table; others are skipped."""
    return parts.where("status IS NOT NULL").select("page_id", "status", "maturity", "ballot", "work_group")
