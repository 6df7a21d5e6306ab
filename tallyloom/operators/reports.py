"""Report pages as rows of (file_name, html); writing them is one text file per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Text made safe for HTML; null becomes ''."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def file_name(title: Column) -> Column:
    """A file name from a title: letters and digits, '-' between; 'none' for null or nothing left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(F.coalesce(bare, F.lit("")) == "", "none").otherwise(bare), F.lit(".html"))


def group_pages(rows: DataFrame, group: str, kind: str, title: str, none: str = "No group") -> DataFrame:
    """(group, file_name, html): a page per group with its entries by kind and title; rows of no group share one page."""
    shown = F.coalesce(F.col(group), F.lit(none))
    entry = F.concat(F.lit("<li>"), escaped(F.col(kind)), F.lit(": "), escaped(F.col(title)), F.lit("</li>"))
    pages = rows.groupBy(shown.alias("group")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("items"))
    body = F.concat(F.lit("<h1>"), escaped(F.col("group")), F.lit("</h1><ul>"), F.col("items"), F.lit("</ul>"))
    return pages.select("group", file_name(F.col("group")).alias("file_name"), body.alias("html"))


def index_page(pages: DataFrame) -> DataFrame:
    """One row (file_name, html) that links all pages, sorted by group."""
    link = F.concat(F.lit('<li><a href="'), F.col("file_name"), F.lit('">'), escaped(F.col("group")), F.lit("</a></li>"))
    return pages.agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col("group").alias("g"), link.alias("l")))).getField("l"), "").alias("links")).select(F.lit("index.html").alias("file_name"), F.concat(F.lit("<ul>"), "links", F.lit("</ul>")).alias("html"))
