"""Readers of word lists, typo lists, INI sections, archives, JSON sheets and HTML pages."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INI_BYTES = 16 << 20


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(F.trim(F.regexp_replace("value", r"[\r\uFEFF]", "")).alias("line"))


def read_words(spark: SparkSession, path: str, glob: str | None = "*.txt") -> DataFrame:
    """(word): the distinct lines; blank ones and those starting with # or ! are dropped."""
    return _lines(spark, path, glob).where("line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, '!')").select(F.col("line").alias("word")).distinct()


def read_typos(spark: SparkSession, path: str, glob: str | None = "*.txt") -> DataFrame:
    """(typo, correction) of lines 'typo->correction'; lines without exactly two parts are dropped."""
    parts = F.split("line", "->")
    good = _lines(spark, path, glob).where("line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, '!')").where(F.size(parts) == 2)
    out = good.select(F.trim(parts[0]).alias("typo"), F.trim(parts[1]).alias("correction")).where("typo <> ''")
    return out.groupBy("typo").agg(F.min("correction").alias("correction"))


def read_archive(spark: SparkSession, path: str, pattern: str = "*.txt", batch: int = 10_000) -> DataFrame:
    """(file, line) of the matching members of tar archives; path may be a file, a folder or a glob.

    An archive is read in one task, its lines leave it in batches; nothing passes
    through the driver. Spark takes binary files of up to 2 GB.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for b in batches for c in b["content"]):
            with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                for member in archive:
                    if not (member.isfile() and fnmatch(member.name, pattern)):
                        continue
                    text = io.TextIOWrapper(archive.extractfile(member), "utf-8", "replace")
                    while lines := list(islice(text, batch)):
                        yield pd.DataFrame({"file": member.name, "line": [x.rstrip("\r\n") for x in lines]})

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(members, "file string, line string")


def parse_ini(text: str, section: str) -> list[tuple[str, str]]:
    """(key, value) pairs of one section in order; names ignore case, blank lines and ; # comments are skipped."""
    out, inside = [], False
    for line in text.lstrip("﻿").splitlines():
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line.startswith("[") and line.endswith("]"):
            inside = line[1:-1].strip().lower() == section.lower()
        elif inside and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if key:
                out.append((key, value))
    return out


def read_ini(spark: SparkSession, path: str, section: str) -> DataFrame:
    """(key, value, place) of a section of one INI file."""
    raw = spark.read.format("binaryFile").load(path)
    # the length alone reads no content
    if raw.select("length").first().length > MAX_INI_BYTES:
        raise ValueError(f"an INI file of more than {MAX_INI_BYTES} bytes")
    pairs = parse_ini(bytes(raw.select("content").first().content).decode("utf-8", "replace"), section)
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, value string, place int")


def read_sheet(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A JSON array of objects as rows; columns: property name (blanks allowed) -> column name."""
    raw = spark.read.option("multiLine", "true").schema(", ".join(f"`{p}` string" for p in columns)).json(path)
    return raw.select(*[F.col(f"`{p}`").alias(c) for p, c in columns.items()])


def read_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """(page_file_name, html): whole files, their bytes as UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("page_file_name"), F.decode("content", "UTF-8").alias("html"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(code, title, official_url, replaced_by): a sheet of groups, as CSV with those headings; codes in lower case, the first row of a code counts."""
    raw = spark.read.option("header", "true").schema("code string, title string, official_url string, replaced_by string").csv(path)
    return raw.where("trim(code) <> ''").groupBy(F.lower(F.trim("code")).alias("code")).agg(*[F.min(c).alias(c) for c in ("title", "official_url")], F.min(F.lower(F.trim("replaced_by"))).alias("replaced_by"))
