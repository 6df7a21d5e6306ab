"""Prompts from records and a seam for a summariser of any kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is asked of a summariser about a record, its comments and its resolution.
TEMPLATES = {
    "issue": "Summarise this request in two or three sentences for the group that decides on it.\n\nTitle: {title}\n\n{description}",
    "comments": "Summarise what these comments say in two or three sentences.\n\n{comments}",
    "resolution": "Summarise this decision in one or two sentences.\n\nDecision: {resolution}\n\n{resolution_description}",
}


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by each value; null counts as ''."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def joined_comments(comments: DataFrame) -> DataFrame:
    """(issue_id, comments): bodies with text, oldest first, a blank line between."""
    kept = comments.where(F.trim("body") != "")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")).alias("at"), "id", "body")))
    return kept.groupBy("issue_id").agg(F.array_join(F.transform(ordered, lambda c: c["body"]), "\n\n").alias("comments"))


def prompts(issues: DataFrame, comments: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id, kind, prompt): of every record, of its comments if it has some with text, of its resolution if that is described."""
    said = joined_comments(comments).withColumnRenamed("issue_id", "id")
    values = {"key": F.col("issue_key"), "title": F.col("title"), "description": F.col("description"), "comments": F.col("comments"), "resolution": F.col("resolution_name"), "resolution_description": F.col("resolution_description")}
    there = {"issue": F.lit(True), "comments": F.col("comments").isNotNull(), "resolution": F.trim("resolution_description") != ""}
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.when(there[kind], fill(t, values)).alias("prompt")) for kind, t in templates.items()])
    return issues.join(said, "id", "left").select("id", F.explode(each).alias("x")).select("id", "x.*").where("prompt IS NOT NULL")


def first_sentence(prompt: str) -> str:
    """The stand-in summariser: deterministic, offline."""
    head, _, _ = " ".join(prompt.split()).partition(". ")
    return head


def summarise(prompted: DataFrame, summariser: Callable[[str], str] = first_sentence) -> DataFrame:
    """(id, kind, summary, failed): one call per prompt; a call that raises gives a null summary and its error."""
    kind = prompted.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, what, prompt in zip(batch["id"], batch["kind"], batch["prompt"], strict=True):
                try:
                    rows.append((i, what, summariser(prompt or ""), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((i, what, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["id", "kind", "summary", "failed"])

    return prompted.select("id", "kind", "prompt").mapInPandas(run, f"id {kind}, kind string, summary string, failed string")
