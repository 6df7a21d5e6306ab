"""Checks over linked specification tables: elements, value sets, code systems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T


def binding_escapes(elements: DataFrame, concepts: DataFrame, value_set: str, code: str, other: Sequence[str], unknown: Sequence[str]) -> DataFrame:
    """elements plus has_other, has_unknown: whether the bound value set has such a code.

    Concepts are folded to one row per value set before the join; an element
    without a value set, or whose set has no concept, has neither.
    """
    folded = concepts.where(F.col(code).isin([*other, *unknown])).groupBy(value_set).agg(F.bool_or(F.col(code).isin(list(other))).alias("has_other"), F.bool_or(F.col(code).isin(list(unknown))).alias("has_unknown"))
    return elements.join(folded, value_set, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_other", "has_unknown")})


def binding_label(strength: Column, bound: Column, least: Column, has_other: Column, has_unknown: Column) -> Column:
    """How a required binding is to be read; '' for any other strength."""
    found = F.when(has_other & has_unknown, "has other and unknown").when(has_other, "has other").when(has_unknown, "has unknown").otherwise("neither other nor unknown")
    shown = F.when(bound, found).otherwise("X")
    return F.when(F.lower(strength) == "required", F.concat(F.when(least == 0, "optional - ").otherwise("required - "), shown)).otherwise("")


def element_flags(elements: DataFrame, own_prefix: str) -> DataFrame:
    """elements plus the flags a reviewer looks at.

    Needs min_cardinality, standard_status, fixed_value, pattern_value,
    binding_strength, binding_value_set, meaning_when_missing, type_literal,
    is_modifier, modifier_reason.
    """
    required = F.coalesce(F.lower("binding_strength") == "required", F.lit(False))
    own = F.coalesce(F.startswith(F.lower("binding_value_set"), F.lit(own_prefix.lower())), F.lit(False))
    return elements.withColumns(
        {
            "is_required": F.col("min_cardinality") > 0,
            "is_trial_use": F.coalesce(F.lower("standard_status") == "trial-use", F.lit(False)),
            "has_fixed": F.col("fixed_value").isNotNull(),
            "has_pattern": F.col("pattern_value").isNotNull(),
            "external_binding": F.when(required & ~own, F.col("binding_value_set")),
            "wants_missing_meaning": (F.col("min_cardinality") == 0) & F.col("meaning_when_missing").isNull() & F.coalesce(F.col("type_literal").contains("code") | F.col("type_literal").contains("boolean"), F.lit(False)),
            "modifier_note": F.when(F.col("is_modifier") & (F.coalesce("modifier_reason", F.lit("")) == ""), "no reason").when(F.col("is_modifier"), "X").otherwise(""),
        }
    )


def shared_systems(value_sets: DataFrame, systems: DataFrame, bound: DataFrame, key: str, listed: str, url: str, version: str) -> DataFrame:
    """(key, siblings, sibling_bound): other value sets over the same code systems, and whether one of them is bound.

    value_sets: key and `listed`, its systems as comma-separated 'url' or
    'url|version'. systems: url and version. bound: key. A listed system joins
    on url and version if it names a version, else on url alone.
    """
    named = value_sets.select(key, F.explode(T.csv_list(F.col(listed))).alias("system")).distinct()
    known = systems.select(F.explode(F.array(F.col(url), F.concat_ws("|", url, version))).alias("system"), F.col(url).alias("base")).distinct()
    uses = named.join(known, "system").select(key, "base").distinct()
    is_bound = bound.select(F.col(key)).distinct().withColumn("b", F.lit(True))
    # per system: how many sets use it and how many of those are bound; no pairs are formed
    flagged = uses.join(is_bound, key, "left").withColumn("b", F.coalesce("b", F.lit(False)))
    per = flagged.groupBy("base").agg(F.count("*").alias("n"), F.count_if("b").alias("n_bound"))
    back = flagged.join(per, "base")
    return back.groupBy(key).agg(F.bool_or(F.col("n") > 1).alias("has_sibling"), F.bool_or(F.col("n_bound") > F.col("b").cast("int")).alias("sibling_bound"))


def dispositions(artifacts: DataFrame, sheet: DataFrame, name: str, current: str, track: str, voted: str, target: str, tracks: Mapping[str, str]) -> DataFrame:
    """artifacts with an unknown disposition filled from the feedback sheet of the same name.

    tracks: track code (any case) -> disposition. Rows with a disposition, and
    those the sheet does not name, stay.
    """
    said = sheet.groupBy(name).agg(F.min(F.struct(track, voted, target)).alias("s"))
    joined = artifacts.join(said, name, "left")
    new = F.lit(None).cast("string")
    for code, value in tracks.items():
        new = F.when(F.lower(f"s.{track}") == code, F.lit(value)).otherwise(new)
    fill = (F.col(current) == "Unknown") & new.isNotNull()
    return joined.select(*[F.col(c) for c in artifacts.columns if c != current], F.when(fill, new).otherwise(F.col(current)).alias(current), F.when(fill, F.coalesce(F.trim(f"s.{voted}") != "", F.lit(False))).alias("voted"), F.when(fill, F.col(f"s.{target}")).alias("relocated_to"))


def checklist(rules: Sequence[tuple[Column, str]]) -> Column:
    """array<string> of the messages whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(message)) for cond, message in rules]))


def group_report(rows: DataFrame, group: str, kind: str, title: str) -> DataFrame:
    """(group, n, entries): the rows of each group as sorted 'kind: title' texts; null is a group of its own."""
    entry = F.concat_ws(": ", kind, title)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("entries"))


def structure_report(structures: DataFrame, parts: Sequence[tuple[str, DataFrame, str, Column, Column]], key: str) -> DataFrame:
    """(key, part, place, shown): the parts of each structure in order.

    parts: (name, rows, structure key column, order, text). Rows of unknown
    structures are left out.
    """
    from functools import reduce

    from pyspark.sql import Window

    frames = []
    for name, rows, of, order, shown in parts:
        ranked = rows.select(F.col(of).alias(key), F.lit(name).alias("part"), order.alias("o"), shown.alias("shown"))
        placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("o", "shown")))
        frames.append(placed.select(key, "part", "place", "shown").join(structures.select(key), key, "left_semi"))
    return reduce(DataFrame.unionByName, frames)


def with_group(df: DataFrame, code: Column, groups: DataFrame, default: str) -> DataFrame:
    """df plus (code, title, official_url) of its group; a replaced code means its successor, null and unknown ones the default.

    groups: (code, title, official_url, replaced_by), a row per code.
    """
    successor = groups.select(F.col("code").alias("__code"), F.coalesce("replaced_by", "code").alias("__new"))
    resolved = df.withColumn("__code", F.lower(F.trim(code))).join(successor, "__code", "left").withColumn("__new", F.coalesce("__new", F.lit(default)))
    named = groups.select(F.col("code").alias("__new"), "title", "official_url")
    return resolved.join(named, "__new", "left").select(*df.columns, F.col("__new").alias("code"), "title", "official_url")


def artifact_pages(artifacts: DataFrame, structures: DataFrame, pages: DataFrame, structure_id: str, intro: Column, notes: Column) -> DataFrame:
    """artifacts plus has_structure, intro_page and notes_page: looked up by id, and by the names of the files they expect.

    structures has the column `structure_id`, pages `page_file_name`; an artifact without a structure is
    for the caller to refuse, a page that is not there is null.
    """
    there = structures.select(F.col(structure_id)).dropna().distinct().withColumn("__there", F.lit(True))
    names = pages.select("page_file_name").dropna().distinct()
    wanted = artifacts.withColumn("__intro", intro).withColumn("__notes", notes).join(there, structure_id, "left")
    for side in ("intro", "notes"):
        wanted = wanted.join(names.select(F.col("page_file_name").alias(f"__{side}"), F.col("page_file_name").alias(f"{side}_page")), f"__{side}", "left")
    return wanted.select(*artifacts.columns, F.coalesce("__there", F.lit(False)).alias("has_structure"), "intro_page", "notes_page")
