r"""Words of pages resolved against dictionaries, by joins of distinct words.

A page's words are what blanks and double quotes part. Words that review doesn't
look at (`review.skip_reason`) and words without a letter are passed over. A
word is, in this order: the name of an earlier release, the word 'deprecated', an
artifact or path of the current release, one of the published release only
(removed, unless the dictionary has it), a known typo, a dictionary word; a word
that is none of these is read part by part, and unknown if one of its parts is.

All this depends on the word alone, so each distinct word is looked up once,
however often it stands. The one thing that depends on the place are relative
words ('.status'), which belong to the artifact named last on their page: a
window over the page's naming and relative words, all others left out, finds it.
An artifact's name is its word up to the first '.'; a relative word that is found
leaves the last name as it is.

Defined results: null and empty texts give no rows; repeated rows of a page are
one page; a dictionary with repeated words keeps the last class by place, the
smallest correction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import review
from tallyloom.functions import text as T
from tallyloom.session import materialise

# fixed values: names of earlier releases that count as such
PRIOR_RELEASES = ("dstu1", "dstu2", "r2", "stu3", "r3", "r4", "r4b", "r5")
# fixed values: what parts the words of a page, and the parts of a word
WORD_SPLIT = r'[ \t\r\n"]+'
PART_SPLIT = r"""[ \t\r\n.:\\/"';+\-_#*&^%@!,|?={}()\[\]]+"""
STRUCTURE, ELEMENT, PARAMETER, TYPO, WORD = "structure", "element", "parameter", "typo", "word"
CURRENT, PUBLISHED = "current", "published"


def dictionary_rows(df: DataFrame, name: str, kind: str, release: str = "", note: Column | None = None, place: Column | None = None) -> DataFrame:
    """(form, kind, release, note, place) of the distinct names in a column; names without a letter or digit are dropped.

    The form is the sanitised name, of typos the name in lower case. note: the
    class of a structure, the correction of a typo.
    """
    form = F.lower(F.trim(name)) if kind == TYPO else T.sanitize(F.col(name))
    rows = df.select(form.alias("form"), F.lit(kind).alias("kind"), F.lit(release).alias("release"), (note if note is not None else F.lit(None)).cast("string").alias("note"), (place if place is not None else F.lit(0)).cast("long").alias("place"))
    return rows.where("form <> ''").groupBy("form", "kind", "release").agg(F.max(F.struct("place", "note")).alias("last")).select("form", "kind", "release", F.col("last.note").alias("note"), F.col("last.place").alias("place"))


def vocabulary(parts: list[DataFrame]) -> DataFrame:
    """One row per form: (form, current, published, current_parameter, published_parameter, typo, word).

    current and published: (class, names) - the class, and whether such a word
    names an artifact. 'value' before a structure's name means it, too, without
    naming it.
    """
    rows = reduce(DataFrame.unionByName, parts)
    behind_value = rows.where(F.col("kind") == STRUCTURE).withColumn("form", F.concat(F.lit("value"), "form")).withColumn("kind", F.lit("value"))
    rows = rows.unionByName(behind_value)
    # a structure before the same behind 'value' before an element
    rank = F.when(F.col("kind") == STRUCTURE, 0).when(F.col("kind") == "value", 1).when(F.col("kind") == ELEMENT, 2)
    what = F.struct(rank.alias("rank"), F.when(F.col("kind") == ELEMENT, "Element").otherwise(F.coalesce("note", F.lit("Unknown"))).alias("class"), (F.col("kind") != "value").alias("names"))
    of = lambda release: F.min(F.when(rank.isNotNull() & (F.col("release") == release), what)).alias(release)
    param = lambda release: F.bool_or((F.col("kind") == PARAMETER) & (F.col("release") == release)).alias(f"{release}_parameter")
    return rows.groupBy("form").agg(of(CURRENT), of(PUBLISHED), param(CURRENT), param(PUBLISHED), F.min(F.when(F.col("kind") == TYPO, F.coalesce("note", F.lit("")))).alias("typo"), F.bool_or(F.col("kind") == WORD).alias("word"))


def _looked_up(units: DataFrame, known: DataFrame, prefix: str, key: Column) -> DataFrame:
    """units plus the columns of the vocabulary at `key`, named with a prefix."""
    right = known.select(*[F.col(c).alias(f"{prefix}{c}") for c in known.columns])
    return units.withColumn(f"{prefix}key", key).join(right, F.col(f"{prefix}key") == F.col(f"{prefix}form"), "left").drop(f"{prefix}key", f"{prefix}form")


def _hit(prefix: str, release: str, symbol: Column, word: Column) -> Column:
    """(class, name) if the vocabulary columns hold an artifact of a release; parameters only behind '_'."""
    found = F.col(f"{prefix}{release}")
    name = F.when(found["names"], F.trim(F.regexp_extract(word, r"^\.*([^.]*)", 1)))
    parameter = (symbol == "_") & F.col(f"{prefix}{release}_parameter")
    none = F.lit(None).cast("string").alias("name")
    return F.when(found.isNotNull(), F.struct(found["class"].alias("class"), name.alias("name"))).when(parameter, F.struct(F.lit("SearchParameter").alias("class"), none))


def _outcome(form: Column, word: Column, current: Column, published: Column, is_word: Column, typo: Column) -> Column:
    """(kind, note, name) of a word; null if it is none of what is known."""
    outcome = lambda kind, note=None, name=None: F.struct(F.lit(kind).alias("kind"), (note if note is not None else F.lit("")).alias("note"), (name if name is not None else F.lit(None)).cast("string").alias("name"))
    return (
        F.when(form.isin(*PRIOR_RELEASES), outcome("prior"))
        .when(form == "deprecated", outcome("deprecated"))
        .when(current.isNotNull(), outcome("known", None, current["name"]))
        .when(published.isNotNull() & is_word, outcome("known"))
        .when(published.isNotNull(), outcome("removed", published["class"], published["name"]))
        .when(typo.isNotNull(), outcome("typo", typo))
        .when(is_word, outcome("known"))
    )


def _resolved_units(units: DataFrame, known: DataFrame) -> DataFrame:
    """units (unit) plus form, symbol, hits and outcome of each distinct unit."""
    shaped = units.select("unit", T.sanitize(F.col("unit")).alias("form"), T.prefix_symbol(F.col("unit")).alias("symbol"))
    own = _looked_up(shaped, known, "a_", F.col("form"))
    single = F.when(F.col("form").endswith("s"), F.substring("form", F.lit(1), F.length("form") - 1))
    both = _looked_up(own, known.select("form", CURRENT, PUBLISHED, f"{CURRENT}_parameter", f"{PUBLISHED}_parameter"), "s_", single)
    every = _looked_up(both, known.select("form", "typo"), "t_", F.lower("unit"))
    shorter = F.substring("unit", F.lit(1), F.length("unit") - 1)
    hit = lambda release: (_hit("a_", release, F.col("symbol"), F.col("unit")), _hit("s_", release, F.col("symbol"), shorter))
    (own_now, single_now), (own_then, single_then) = hit(CURRENT), hit(PUBLISHED)
    is_word = F.coalesce("a_word", F.lit(False))
    typo = F.coalesce("t_typo", "a_typo")
    out = every.select("unit", "form", "symbol", own_now.alias("own_now"), single_now.alias("single_now"), own_then.alias("own_then"), single_then.alias("single_then"), is_word.alias("is_word"), typo.alias("typo"))
    return out.withColumn("outcome", _outcome(F.col("form"), F.col("unit"), F.coalesce("own_now", "single_now"), F.coalesce("own_then", "single_then"), F.col("is_word"), F.col("typo")))


def resolve_pages(pages: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(page_id, kind, word, note): counts of prior releases and of 'deprecated', and the removed, typo and unknown words of every page; known: a `vocabulary`."""
    source = pages.select(F.col(key).alias("page_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    places = source.select("page_id", F.posexplode(F.split("text", WORD_SPLIT)).alias("at", "word")).where("word <> ''")
    words = places.select("word").distinct().where((T.first_letter(F.col("word")) != "") & review.skip_reason(F.col("word")).isNull())
    parts = F.filter(F.split("word", PART_SPLIT), lambda x: (x != "") & (T.first_letter(x) != ""))
    units = words.select("word", F.posexplode(F.concat(F.array("word"), parts)).alias("no", "unit"))
    found = units.join(_resolved_units(units.select("unit").distinct(), known), "unit")
    listed = F.struct(F.col("outcome.kind").alias("kind"), F.col("unit").alias("word"), F.col("outcome.note").alias("note"))
    own = lambda c: F.max(F.when(F.col("no") == 0, F.struct(c)))[c].alias(c)
    per_word = found.groupBy("word").agg(
        *[own(c) for c in ("form", "own_now", "single_now", "own_then", "single_then", "is_word", "typo", "outcome")],
        F.array_sort(F.collect_list(F.when(F.col("no") > 0, F.struct("no", F.when(F.col("outcome").isNotNull(), listed).alias("x"), F.col("outcome.name").alias("name"))))).alias("parts"),
    )
    whole = F.col("outcome").isNotNull()
    part_names = F.filter(F.transform("parts", lambda p: p["name"]), lambda n: n.isNotNull())
    of_parts = F.filter(F.transform("parts", lambda p: p["x"]), lambda x: x.isNotNull())
    unknown = F.when(F.exists("parts", lambda p: p["x"].isNull()), F.array(F.struct(F.lit("unknown").alias("kind"), F.col("word"), F.lit("").alias("note")))).otherwise(F.array().cast("array<struct<kind: string, word: string, note: string>>"))
    noted = F.when(whole, F.array(F.struct(F.col("outcome.kind").alias("kind"), F.col("word"), F.col("outcome.note").alias("note")))).otherwise(F.concat(of_parts, unknown))
    kept = F.filter(noted, lambda x: x["kind"] != "known")
    name = F.when(whole, F.col("outcome.name")).otherwise(F.try_element_at(part_names, F.lit(-1)))
    told = per_word.withColumn("noted", kept).withColumn("name", name).withColumn("relative", F.startswith("word", F.lit(".")))
    # most words, and the frequent ones, are known and name nothing: they go no further
    # written once, a row per word: both ways below read it
    telling = materialise(told.where((F.size("noted") > 0) | F.col("name").isNotNull() | F.col("relative")))
    here = places.join(telling, "word")
    plain = here.where(~F.col("relative"))
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    named = here.where(F.col("relative") | F.col("name").isNotNull()).withColumn("last", F.last("name", ignorenulls=True).over(before)).where("relative")
    full = F.concat("last", "word")
    met = _looked_up(named, known.select("form", CURRENT, PUBLISHED, f"{CURRENT}_parameter", f"{PUBLISHED}_parameter"), "r_", T.sanitize(full))
    now, then = (_hit("r_", release, F.lit(""), full) for release in (CURRENT, PUBLISHED))
    again = _outcome(F.col("form"), F.col("word"), F.coalesce("own_now", now, "single_now"), F.coalesce("own_then", then, "single_then"), F.col("is_word"), F.col("typo"))
    relative = met.withColumn("again", again).withColumn("noted", F.when(F.col("again").isNotNull(), F.filter(F.array(F.struct(F.col("again.kind").alias("kind"), F.col("word"), F.col("again.note").alias("note"))), lambda x: x["kind"] != "known")).otherwise(F.col("noted")))
    counted = F.col("kind").isin("prior", "deprecated")
    said = lambda df: df.select("page_id", F.explode("noted").alias("x")).select("page_id", "x.kind", "x.note", F.when(F.col("x.kind").isin("prior", "deprecated"), "").otherwise(F.col("x.word")).alias("word"))
    # only a relative word can mean different things on one page; the note of any other is the word's own
    once = said(relative).groupBy("page_id", "kind", "word").agg(F.min("note").alias("note"), F.count("*").alias("n"))
    grouped = said(plain).withColumn("n", F.lit(1).cast("long")).unionByName(once).groupBy("page_id", "kind", "word", "note").agg(F.sum("n").alias("n"))
    return grouped.select("page_id", "kind", "word", F.when(counted, F.col("n").cast("string")).otherwise(F.col("note")).alias("note"))
