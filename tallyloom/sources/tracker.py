"""Reader of tracker exports (XML) and the days a download covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tallyloom.functions import text as T


def _text(name: str, *attributes: str) -> S.StructField:
    """An element with text and attributes; an element without attributes is a string."""
    if not attributes:
        return S.StructField(name, S.StringType())
    return S.StructField(name, S.StructType([S.StructField("_VALUE", S.StringType()), *[S.StructField(f"_{a}", S.StringType()) for a in attributes]]))


#: Explicit, since an inferred schema is a struct for one comment and an array for two.
ITEM_SCHEMA = S.StructType(
    [
        _text("title"), _text("link"), _text("project", "id", "key"), _text("description"), _text("key", "id"), _text("summary"),
        _text("type", "id"), _text("priority", "id"), _text("status", "id"), _text("resolution", "id"), _text("assignee", "username"), _text("reporter", "username"),
        _text("created"), _text("updated"), _text("resolved"), _text("watches"),
        S.StructField("comments", S.StructType([S.StructField("comment", S.ArrayType(_text("comment", "id", "author", "created").dataType))])),
        S.StructField("customfields", S.StructType([S.StructField("customfield", S.ArrayType(S.StructType([
            S.StructField("_id", S.StringType()), S.StructField("_key", S.StringType()), S.StructField("customfieldname", S.StringType()),
            S.StructField("customfieldvalues", S.StructType([S.StructField("customfieldvalue", S.ArrayType(_text("customfieldvalue", "key").dataType))])),
        ])))])),
        S.StructField("_corrupt", S.StringType()),
    ]
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of all *.xml files below a path, with file name; broken items are dropped."""
    raw = spark.read.format("xml").options(rowTag="item", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", recursiveFileLookup="true", pathGlobFilter="*.xml", ignoreCorruptFiles="true").schema(ITEM_SCHEMA).load(path)
    return raw.withColumn("file", F.input_file_name()).where("_corrupt IS NULL AND key._VALUE IS NOT NULL").drop("_corrupt")


def issues_of(items: DataFrame) -> DataFrame:
    project = F.col("project._key")
    return items.select(
        F.col("key._id").cast("int").alias("id"),
        F.col("key._VALUE").alias("issue_key"),
        T.title_without_key(F.col("title"), project).alias("title"),
        F.col("link").alias("issue_url"),
        F.col("project._id").cast("int").alias("project_id"),
        project.alias("project_key"),
        F.col("description"),
        F.col("summary"),
        F.col("type._VALUE").alias("type_name"),
        F.col("type._id").cast("int").alias("type_id"),
        F.col("priority._VALUE").alias("priority_name"),
        F.col("priority._id").cast("int").alias("priority_id"),
        F.col("status._VALUE").alias("status_name"),
        F.col("status._id").cast("int").alias("status_id"),
        F.coalesce("resolution._VALUE", F.lit("Unresolved")).alias("resolution_name"),
        F.coalesce(F.col("resolution._id").cast("int"), F.lit(-1)).alias("resolution_id"),
        F.col("assignee._username").alias("assignee"),
        F.col("reporter._username").alias("reporter"),
        T.parse_date(F.col("created")).alias("created_at"),
        T.parse_date(F.col("updated")).alias("updated_at"),
        T.parse_date(F.col("resolved")).alias("resolved_at"),
        T.watches(F.col("watches")).alias("watches"),
        "file",
    )


def comments_of(items: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Comments; one without a readable date gets `fallback` (now, if none is given)."""
    each = items.select(F.col("key._id").cast("int").alias("issue_id"), F.col("key._VALUE").alias("issue_key"), F.explode("comments.comment").alias("c"))
    created = F.coalesce(T.parse_date(F.col("c._created")), fallback if fallback is not None else F.current_timestamp())
    return each.select(F.col("c._id").cast("int").alias("id"), "issue_id", "issue_key", F.col("c._author").alias("author"), created.alias("created_at"), F.col("c._VALUE").alias("body"))


def fields_of(items: DataFrame) -> DataFrame:
    """Key/value fields in their order in the item; several values become one text."""
    each = items.select(F.col("key._id").cast("int").alias("issue_id"), F.col("key._VALUE").alias("issue_key"), F.posexplode("customfields.customfield").alias("place", "f"))
    values = F.transform("f.customfieldvalues.customfieldvalue", lambda v: F.coalesce(v["_VALUE"], v["_key"]))
    return each.select("issue_id", "issue_key", "place", F.col("f._id").alias("field_id"), F.col("f._key").alias("field_key"), F.col("f.customfieldname").alias("field_name"), T.join_values(F.array_compact(values)).alias("field_value"))


def day_ranges(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day, query_text, span_days) of every day from first to last."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    text = F.concat(F.lit("created >= "), F.date_format("day", "yyyy-MM-dd"), F.lit(" AND created < "), F.date_format(F.date_add("day", 1), "yyyy-MM-dd"))
    return days.select("day", text.alias("query_text"), T.days_inclusive(F.lit(first).cast("date"), F.lit(last).cast("date")).alias("span_days"))


def usable_download(content: Column) -> Column:
    """Whether downloaded text may be kept: neither blank nor other than markup."""
    return F.coalesce(F.startswith(F.ltrim(F.regexp_replace(content, "^\\uFEFF", "")), F.lit("<")), F.lit(False))


def manifest(downloads: DataFrame) -> DataFrame:
    """One row: counts, success share and bytes of (ok boolean, size long) rows."""
    return downloads.agg(F.count("*").alias("attempts"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.try_divide(F.count_if("ok") * 100.0, F.count("*")).alias("success_percent"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
