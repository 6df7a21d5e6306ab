"""Derived tables are written once, follow their sources, and take the filters of the queries."""

from __future__ import annotations

import os
import shutil

import pytest

from tallyloom import session
from tallyloom.plans import catalogue, tables


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["filter_eq", "date_filter", "list_issues", "filter_ci_prefix", "lookup_single"])
def test_filters_reach_the_files(spark, sf_dir, name):
    text = plan(catalogue.queries()[name](spark, sf_dir))
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    assert name == "filter_ci_prefix" or any(line.strip() not in ("PushedFilters: []", "PushedFilters:") for line in pushed)
    assert "Window" not in text or name != "filter_eq"


@pytest.mark.parametrize("name", ["bm25_search", "fts_search", "fts_match", "search_statistics"])
def test_searches_tokenise_nothing(spark, sf_dir, name):
    text = plan(catalogue.queries()[name](spark, sf_dir))
    assert "regexp_extract_all" not in text and "posexplode" not in text
    assert "In(keyword" in text or "In(term" in text or "StringStartsWith(term" in text or "EqualTo(term" in text


def test_stored_tables_follow_their_sources(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/issues.parquet", tmp_path / "issues.parquet")
    first = tables.issues(spark, str(tmp_path))
    n = first.count()
    assert tables.issues(spark, str(tmp_path)).inputFiles() == first.inputFiles()
    half = spark.read.parquet(f"{sf_dir}/issues.parquet").orderBy("id").limit(5)
    os.remove(tmp_path / "issues.parquet")
    half.write.parquet(str(tmp_path / "issues.parquet"))
    assert tables.issues(spark, str(tmp_path)).count() <= 5 < n


def test_tables_kept_for_later_applications(spark, sf_dir, tmp_path, monkeypatch):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    spark.conf.set("spark.tallyloom.store", str(tmp_path))
    try:
        for _ in range(2):
            monkeypatch.setattr(session, "_STORED", {})  # as another application would find it
            assert session.stored(spark, sf_dir, "three", ["issues"], build).count() == 3
        assert built == [1]
        next(p for p in tmp_path.rglob("_SUCCESS")).unlink()  # died half-way
        monkeypatch.setattr(session, "_STORED", {})
        assert session.stored(spark, sf_dir, "three", ["issues"], build).count() == 3
        assert built == [1, 1]
    finally:
        spark.conf.unset("spark.tallyloom.store")


def test_masters_without_a_shared_disk():
    assert session.is_local("local") and session.is_local("local[8]") and session.is_local("local[*, 3]")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://host:7077") and not session.is_local("yarn")


def test_checkpoint_folder_is_required_on_clusters(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
