"""The registered queries over the smallest tables, against SQL where there is some."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tallyloom.llm.queries import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, registry.queries[name], registry.sql[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries) - set(registry.sql)))
def test_runs(spark, sf_dir, name):
    registry.queries[name](spark, sf_dir).collect()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p1_found", "keyword string, keyword_type string, freq_mark string"),
        ("p3_found", "issue_id int, keyword_id int, top_no int"),
        ("p5_found", "table_name string, row_id int, pii_type string, pii_key string"),
        ("p7_found", "doc_id bigint, item_id int"),
        ("p8_found", "doc_id bigint, reading_band string"),
    ],
)
def test_columns(spark, sf_dir, name, columns):
    df = registry.queries[name](spark, sf_dir)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
    assert df.count() == df.distinct().count()


def test_every_document_is_packed_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    whole = registry.queries["p6_packed"](spark, sf_dir).where("piece_no = 0")
    assert whole.count() == docs == whole.select("doc_id").distinct().count()
