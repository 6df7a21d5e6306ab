"""Schemas of the tables as DDL, and the domains of their coded columns.

Whole numbers, doubles, text and UTC timestamps; lists are arrays and are stored
as JSON text only at the edges (see `json_roundtrip`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

# fixed values: the tables with their columns and types; the first column is the key
TABLES: dict[str, str] = {
    "issues": """
        id INT NOT NULL, issue_key STRING NOT NULL, title STRING NOT NULL, issue_url STRING, project_id INT NOT NULL, project_key STRING NOT NULL,
        description STRING, summary STRING, type_name STRING, type_id INT, priority_name STRING, priority_id INT, status_name STRING, status_id INT,
        resolution_name STRING, resolution_id INT, assignee STRING, reporter STRING, created_at TIMESTAMP, updated_at TIMESTAMP, resolved_at TIMESTAMP,
        watches STRING, specification STRING, raised_in_version STRING, related_issues STRING, related_artifacts STRING, related_pages STRING,
        related_sections STRING, related_url STRING, resolution_description STRING, vote_date TIMESTAMP, vote_text STRING, work_group STRING
    """,
    "comments": "id INT NOT NULL, issue_id INT NOT NULL, issue_key STRING, author STRING, created_at TIMESTAMP, body STRING",
    "custom_fields": "id INT NOT NULL, issue_id INT NOT NULL, issue_key STRING, field_id STRING, field_key STRING, field_name STRING, field_value STRING",
    "lemmas": "inflection STRING NOT NULL, category STRING, lemma STRING",
    "issue_keywords": "id INT NOT NULL, issue_id INT NOT NULL, keyword STRING NOT NULL, keyword_count INT, keyword_type STRING, bm25_score DOUBLE",
    "corpus_keywords": "id INT NOT NULL, keyword STRING NOT NULL, keyword_count INT, keyword_type STRING, idf DOUBLE",
    "total_frequencies": "id INT NOT NULL, issue_id INT, total_words BIGINT, total_lemma_words BIGINT, total_stop_words BIGINT, total_paths BIGINT, total_operations BIGINT",
    "bm25_config": "id INT NOT NULL, k1 DOUBLE NOT NULL, b DOUBLE NOT NULL, last_updated TIMESTAMP",
    "document_stats": "id INT NOT NULL, average_length DOUBLE, documents BIGINT, last_calculated TIMESTAMP",
    "words": "word STRING NOT NULL",
    "typos": "typo STRING NOT NULL, correction STRING",
    "work_groups": "code STRING NOT NULL, title STRING, official_url STRING, replaced_by STRING, page_id STRING",
    "pages": """
        id INT NOT NULL, page_file_name STRING NOT NULL, artifact_id INT, work_group STRING, maturity INT, standard_status STRING, disposition STRING,
        incomplete_markers ARRAY<STRING>, reader_notes ARRAY<STRING>
    """,
    "page_images": "id INT NOT NULL, page_id INT NOT NULL, source STRING NOT NULL, missing_alt BOOLEAN, not_in_figure BOOLEAN",
    "page_removed_words": "id INT NOT NULL, page_id INT NOT NULL, word STRING NOT NULL, artifact_class STRING",
    "page_unknown_words": "id INT NOT NULL, page_id INT NOT NULL, word STRING NOT NULL, is_typo BOOLEAN",
    "artifacts": "id INT NOT NULL, fhir_id STRING NOT NULL, artifact_name STRING, artifact_type STRING, maturity INT, work_group STRING",
    "search_parameters": """
        param_key INT NOT NULL, package_key INT, param_id STRING, unversioned_url STRING, param_name STRING, param_version STRING, status_name STRING,
        work_group STRING, param_code STRING, base_resources STRING, search_type STRING, param_expression STRING, reference_targets STRING
    """,
}

# fixed values: the names coded columns may hold
DOMAINS: dict[str, tuple[str, ...]] = {
    "keyword_type": ("Word", "StopWord", "FhirElementPath", "FhirOperationName"),
    "disposition": ("Unknown", "CoreAsInformative", "CoreAsNormative", "MoveToGuide", "MoveToConfluence", "Remove"),
}


def in_domain(column: str, value: Column | None = None) -> Column:
    """Whether a coded column holds one of its names; null does."""
    col = F.col(column) if value is None else value
    return col.isNull() | col.isin(*DOMAINS[column])


def schema_of(table: str) -> S.StructType:
    """The schema of one table; needs a running session."""
    return S.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in order with their types; missing ones are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(table).fields])
