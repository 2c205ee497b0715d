"""Fact tables, vocabularies and identity expressions of a repository snapshot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabularies of the data model.
SYMBOL_KINDS = ("class", "method", "function", "interface", "endpoint", "type", "enum", "variable")
EDGE_TYPES = (
    "CONTAINS", "IMPORTS", "CALLS", "IMPLEMENTS", "EXTENDS", "READS_FROM", "WRITES_TO", "EMITS", "CONSUMES",
    "TESTED_BY", "DEPENDS_ON", "VIOLATES", "SUPERSEDES", "DOCUMENTED_BY",
)
SEVERITIES = ("info", "low", "medium", "high", "critical")
SUMMARY_LEVELS = ("symbol", "file", "module", "repository")
FINDING_STATUS = ("candidate", "confirmed", "rejected")

VERSION = 1


_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "doubles": T.ArrayType(T.DoubleType())}


def _table(text: str) -> T.StructType:
    pairs = (c.split() for c in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "repositories": _table("id string, name string, root_path string, created_at timestamp"),
    "snapshots": _table("id string, repository_id string, commit_sha string, created_at timestamp"),
    "files": _table(
        "id string, repository_id string, snapshot_id string, path string, language string, content_hash string, line_count int, "
        "last_author string, last_commit_at string"
    ),
    "modules": _table("id string, repository_id string, snapshot_id string, name string, path string"),
    "symbols": _table(
        "id string, repository_id string, snapshot_id string, path string, qualified_name string, kind string, signature string, "
        "start_line int, end_line int, content_hash string, source string"
    ),
    "edges": _table("snapshot_id string, source_id string, target_id string, edge_type string, confidence double, analyzer string, evidence_json string"),
    "metrics": _table("snapshot_id string, subject_id string, name string, value double, analyzer string"),
    "tests": _table("id string, snapshot_id string, path string, name string"),
    "coverage": _table("snapshot_id string, path string, line_rate double, branch_rate double"),
    "findings": _table(
        "id string, repository_id string, snapshot_id string, policy_id string, severity string, confidence double, claim string, "
        "recommendation string, module string, status string, superseded_by string, created_at timestamp"
    ),
    "evidence": _table("id string, owner_id string, owner_kind string, path string, start_line int, end_line int, excerpt string"),
    "summaries": _table(
        "id string, snapshot_id string, subject_id string, level string, content_json string, model string, prompt_version string, "
        "content_hash string, created_at timestamp"
    ),
    "vectors": _table("id string, snapshot_id string, point_id string, text_hash string, model string, vector doubles"),
    "opportunities": _table("id string, snapshot_id string, title string, detail_json string, created_at timestamp"),
    "analysis_runs": _table(
        "id string, snapshot_id string, kind string, model string, cache_key string, status string, started_at timestamp, finished_at timestamp, "
        "input_tokens long, output_tokens long"
    ),
}


# --- identity ----------------------------------------------------------------------


def clean_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "")


def symbol_id(repository: Column, path: Column, kind: Column, name: Column, signature: Column) -> Column:
    """Stable under moves within a file; a missing and a null signature are the same."""
    parts = F.concat_ws("\n", repository, clean_path(path), kind, name, F.coalesce(signature, F.lit("")))
    return F.concat(F.lit("sym_"), F.substring(F.sha2(parts, 256), 1, 32))


def repository_id(name: Column) -> Column:
    return F.concat(F.lit("repo_"), F.substring(F.sha2(name, 256), 1, 16))


def test_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("test_"), F.substring(F.sha2(F.concat(path, F.lit("\n"), name), 256), 1, 24))


def file_uri(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("repo://"), repository, F.lit("/"), clean_path(path))


def symbol_uri(repository: Column, path: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol://"), repository, F.lit("/"), clean_path(path), F.lit("#"), name)


def module_uri(repository: Column, directory: Column) -> Column:
    return F.concat(F.lit("module://"), repository, F.lit("/"), F.when(directory == ".", "root").otherwise(directory))


def point_id(symbol: Column) -> Column:
    """A symbol id as a UUID: 32 hex digits, padded with zeros, in groups of 8-4-4-4-12."""
    x = F.substring(F.rpad(F.regexp_replace(symbol, "^sym_", ""), 32, "0"), 1, 32)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(x, a, n) for a, n in cuts])
