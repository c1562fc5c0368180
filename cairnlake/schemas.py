"""Declared schemas of the evidence and material tables, their identities and layouts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "1.0.0"


@dataclass(frozen=True)
class Table:
    """A table of the lake: ``ddl``, the columns that identify a row, and those by which its files are sorted."""

    name: str
    ddl: str
    identity: tuple[str, ...]
    sort: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


EVIDENCE = (
    Table("visits", "visit_id string not null, requested_url string not null, effective_url string, admitted_at timestamp not null, started_at timestamp, observed_at timestamp, finished_at timestamp not null, outcome string not null, status_code int, document_id string, capture_policy string", ("visit_id",), ("requested_url", "finished_at", "visit_id")),
    Table("attempts", "attempt_id string not null, visit_id string not null, attempt_index int not null, resource_usage string, started_at timestamp not null, finished_at timestamp, effective_url string, status_code int, outcome string not null, failure_stage string, failure_code string, failure_message string", ("attempt_id",), ("visit_id", "attempt_index")),
    Table("steps", "attempt_id string not null, step_index int not null, action string not null, parameters string not null, started_at timestamp not null, duration_ms bigint not null, outcome string not null, stopping_reason string, error_code string, error_message string", ("attempt_id", "step_index"), ("attempt_id", "step_index")),
    Table("documents", "document_id string not null, visit_id string not null, attempt_id string, observed_at timestamp not null, representation string not null, declared_media_type string, detected_media_type string not null, charset string, content_sha256 string not null, content_bytes bigint not null, object_key string not null, storage_encoding string not null, stored_bytes bigint not null", ("document_id",), ("content_sha256", "observed_at", "document_id")),
    Table("collections", "record_id string not null, recorded_at timestamp not null, collection_id string not null, specification string not null", ("record_id",), ("recorded_at", "record_id")),
    Table("collection_outcomes", "record_id string not null, recorded_at timestamp not null, collection_id string not null, outcome string not null, seed_provenance string, consumed_pages bigint not null, supplied_pages bigint not null, failed_pages bigint not null", ("record_id",), ("recorded_at", "record_id")),
    Table("fulfillments", "record_id string not null, recorded_at timestamp not null, collection_id string not null, observation_id string not null, requested_url string not null, parent_observation_id string, depth int not null, rule_id string not null, mode string not null", ("record_id",), ("recorded_at", "record_id")),
    Table("acquisition_reasons", "record_id string not null, recorded_at timestamp not null, observation_id string not null, collection_id string not null, parent_observation_id string, reason string not null, policy_version string not null, rule_id string not null", ("record_id",), ("recorded_at", "record_id")),
)
MATERIAL = (
    Table("html_elements", "content_sha256 string not null, node_index int not null, parent_index int, subtree_end_index int not null, sibling_index int not null, depth int not null, tag string not null, namespace string, attributes map<string,string> not null, text_direct string not null, text string not null, text_start bigint not null, text_end bigint not null", ("content_sha256", "node_index"), ("content_sha256", "node_index")),
    Table("html_terms", "term string not null, content_sha256 string not null, node_indexes array<int> not null", ("term", "content_sha256"), ("term", "content_sha256")),
    Table("html_jsonld", "content_sha256 string not null, node_index int not null, value string, parse_error string", ("content_sha256", "node_index"), ("content_sha256", "node_index")),
    Table("link_occurrences", "occurrence_id string not null, link_id string not null, visit_id string not null, document_id string not null, content_sha256 string not null, element_index int not null, observed_at timestamp not null, raw_href string not null, source_url string not null, target_url string not null, relation_scope string not null", ("occurrence_id",), ("source_url", "target_url", "observed_at", "occurrence_id")),
    Table("visit_readiness", "visit_id string not null, finished_at timestamp not null", ("visit_id",), ("visit_id",)),
)
TABLES = {t.name: t for t in (*EVIDENCE, *MATERIAL)}


def digest() -> str:
    """A fingerprint of all declared schemas and layouts, by which generations are fenced."""
    return hashlib.sha256("\n".join(map(repr, TABLES.values())).encode()).hexdigest()


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a declared table by name and type; a missing or surplus column is an error."""
    want = TABLES[name].schema
    missing, surplus = set(want.names) - set(df.columns), set(df.columns) - set(want.names)
    if missing or surplus:
        raise ValueError(f"{name}: missing {sorted(missing)}, surplus {sorted(surplus)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want.fields])


def null_violation(name: str) -> Column:
    """Whether a row has a null in a column that must not be null."""
    return F.expr(" OR ".join(f"`{f.name}` IS NULL" for f in TABLES[name].schema.fields if not f.nullable))
