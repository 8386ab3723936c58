"""Declared schemas of the model tables, as DDL. Governance columns are nullable; defaults are applied in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


EPISODE = "uuid string, name string, content string, source_description string, source string, group_id string, created_at timestamp, valid_at timestamp, entity_edges array<string>, kind string, kind_confidence double, provenance string, verified boolean, durability string, origin_device string, origin_tool string, origin_project string, usage_count bigint, retrieval_count bigint, last_used_at timestamp, scope string, archived boolean, archived_at timestamp, visibility string, predigest string"
ENTITY = "uuid string, name string, labels array<string>, summary string"
FACT = "edge_id bigint, src string, dst string, name string, fact string, valid_at timestamp, invalid_at timestamp, created_at timestamp, expired_at timestamp, episodes array<string>, fact_embedding array<float>"
MENTION = "episode_uuid string, entity_uuid string"
INGEST_KEY = "source_description string, source_obs_id string, episode_uuid string, status string, created_at timestamp, updated_at timestamp, created_by_request string, nodes int, edges int, error_message string"
QUARANTINE = "source_obs_id string, name string, content string, source_description string, reason string, created_at timestamp"
FEEDBACK = "id string, episode_name string, verdict string, query string, status string, report_count bigint, note string, tool string, replacement_name string, created_at timestamp, updated_at timestamp"
OBSERVATION = "id bigint, project string, type string, title string, narrative string, facts string, concepts string, files_modified string, relevance_count int, generated_by_model string, memory_session_id string, created_at_epoch bigint"
SNAPSHOT = "host string, generated_at timestamp, received_at timestamp, overall string, nodes array<struct<id:string,light:string>>, edges array<struct<src:string,dst:string>>, blockers array<struct<label:string,detail:string>>"
DECISION = "ts string, accept boolean, would_accept boolean, score double, threshold double, reasons array<string>, layer string, obs_id bigint, obs_type string, platform string, project string, shadow_mode boolean, score_breakdown map<string,double>"
DELIVERY = "ts string, endpoint string, kw string, tiering boolean, picked array<struct<name:string,type:string>>"
USAGE_EVENT = "key string, kind string, ts timestamp"

DEFAULTS = {"archived": False, "verified": False, "usage_count": 0, "retrieval_count": 0, "source_description": "", "content": "", "scope": "", "predigest": ""}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Nulls of the columns that have a default replaced, once."""
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in rows.columns})
