"""The tables of the fact spine. Times are epoch milliseconds (LONG); nothing is deleted, state is appended events."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<float>": T.ArrayType(T.FloatType())}


def _struct(spec: str) -> T.StructType:
    """Columns from "name type, ..."; unlike Spark's own parser this needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in spec.split(", "))])


EPISODE = _struct("id string, namespace string, raw string, source string, t_ref long, created_at long, seq long")
ENTITY = _struct("id string, namespace string, name string, type string, name_key string, created_at long")
FACT_ASSERT = _struct(
    "id string, seq long, namespace string, subject_id string, predicate string, object_literal string, fact_text string, "
    "episode_id string, valid_at long, ingested_at long, confidence double, salience double, is_inference int, "
    "record_kind string, embedding array<float>, coarse array<float>"
)
#: kinds: supersede, cascade_close, retire_duplicate, invalidate, tier, usage_merge, touch, repoint
FACT_EVENT = _struct("seq long, fact_id string, kind string, at_ms long, ref_id string, val string")
POSTING = _struct("namespace string, term string, fact_id string, tf int, size int")
DERIVATION = _struct("summary_id string, source_id string")
RUN = _struct("id string, namespace string, started_at long, heartbeat_at long, finished_at long, status string, cursor long, stats_json string")
PROPOSAL = _struct("id string, run_id string, namespace string, kind string, payload_json string, created_at long, expires_at long, evidence_backend string")
DECISION = _struct("seq long, proposal_id string, status string, reason string, decided_at long, applied_at long")
EVENT = _struct("id string, namespace string, ts long, kind string, duration_ms double, payload string")

#: Kinds of relation between a new fact and its slot.
RELATIONS = ("asserts", "supersedes", "extends", "derives")
SCHEMA_VERSION = 3
MS_PER_DAY = 86_400_000
