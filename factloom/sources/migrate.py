"""Bringing tables of earlier schema versions to the current one; newer ones are never lowered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import entity_key
from factloom.schema import SCHEMA_VERSION

#: What a column that an earlier version lacks is filled with.
DEFAULTS = {"tier": "hot", "record_kind": "fact", "access_count": 0, "is_inference": 0, "salience": 0.0}


def upgrade(facts: DataFrame, entities: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Version 1 added the tier, 2 the kind of record, 3 the folded names of entities. Split entities aren't merged."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"schema {version} is newer than {SCHEMA_VERSION}")
    for name, value in DEFAULTS.items():
        facts = facts.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in facts.columns else F.lit(value))
    if version < 3 or "name_key" not in entities.columns:
        entities = entities.withColumn("name_key", entity_key("name"))
    return facts, entities
