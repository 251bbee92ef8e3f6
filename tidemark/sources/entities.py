"""The entities that are tracked."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from tidemark.settings import ENTITIES


def entity_table(spark: SparkSession, entities: Collection[str] = ENTITIES) -> DataFrame:
    """The names of the entities, one row each."""
    return spark.createDataFrame([(name,) for name in dict.fromkeys(entities)], "entity string")
