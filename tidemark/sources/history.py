"""Daily histories landed as nested JSON documents."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import parse_iso_date
from tidemark.operators.frames import rename_columns, start_from
from tidemark.settings import HISTORY_FIELDS, START_DATE

_ROW = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in HISTORY_FIELDS]
)
# Fields that the schema does not name are skipped by the reader.
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField(
            "stats",
            T.ArrayType(
                T.StructType(
                    [T.StructField("data", T.StructType([T.StructField("history", T.ArrayType(_ROW))]))]
                )
            ),
        )
    ]
)


def explode_history(documents: DataFrame, stats: Column, entity: str = "entity") -> DataFrame:
    """One row per reported day from documents' `stats` array, fields renamed, dates parsed.

    A document without a history, such as the reply to a failed request, is an error;
    one whose history has no days is not.
    """
    missing = F.raise_error(F.concat_ws(" ", F.lit("document without history of"), F.col(entity)))
    days = F.coalesce(F.get(stats, F.lit(0))["data"]["history"], missing)
    rows = documents.select(entity, F.explode(days).alias("h"))
    flat = rename_columns(rows.select(entity, "h.*"), HISTORY_FIELDS)
    days = parse_iso_date(F.col("date")).alias("date")
    return flat.select(days, entity, *HISTORY_FIELDS.values())


def parse_history(documents: DataFrame, text: str, entity: str = "entity") -> DataFrame:
    """Histories from documents held as JSON text in column `text`. Text that is no such document is an error."""
    parsed = documents.select(entity, F.from_json(text, HISTORY_SCHEMA, {"mode": "FAILFAST"}).alias("doc"))
    return explode_history(parsed, F.col("doc.stats"), entity)


def read_history(
    spark: SparkSession,
    path: str,
    first_day: str = START_DATE,
    entity: str = "entity",
    entities: Collection[str] | None = None,
) -> DataFrame:
    """Histories from `path/entity=<name>/*.json`, from `first_day` on.

    The name comes from the folder, as text also where it looks like a number. Given
    `entities`, only their folders are read. Documents that are cut off, or hold text
    where a number belongs, are errors.
    """
    schema = T.StructType([*HISTORY_SCHEMA.fields, T.StructField(entity, T.StringType())])
    documents = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if entities is not None:
        documents = documents.where(F.col(entity).isin(list(entities)))
    return start_from(explode_history(documents, F.col("stats"), entity), first_day)
