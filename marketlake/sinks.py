"""Rows as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.functions.scalars import iso_timestamp


def to_api_json(df: DataFrame) -> DataFrame:
    """One JSON object per row in column order, timestamps in ISO-8601, nulls kept."""
    shown = [
        iso_timestamp(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema
    ]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value"))
