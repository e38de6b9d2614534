"""Typed scans of the five tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlake.schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan with the declared schema. ``jdbc`` takes its columns from the database and needs ``options``."""
    schema = TABLES[name]
    if fmt == "jdbc":
        rows = spark.read.format("jdbc").options(dbtable=path, **options).load()
        return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema])
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def write_table(df: DataFrame, name: str, path: str, mode: str = "append") -> None:
    schema = TABLES[name]
    df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema]).write.mode(mode).parquet(path)
