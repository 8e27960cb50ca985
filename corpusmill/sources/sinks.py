"""Writing results, keyed by what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.files import _table_or_none


def cache_key(*inputs) -> str:
    """Key of all inputs of a step."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()


def cache_it(folder: str, key: str, df: DataFrame) -> None:
    """K3: a table under its key."""
    df.write.mode("overwrite").parquet(f"{folder}/{key}")


def get_it(spark: SparkSession, folder: str, key: str) -> tuple[bool, DataFrame | None]:
    """(found, table)."""
    df = _table_or_none(spark, f"{folder}/{key}")
    return df is not None, df


def save_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each table as parquet under its name; the rows that can be read back."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return {name: df.sparkSession.read.parquet(f"{folder}/{name}").count() for name, df in tables.items()}


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def save_model(model, path: str) -> None:
    """K5."""
    model.write().overwrite().save(path)


def text_dump(df: DataFrame, path: str, text: str = "text") -> None:
    """K1: a line a text."""
    df.select(text).write.mode("overwrite").text(path)
