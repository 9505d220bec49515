"""CSV in, one JSON array out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row; nulls are kept as null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_json_array(df: DataFrame, path: Path) -> None:
    """A single file, so rows pass through the driver, a partition at a time; for large results use df.write.json."""
    path.parent.mkdir(parents=True, exist_ok=True)
    rows: Iterator = json_rows(df).toLocalIterator()
    with path.open("w", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(rows):
            body = json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            f.write(("," if k else "") + "\n  " + body)
        f.write("\n]")
