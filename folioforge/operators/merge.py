"""Keyed merges of column groups over versioned Parquet tables.

A batch is reduced to its last arrival a key (an aggregation with partial results, so a hot key costs one row a task),
then joined with the target on the key: one shuffle of each side. Values are chosen by the key's presence in the
batch, never by null, so that nulls and empty arrays overwrite. A table's rows lie in buckets by key; a merge rewrites
the buckets that its batch touches beside the old ones and publishes their log entry last, so readers never see half.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..sources.store import Folder

KEY = "oai_identifier"
_HEADER = [f.name for f in S.HEADER if f.name != KEY]
GROUPS = {"oai_dc": _HEADER + [f.name for f in S.NORMALISED] + list(S.DC_COLUMNS), "marcxml": _HEADER + [f.name for f in S.MARC_PAYLOAD]}
BOTH = "oai_dc+marcxml"


def last_arrivals(batch: DataFrame, columns: list[str], key: str = KEY, order: tuple[str, ...] = ("page_no", "pos")) -> DataFrame:
    """One row a key: the columns of the last arrival, and `_times`, how often the key came."""
    row = F.struct(*[F.col(c) for c in columns])
    return batch.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"), F.count("*").alias("_times")).select(key, "_row.*", "_times")


def _absent(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.ArrayType):
        return F.array().cast(field.dataType)
    return F.lit(None).cast(field.dataType)


def upsert(target: DataFrame, batch: DataFrame, prefix: str, now: datetime | Column) -> DataFrame:
    """The target after a batch of one harvest pass; only the pass's own column group changes."""
    if prefix not in GROUPS:
        raise ValueError(f"unknown prefix {prefix!r}")
    own = [c for c in GROUPS[prefix] if c in target.columns and c in batch.columns]
    new = last_arrivals(batch, own).select(F.col(KEY).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in own], "_times")
    both = target.withColumn("_old", F.lit(True)).join(new, F.col(KEY) == F.col("_key"), "full_outer")
    came, had = F.col("_key").isNotNull(), F.col("_old").isNotNull()
    now = F.lit(now)
    out = []
    for field in target.schema.fields:
        c = field.name
        if c == KEY:
            value = F.coalesce(F.col(KEY), F.col("_key"))
        elif c in own:
            value = F.when(came, F.col(f"_new_{c}")).otherwise(F.col(c))
        elif c == "metadata_prefix":
            # the first insert of a Dublin Core pass; any second write of the key flips it
            first = ~had & (F.col("_times") == 1) if prefix == "oai_dc" else F.lit(False)
            value = F.when(came, F.when(first, prefix).otherwise(BOTH)).otherwise(F.col(c))
        elif c == "last_harvested_at":
            value = F.when(came, now).otherwise(F.col(c))
        elif c == "updated_at":
            value = F.when(came, now).otherwise(F.col(c))
        elif c == "created_at":
            value = F.when(had, F.col(c)).otherwise(now)
        else:
            value = F.when(had, F.col(c)).otherwise(_absent(field))
        out.append(value.cast(field.dataType).alias(c))
    return both.select(*out)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds rows whose key isn't there yet, one a key; nulls are equal to each other."""
    names = target.columns
    fresh = rows.select(*names).dropDuplicates(key)
    cond = [fresh[k].eqNullSafe(target[k]) for k in key]
    return target.unionByName(fresh.join(target, cond, "left_anti").select(*names))


class KeyConflict(ValueError):
    """A row's key is already in the table."""


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Appends rows; raises KeyConflict if one of their keys is taken or comes twice."""
    if not rows.join(target, key, "left_semi").isEmpty() or not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise KeyConflict(key)
    return target.unionByName(rows.select(*target.columns))


class MissingValue(ValueError):
    """A row has no value where the table needs one."""


class VersionedTable:
    """A Parquet table as a log of small JSON entries and the folders that they name, in any store that Spark reaches.

    With a key, rows lie in `buckets` folders by a hash of the key, sorted by it: a merge reads and rewrites only the
    buckets that its batch touches, and a lookup of a key one of them. One writer at a time. A version is published by
    its log entry, written after its data; a batch id that the log holds isn't written again. Columns that the schema
    has gained since a folder was written read as their default, or null.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, buckets: int = 16, required: tuple[str, ...] = (), defaults: dict | None = None):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.buckets = buckets if key is not None else 1
        self.required, self.defaults = tuple(dict.fromkeys((*((key,) if key else ()), *required))), defaults or {}
        self._log = Folder(spark, f"{self.path}/log")

    def log(self) -> list[dict]:
        return [json.loads(self._log.read(n)) for n in self._log.names(".json")]

    def create(self) -> bool:
        """The table, empty, if it isn't there; else its columns are compared: more may be declared, none other."""
        log = self.log()
        if log:
            held = T.StructType.fromJson(log[-1]["schema"])
            for f in held.fields:
                if f.name not in self.schema.names or self.schema[f.name].dataType != f.dataType:
                    raise ValueError(f"column {f.name} of {self.path} can't change")
            return False
        self._publish({}, None, 1)
        return True

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self._spread())).cast("int") if self.key is not None else F.lit(0)

    def _spread(self) -> int:
        """Buckets of the table as it was made."""
        names = self._log.names(".json")
        return json.loads(self._log.read(names[-1]))["buckets"] if names else self.buckets

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])
        return found.select(*[F.coalesce(F.col(f.name), self.defaults[f.name].cast(f.dataType)).alias(f.name) if f.name in self.defaults else F.col(f.name) for f in self.schema.fields])

    def read(self) -> DataFrame:
        log = self.log()
        return self._of(sorted(log[-1]["folders"].values()) if log else [])

    def lookup(self, value) -> DataFrame:
        """The row of a key, from its bucket alone."""
        log = self.log()
        bucket = self.spark.range(1).select(F.lit(value).cast(self.schema[self.key].dataType).alias(self.key)).select(self._bucket()).head()[0]
        folder = log[-1]["folders"].get(str(bucket)) if log else None
        return self._of([folder] if folder else []).where(F.col(self.key) == F.lit(value))

    def publish(self, df: DataFrame, batch: str | None = None, **more) -> int:
        """Replaces all rows."""
        log = self.log()
        if batch is not None and any(e.get("batch") == batch for e in log):
            return log[-1]["version"]
        version = log[-1]["version"] + 1 if log else 1
        return self._publish(self._written(df, version), batch, version, **more)

    def merge(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None, **more) -> int:
        """change(old, rows) in place of the old rows of the buckets that rows touch; it must keep keys in their buckets."""
        log = self.log()
        if batch is not None and any(e.get("batch") == batch for e in log):
            return log[-1]["version"]
        version, held = (log[-1]["version"] + 1, dict(log[-1]["folders"])) if log else (1, {})
        touched = [str(r[0]) for r in rows.select(self._bucket()).distinct().collect()]
        old = self._of(sorted(held[b] for b in touched if b in held))
        new = self._written(change(old, rows), version)
        return self._publish({b: f for b, f in held.items() if b not in touched} | new, batch, version, **more)

    def _written(self, df: DataFrame, version: int) -> dict[str, str]:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        if self.key is None:
            df.write.mode("overwrite").parquet(f"{self.path}/v{version}/_b=0")
            return {"0": f"v{version}/_b=0"}
        dealt = df.withColumn("_b", self._bucket()).repartition("_b").sortWithinPartitions("_b", self.key)
        dealt.write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/v{version}")
        names = [n for n in Folder(self.spark, f"{self.path}/v{version}").names() if n.startswith("_b=")]
        folders = {n.removeprefix("_b="): f"v{version}/{n}" for n in names}
        self._checked(self._of(sorted(folders.values())))
        return folders

    def _checked(self, new: DataFrame) -> None:
        """Keys are unique and required values there: rows of a key share a bucket's files, so what is compared is what was written."""
        bad = new.groupBy(self.key).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{k}") for k, c in enumerate(self.required)])
        found = bad.agg(F.max(F.col("n") > 1), *[F.max(F.col(f"no_{k}") > 0) for k in range(len(self.required))]).head()
        for k, c in enumerate(self.required):
            if found[k + 1]:
                raise KeyConflict(c) if c == self.key else MissingValue(c)
        if found[0]:
            raise KeyConflict(self.key)

    def _publish(self, folders: dict[str, str], batch: str | None, version: int, **more) -> int:
        entry = {"version": version, "batch": batch, "buckets": self._spread(), "folders": folders, "schema": json.loads(self.schema.json()), **more}
        if not self._log.write(f"{version:012d}.json", json.dumps(entry, sort_keys=True).encode(), replace=False):
            raise RuntimeError(f"version {version} was published by another writer")
        return version
