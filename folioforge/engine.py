"""The tables in one place: made if they aren't there, read as views, asked with parameterised SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import merge

#: Name, schema, key, columns that need a value, defaults of columns that a folder doesn't hold yet, whether it is large.
TABLES = {
    "documents": (S.DOCUMENTS, merge.KEY, ("datestamp", "deleted", "metadata_prefix", *S.DC_COLUMNS, "last_harvested_at", "created_at", "updated_at"), {c: F.array for c in S.DC_COLUMNS} | {"deleted": lambda: F.lit(False), "metadata_prefix": lambda: F.lit("oai_dc")}, True),
    "users": (S.USERS, "email", ("id",), {}, False),
    "magic_tokens": (S.TOKENS, "token", ("email", "expires_at"), {}, False),
    "allowed_domains": (S.DOMAINS, None, ("entity", "domain"), {}, False),
    "entities": (S.ENTITIES, None, (), {}, False),
}
_QUOTED_OR_NUMBER = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|\$([0-9]+)")


def bound(spark: SparkSession, text: str, params: list | tuple = ()) -> DataFrame:
    """SQL with $1, $2, ... standing for params; values are bound, never put into the text."""
    args = {f"p{k}": v for k, v in enumerate(params, 1)}

    def named(m: re.Match) -> str:
        if m[1] is not None and f"p{m[1]}" not in args:
            raise ValueError(f"there is no parameter ${m[1]}")
        return m[0] if m[1] is None else f":p{m[1]}"

    return spark.sql(_QUOTED_OR_NUMBER.sub(named, text), args=args)


class Engine:
    """Record and account tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {}
        for name, (schema, key, required, defaults, large) in TABLES.items():
            self.tables[name] = merge.VersionedTable(spark, f"{self.root}/{name}", schema, key, buckets if large else 1, required, {c: f() for c, f in defaults.items()})

    def create(self) -> None:
        """All tables, if they aren't there; the allowed domains are seeded, those that are there stay."""
        for table in self.tables.values():
            table.create()
        domains = self.tables["allowed_domains"]
        seeds = self.spark.createDataFrame(list(S.ALLOWED_DOMAINS), S.DOMAINS)
        domains.publish(merge.insert_ignore(domains.read(), seeds, ["entity", "domain"]), batch="seed")

    def table(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def query(self, text: str, params: list | tuple = ()) -> DataFrame:
        """bound() SQL over the tables by name."""
        for name in self.tables:
            if re.search(rf"\b{name}\b", text, re.I):
                self.table(name).createOrReplaceTempView(name)
        return bound(self.spark, text, params)
