"""Ranked search and record lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import normalize as N

LIMIT = 20
RESULT = "recid long, symbol string, title string, date string, datestamp string"
DETAIL_FIELDS = ("oai_identifier", "recid", "datestamp", "deleted", "metadata_prefix", "source_set", "source_url", "document_symbol", "title_primary", "publication_date_primary")


class InvalidArgument(ValueError):
    """A request's argument can't be read."""


def symbol_prefix(q: str, symbol: Column) -> Column:
    return symbol.ilike(N.ilike_pattern(q) + "%")


def title_contains(q: str, title: Column) -> Column:
    return title.ilike("%" + N.ilike_pattern(q) + "%")


def identifier_contains(q: str, identifiers: Column) -> Column:
    """Any identifier contains the query; a prefix match is one of these."""
    return F.exists(identifiers, lambda i: i.ilike("%" + N.ilike_pattern(q) + "%"))


def rank_of(q: str) -> Column:
    """0 for a symbol that begins with the query, 1 for an identifier (no URL) that does, else 2."""
    begins = N.ilike_pattern(q) + "%"
    named = F.exists(F.col("dc_identifier"), lambda i: ~i.rlike(N.URL) & i.ilike(begins))
    return F.when(F.col("document_symbol").ilike(begins), 0).when(named, 1).otherwise(2)


def matching(records: DataFrame, q: str) -> DataFrame:
    any_of = symbol_prefix(q, F.col("document_symbol")) | title_contains(q, F.col("title_primary")) | identifier_contains(q, F.col("dc_identifier"))
    return records.where(~F.col("deleted") & any_of)


def search(records: DataFrame, q: str | None, limit: int = LIMIT) -> DataFrame:
    """The best `limit` live records; none for a query of fewer than two characters.

    Ties of rank and datestamp go by recid, then oai_identifier.
    """
    q = (q or "").strip()
    if len(q) < 2:
        return records.sparkSession.createDataFrame([], RESULT)
    # what is shown is computed below the sort: two projections above it would keep the planner from a top-k
    shown = matching(records, q).select("recid", N.display_identifier(F.col("document_symbol"), F.col("dc_identifier")).alias("symbol"), N.clean_title(F.col("title_primary")).alias("title"), F.col("publication_date_primary").alias("date"), N.utc_text(F.col("datestamp")).alias("datestamp"), rank_of(q).alias("_rank"), F.col("datestamp").alias("_at"), F.col("oai_identifier").alias("_key"))
    best = shown.orderBy("_rank", F.desc_nulls_last("_at"), F.asc_nulls_last("recid"), "_key").limit(limit)
    return best.select("recid", "symbol", "title", "date", "datestamp")


def detail(records: DataFrame, recid: str | int) -> DataFrame:
    """The latest record of a number, deleted ones too; no row if there is none."""
    number = recid if isinstance(recid, int) else N.integer_prefix(recid)
    if number is None:
        raise InvalidArgument(f"not a record number: {recid!r}")
    one = records.where(F.col("recid") == number).orderBy(F.desc_nulls_last("datestamp"), "oai_identifier").limit(1)
    kept = [c for c in records.columns if c in DETAIL_FIELDS or c.startswith("dc_")]
    columns = [N.utc_text(F.col(c)).alias(c) if c == "datestamp" else F.col(c) for c in kept]
    payload = [F.col(f"marcxml_{k}").alias(f"metadata_{k}") for k in ("xml", "json") if f"marcxml_{k}" in records.columns]
    return one.select(*columns, *payload)


def unpivoted(records: DataFrame) -> DataFrame:
    """(oai_identifier, pos, key, value): each record's fields as text, in display order."""
    kinds = dict(records.dtypes)
    shown = [c for c in (*DETAIL_FIELDS, *S.DC_COLUMNS) if c in kinds]
    rows = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(c).alias("key"), N.render_value(F.col(c), kinds[c]).alias("value")) for k, c in enumerate(shown)])
    return records.select(F.col("oai_identifier").alias("record"), F.explode(rows).alias("r")).select(F.col("record").alias("oai_identifier"), "r.pos", "r.key", "r.value")


def labels(records: DataFrame) -> DataFrame:
    """What a result list shows: symbol or record number, title or what stands for it, date or the datestamp's day."""
    symbol = F.nullif(N.display_identifier(F.col("document_symbol"), F.col("dc_identifier")), F.lit(""))
    number = F.concat(F.lit("RECID "), F.col("recid").cast("string"))
    day = F.date_format("datestamp", "yyyy-MM-dd")
    return records.select("recid", F.coalesce(symbol, number).alias("label"), F.coalesce(symbol, N.clean_title(F.col("title_primary")), number).alias("heading"), F.coalesce(F.nullif(F.col("publication_date_primary"), F.lit("")), day).alias("shown_date"))


def audit_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"), F.count_if(~F.col("deleted")).alias("active"), F.count_if(F.col("deleted")).alias("deleted_count"))


def recent_active(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    return records.where(~F.col("deleted")).orderBy(F.desc_nulls_last("datestamp"), F.asc_nulls_last("recid"), "oai_identifier").limit(limit)
