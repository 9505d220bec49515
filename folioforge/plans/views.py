"""Record and account tables derived from the test tables, in Spark and in DuckDB SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-15 00:00:00"

_RECORDS = """
select concat('oai:', source, ':', doc_id) oai_identifier, doc_id recid, {stamp} datestamp, doc_id % 17 = 0 deleted,
  source source_set,
  case when doc_id % 3 = 0 then concat('A/RES/', doc_id % 80, '/', doc_id) when doc_id % 3 = 1 then '' end document_symbol,
  concat(substring(text, 1, 60), ' : ') title_primary,
  case when doc_id % 4 <> 0 then cast(1990 + doc_id % 35 as {text}) end publication_date_primary,
  case when doc_id % 5 = 0 then {a}concat('https://x.example/', doc_id){z}
       else {a}concat('https://x.example/', doc_id), concat('E/DEC/', doc_id){z} end dc_identifier,
  case when doc_id % 17 = 0 then cast({a}{z} as {texts}) else {a}lang, source{z} end dc_subject
from documents"""
RECORDS = _RECORDS.format(stamp="timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, cast((doc_id * 7919) % 1000 as int))", text="string", texts="array<string>", a="array(", z=")")
RECORDS_SQL = _RECORDS.format(stamp="timestamp '2025-01-01 00:00:00' + to_hours(((doc_id * 7919) % 1000)::int)", text="varchar", texts="varchar[]", a="[", z="]")
TOKENS = "select concat('tok', event_id) token, concat('user', user_id, '@d', user_id % 7, '.org') email, ts + interval '15' minute expires_at, case when event_type = 'purchase' then ts end used_at from events"
USERS = "select c_custkey id, concat('user', c_custkey, '@d', c_custkey % 7, '.org') email, case when c_custkey % 4 = 0 then '' when c_custkey % 4 = 1 then null else c_mktsegment end entity from customer"
DOMAINS = "select n_name entity, concat('d', n_regionkey, '.org') domain from nation"
ENTITIES = "select n_name entity, case when n_nationkey % 3 <> 0 then concat(n_name, ' of region ', n_regionkey) else '' end entity_long from nation"
_USED = {"RECORDS": ("documents",), "TOKENS": ("events",), "USERS": ("customer",), "DOMAINS": ("nation",), "ENTITIES": ("nation",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _USED[name]}
    text = globals()[name]
    for t in tables:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **tables)
