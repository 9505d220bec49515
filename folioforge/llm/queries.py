"""One query per corpus operator: it applies the operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import decontaminate, html_text, jaccard, media, pack, passages, quality, secrets, shard, toxicity


def op1_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.sharded(C.read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(C.read(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(C.read(spark, sf_dir, "pages"))


def op4_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(C.read(spark, sf_dir, "documents"))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op6_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op7_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark")).drop("items")


def op8_ngram_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(C.read(spark, sf_dir, "documents"))


def op9_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(C.read(spark, sf_dir, "documents"))


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(C.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_label_propagation_shards, op2_secret_scan, op3_html_main_text, op4_fuzzy_passages, op5_quality_scores, op6_toxicity_scores, op7_benchmark_contamination, op8_ngram_jaccard_components, op9_telephony_media, op10_cutting_stock_packing)}

#: Words of a text as the contracts of operators 7 and 8 define them.
_WORDS7 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op7_benchmark_contamination": f"""
with d as (select row_number() over () r, doc_id, {_WORDS7} w from documents),
i as (select item_id, {_WORDS7} w from benchmark where text is not null),
iw as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') g from (select item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) s from i where len(w) > 0)),
ns as (select distinct n from iw),
dw as (select r, n, s, array_to_string(w[s:s + n - 1], ' ') g from (select r, w, n, unnest(range(1, len(w) - n + 2)) s from d, ns where len(w) >= n)),
m as (select dw.r, dw.s, dw.n, iw.item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
hits as (select r, count(distinct p) n_hit from (select r, unnest(range(s, s + n)) p from (select distinct r, s, n from m)) group by r),
its as (select r, list_sort(list(distinct cast(item_id as varchar))) ids from m group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(cast(len(ids) as bigint), 0) n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (r) left join its using (r)""",
}
