"""The registered queries of the record engine and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from .. import schema as S
from ..functions import normalize as N
from ..operators import accounts as A
from ..operators import merge as M
from ..operators import search as R
from ..sources import files, pages
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CLOCK = datetime.fromisoformat(V.NOW)
_NOW_SQL = f"timestamp '{V.NOW}'"
_AT = "strftime(datestamp, '%Y-%m-%d %H:%M:%S') || '+00'"
_SHOWN = "coalesce(nullif(document_symbol, ''), list_filter(dc_identifier, lambda i: not regexp_matches(i, '^https?://'))[1])"
_TITLE = "nullif(trim(regexp_replace(title_primary, '\\s*:\\s*$', '')), '')"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bib(sql: str) -> str:
    return f"with bib as ({V.RECORDS_SQL}) {sql}"


def _now() -> F.Column:
    return F.lit(V.NOW).cast("timestamp_ntz")


def _ranked(q: str) -> str:
    hit = f"document_symbol ilike '{q}%' or title_primary ilike '%{q}%' or len(list_filter(dc_identifier, lambda i: i ilike '%{q}%')) > 0"
    rank = f"case when document_symbol ilike '{q}%' then 0 when len(list_filter(dc_identifier, lambda i: not regexp_matches(i, '^https?://') and i ilike '{q}%')) > 0 then 1 else 2 end"
    return _bib(f"select recid, {_SHOWN} symbol, {_TITLE} title, publication_date_primary date, {_AT} datestamp from bib where not deleted and ({hit}) order by {rank}, bib.datestamp desc nulls last, recid, oai_identifier limit 20")


def _search(name: str, q: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.search(V.view(spark, sf_dir, "RECORDS"), q)

    run.__name__ = name
    query(_ranked(q))(run)


for _name, _q in (("search_ranked", "a/res/1"), ("search_ranked_title", "the"), ("search_ranked_identifier", "E/DEC/4"), ("search_ranked_wildcard", "a_res%7"), ("search_ranked_none", "zzzz no such record")):
    _search(_name, _q)


@query(_bib("select recid from bib where document_symbol ilike 'a/res/2%'"))
def search_symbol_prefix(spark, sf_dir):
    return V.view(spark, sf_dir, "RECORDS").where(R.symbol_prefix("a/res/2", F.col("document_symbol"))).select("recid")


@query(_bib("select recid from bib where title_primary ilike '%en%'"))
def search_title_contains(spark, sf_dir):
    return V.view(spark, sf_dir, "RECORDS").where(R.title_contains("en", F.col("title_primary"))).select("recid")


@query(_bib("select recid from bib where len(list_filter(dc_identifier, lambda i: i ilike '%dec/1%')) > 0"))
def search_identifier_exists(spark, sf_dir):
    return V.view(spark, sf_dir, "RECORDS").where(R.identifier_contains("dec/1", F.col("dc_identifier"))).select("recid")


@query(_bib(f"select recid, {_SHOWN} symbol from bib"))
def display_identifier(spark, sf_dir):
    return V.view(spark, sf_dir, "RECORDS").select("recid", N.display_identifier(F.col("document_symbol"), F.col("dc_identifier")).alias("symbol"))


@query(_bib(f"select recid, {_TITLE} title from bib"))
def title_clean(spark, sf_dir):
    return V.view(spark, sf_dir, "RECORDS").select("recid", N.clean_title(F.col("title_primary")).alias("title"))


@query(_bib(f"select recid, list_filter(dc_identifier, lambda i: regexp_matches(trim(i), '{N.SYMBOL}'))[1] symbol from bib"))
def symbol_extract(spark, sf_dir):
    return V.view(spark, sf_dir, "RECORDS").select("recid", N.extract_symbol(F.col("dc_identifier")).alias("symbol"))


@query(_bib("select oai_identifier, case when regexp_matches(split_part(oai_identifier, ':', 3), '^[0-9]+$') then cast(split_part(oai_identifier, ':', 3) as bigint) end parsed from bib"))
def recid_parse(spark, sf_dir):
    return V.view(spark, sf_dir, "RECORDS").select("oai_identifier", N.parse_recid(F.col("oai_identifier")).alias("parsed"))


_ARRAY = "case when {0} is null then '' when len({0}) = 0 then '[]' else array_to_string({0}, ' | ') end"
_FLAT = f"oai_identifier, recid, {_AT} datestamp, deleted, source_set, document_symbol, title_primary, publication_date_primary, {_ARRAY.format('dc_identifier')} ids, {_ARRAY.format('dc_subject')} subjects"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"ids": N.render_array(F.col("dc_identifier")), "subjects": N.render_array(F.col("dc_subject"))}).drop("dc_identifier", "dc_subject")


@query(_bib(f"select {_FLAT} from bib where recid = 51 order by bib.datestamp desc nulls last, oai_identifier limit 1"))
def detail_by_recid(spark, sf_dir):
    return _flat(R.detail(V.view(spark, sf_dir, "RECORDS"), "51abc"))


_FIELDS = ("oai_identifier", "recid", _AT, "deleted", "metadata_prefix", "source_set", "source_url", "document_symbol", "title_primary", "publication_date_primary")
_PAIRS = [(f if f != _AT else "datestamp", f"coalesce(cast({f} as varchar), '')") for f in _FIELDS] + [(c, _ARRAY.format(c)) for c in S.DC_COLUMNS]
_MORE = ", ".join(f"case when recid % {k + 2} = 0 then null when recid % {k + 2} = 1 then [] else ['{c}', source_set, cast(recid as varchar)] end {c}" for k, c in enumerate(c for c in S.DC_COLUMNS if c not in ("dc_identifier", "dc_subject")))


@query(f"with bib as (select *, 'oai_dc' metadata_prefix, case when recid % 2 = 0 then 'http://feed.example' end source_url, {_MORE} from ({V.RECORDS_SQL}))" + " union all ".join(f" select oai_identifier, cast({k} as int) pos, '{n}' as key, {v} as value from bib" for k, (n, v) in enumerate(_PAIRS)))
def detail_unpivot(spark, sf_dir):
    """All 25 fields in display order."""
    more = [c for c in S.DC_COLUMNS if c not in ("dc_identifier", "dc_subject")]
    texts = {c: F.when(F.col("recid") % (k + 2) == 1, F.array().cast("array<string>")).when(F.col("recid") % (k + 2) != 0, F.array(F.lit(c), F.col("source_set"), F.col("recid").cast("string"))) for k, c in enumerate(more)}
    return R.unpivoted(V.view(spark, sf_dir, "RECORDS").withColumns({"metadata_prefix": F.lit("oai_dc"), "source_url": F.when(F.col("recid") % 2 == 0, "http://feed.example"), **texts}))


@query(_bib(f"select recid, coalesce(nullif({_SHOWN}, ''), 'RECID ' || recid) label, coalesce(nullif({_SHOWN}, ''), {_TITLE}, 'RECID ' || recid) heading, coalesce(nullif(publication_date_primary, ''), strftime(datestamp, '%Y-%m-%d')) shown_date from bib"))
def result_labels(spark, sf_dir):
    return R.labels(V.view(spark, sf_dir, "RECORDS"))


def _target(spark, sf_dir) -> DataFrame:
    return V.view(spark, sf_dir, "RECORDS").where("recid % 2 = 0").withColumns({"metadata_prefix": F.lit("oai_dc"), "marcxml_xml": F.concat(F.lit("<old>"), F.col("recid").cast("string"))})


def _batch(spark, sf_dir) -> DataFrame:
    """Records of every third number, some twice: the later arrival has another title."""
    rows = V.view(spark, sf_dir, "RECORDS").where("recid % 3 = 0").withColumns({"page_no": F.lit(0), "pos": F.col("recid").cast("int")})
    again = rows.where("recid % 9 = 0").withColumns({"page_no": F.lit(1), "title_primary": F.concat(F.lit("again "), F.col("recid").cast("string"))})
    return rows.unionByName(again).withColumn("marcxml_xml", F.concat(F.lit("<new>"), F.col("recid").cast("string"), F.lit("-"), F.col("page_no").cast("string")))


def _merged(df: DataFrame) -> DataFrame:
    return _flat(df.withColumn("datestamp", N.utc_text(F.col("datestamp"))))


_STATE = """new as (select *, case when recid % 9 = 0 then 'again ' || recid else title_primary end new_title from bib where recid % 3 = 0),
old as (select * from bib where recid % 2 = 0)"""
_UPSERT_DC = f"""select {_FLAT.replace('title_primary', "case when recid % 9 = 0 then 'again ' || recid else title_primary end title_primary")},
 case when recid % 3 = 0 then case when recid % 2 = 0 or recid % 9 = 0 then 'oai_dc+marcxml' else 'oai_dc' end else 'oai_dc' end metadata_prefix,
 case when recid % 2 = 0 then '<old>' || recid end marcxml_xml from bib where recid % 2 = 0 or recid % 3 = 0"""


@query(_bib(_UPSERT_DC))
def upsert_dc(spark, sf_dir):
    return _merged(M.upsert(_target(spark, sf_dir), _batch(spark, sf_dir).drop("marcxml_xml"), "oai_dc", CLOCK))


@query(_bib(_UPSERT_DC.replace("case when recid % 2 = 0 or recid % 9 = 0 then 'oai_dc+marcxml' else 'oai_dc' end else", "'oai_dc+marcxml' else")))
def upsert_replay(spark, sf_dir):
    batch = _batch(spark, sf_dir).drop("marcxml_xml")
    once = M.upsert(_target(spark, sf_dir), batch, "oai_dc", CLOCK)
    return _merged(M.upsert(once, batch, "oai_dc", CLOCK))


@query(
    _bib(f"""select {_FLAT.replace('document_symbol', 'case when recid % 2 = 0 then document_symbol end document_symbol').replace('title_primary', 'case when recid % 2 = 0 then title_primary end title_primary').replace('publication_date_primary', 'case when recid % 2 = 0 then publication_date_primary end publication_date_primary').replace(_ARRAY.format('dc_identifier'), "case when recid % 2 = 0 then " + _ARRAY.format('dc_identifier') + " else '[]' end").replace(_ARRAY.format('dc_subject'), "case when recid % 2 = 0 then " + _ARRAY.format('dc_subject') + " else '[]' end")},
 case when recid % 3 = 0 then 'oai_dc+marcxml' else 'oai_dc' end metadata_prefix,
 case when recid % 3 = 0 then '<new>' || recid || case when recid % 9 = 0 then '-1' else '-0' end else '<old>' || recid end marcxml_xml from bib where recid % 2 = 0 or recid % 3 = 0""")
)
def upsert_marc(spark, sf_dir):
    return _merged(M.upsert(_target(spark, sf_dir), _batch(spark, sf_dir).drop("title_primary", "document_symbol", "publication_date_primary", "dc_identifier", "dc_subject"), "marcxml", CLOCK))


@query(_bib("select recid, deleted or recid % 3 = 0 deleted, case when recid % 3 <> 0 then document_symbol end document_symbol, case when recid % 3 = 0 then 0 else len(dc_subject) end n_subjects, '<old>' || recid marcxml_xml from bib where recid % 2 = 0"))
def tombstone_clear(spark, sf_dir):
    nothing = F.array().cast("array<string>")
    gone = _target(spark, sf_dir).where("recid % 3 = 0").withColumns({"deleted": F.lit(True), "document_symbol": F.lit(None).cast("string"), "title_primary": F.lit(None).cast("string"), "publication_date_primary": F.lit(None).cast("string"), "dc_identifier": nothing, "dc_subject": nothing, "page_no": F.lit(0), "pos": F.col("recid").cast("int")})
    out = M.upsert(_target(spark, sf_dir), gone.drop("marcxml_xml"), "oai_dc", CLOCK)
    return out.select("recid", "deleted", "document_symbol", F.size("dc_subject").cast("long").alias("n_subjects"), "marcxml_xml")


@query(_bib("select count(*) total, count(*) filter (where not deleted) active, count(*) filter (where deleted) deleted_count from bib"))
def audit_counts(spark, sf_dir):
    return R.audit_counts(V.view(spark, sf_dir, "RECORDS"))


@query(_bib(f"select recid, {_AT} datestamp from bib where not deleted order by bib.datestamp desc nulls last, recid, oai_identifier limit 20"))
def recent_active(spark, sf_dir):
    return R.recent_active(V.view(spark, sf_dir, "RECORDS")).select("recid", N.utc_text(F.col("datestamp")).alias("datestamp"))


_ACCOUNTS = f"with tokens as ({V.TOKENS}), users as ({V.USERS}), domains as ({V.DOMAINS}), entities as ({V.ENTITIES})"


@query(f"{_ACCOUNTS} select email, exists (select 1 from domains where domain = split_part(lower(email), '@', 2)) allowed from users")
def domain_allowed(spark, sf_dir):
    return A.domain_allowed(V.view(spark, sf_dir, "USERS").select("email"), V.view(spark, sf_dir, "DOMAINS"))


@query(f"{_ACCOUNTS} select token, email from tokens where expires_at > {_NOW_SQL} and used_at is null")
def live_tokens(spark, sf_dir):
    return A.live_tokens(V.view(spark, sf_dir, "TOKENS"), _now()).select("token", "email")


@query(f"{_ACCOUNTS} select email, count(*) recent from tokens where expires_at > {_NOW_SQL} + interval '13' minute and used_at is null group by email")
def recent_token_count(spark, sf_dir):
    tokens = V.view(spark, sf_dir, "TOKENS").withColumns({c: F.col(c).cast("timestamp") for c in ("expires_at", "used_at")})
    return A.recent_tokens(tokens, CLOCK)


@query(f"{_ACCOUNTS} select token, email, case when cast(substring(token, 4) as bigint) % 5 = 0 and expires_at > {_NOW_SQL} and used_at is null then strftime({_NOW_SQL}, '%Y-%m-%d %H:%M:%S') else strftime(used_at, '%Y-%m-%d %H:%M:%S') end used_at from tokens")
def consume_tokens(spark, sf_dir):
    tokens = V.view(spark, sf_dir, "TOKENS")
    wanted = tokens.where(F.substring("token", 4, 20).cast("long") % 5 == 0).select("token")
    return A.consume(tokens, wanted, _now())[0].select("token", "email", F.date_format("used_at", "yyyy-MM-dd HH:mm:ss").alias("used_at"))


@query(f"{_ACCOUNTS} select token, t.email, nullif(u.entity, '') entity from tokens t left join users u on lower(t.email) = lower(u.email) where expires_at > {_NOW_SQL} and used_at is null")
def token_entity_lookup(spark, sf_dir):
    return A.token_entities(V.view(spark, sf_dir, "TOKENS"), V.view(spark, sf_dir, "USERS"), _now())


@query(f"{_ACCOUNTS}, logins as (select distinct lower(email) e from tokens) select coalesce(email, e) email, u.entity, case when e is not null then '{V.NOW}' end last_login_at from users u full outer join logins on u.email = e")
def upsert_user_login(spark, sf_dir):
    users = V.view(spark, sf_dir, "USERS").withColumns({"id": F.col("id").cast("string"), "last_login_at": F.lit(None).cast("timestamp")})
    out = A.record_logins(users, V.view(spark, sf_dir, "TOKENS").select("email"), CLOCK)
    return out.select("email", "entity", F.date_format("last_login_at", "yyyy-MM-dd HH:mm:ss").alias("last_login_at"))


@query(f"{_ACCOUNTS} select * from domains union all select distinct entity, 'extra.org' from entities")
def seed_domains_ignore(spark, sf_dir):
    domains = V.view(spark, sf_dir, "DOMAINS")
    extra = domains.withColumn("domain", F.lit("extra.org"))
    return M.insert_ignore(domains, domains.unionByName(extra).unionByName(extra), ["entity", "domain"])


@query(f"{_ACCOUNTS} select id, email, case when id = 7 then 'NEW NAME' else entity end entity from users")
def update_entity(spark, sf_dir):
    return A.update_entity(V.view(spark, sf_dir, "USERS"), 7, " NEW NAME ")


@query(f"{_ACCOUNTS} select id, email, entity from users where id = 11 limit 1")
def user_by_id(spark, sf_dir):
    return A.user_by_id(V.view(spark, sf_dir, "USERS"), 11)


@query(f"{_ACCOUNTS} select entity, nullif(entity_long, '') entity_long from entities order by entity")
def entities_sorted(spark, sf_dir):
    return A.entities_sorted(V.view(spark, sf_dir, "ENTITIES"))


@query(f"{_ACCOUNTS} select entity, entity_long from entities where contains(lower(entity), 'region 1') or contains(lower(entity_long), 'region 1')")
def entity_filter(spark, sf_dir):
    return A.entity_filter(V.view(spark, sf_dir, "ENTITIES"), "Region 1")


@query(f"{_ACCOUNTS} select count(*) filter (where lower(entity) = 'nowhere') = 0 offered from entities")
def entity_custom_option(spark, sf_dir):
    return A.offers_custom(V.view(spark, sf_dir, "ENTITIES"), " Nowhere ")


def _pages(spark, sf_dir, inner: str) -> DataFrame:
    """A feed page for each document, made from its columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = "concat('<OAI-PMH xmlns=\"http://www.openarchives.org/OAI/2.0/\"><ListRecords><record><header', if(doc_id % 17 = 0, ' status=\"deleted\"', ''), '><identifier>oai:', source, ':', doc_id, '</identifier><datestamp>2025-01-01T00:00:00Z</datestamp><setSpec>', source, '</setSpec></header>'"
    return docs.selectExpr("cast(doc_id as int) page_no", f"{head}, if(doc_id % 17 = 0, '', concat('<metadata>', {inner}, '</metadata>')), '</record></ListRecords></OAI-PMH>') xml")


@query("select cast(doc_id as bigint) recid, doc_id % 17 = 0 deleted, source source_set, case when doc_id % 17 <> 0 then 'A/RES/79/' || doc_id end document_symbol, case when doc_id % 17 <> 0 then 'Title ' || doc_id end title_primary, case when doc_id % 17 = 0 then '' else lang || '|' || source end subjects from documents")
def parse_dc_pages(spark, sf_dir):
    dc = """'<d:dc xmlns:d="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:e="http://purl.org/dc/elements/1.1/"><e:title> Title ', doc_id, ' </e:title><e:identifier>https://x.example/1</e:identifier><e:identifier>A/RES/79/', doc_id, '</e:identifier><e:subject>', lang, '</e:subject><e:subject>  </e:subject><e:subject>', source, '</e:subject></d:dc>'"""
    rows = pages.records(pages.parsed(_pages(spark, sf_dir, dc), "oai_dc"), "oai_dc", "https://feed.example")
    return rows.select("recid", "deleted", "source_set", "document_symbol", "title_primary", F.array_join("dc_subject", "|").alias("subjects"))


@query("select cast(doc_id as bigint) recid, case when doc_id % 17 <> 0 then 'lead ' || doc_id || ' ' end leader, case when doc_id % 17 <> 0 then lang end language, case when doc_id % 17 <> 0 then '[ ][1]' end indicators, case when doc_id % 17 <> 0 then '<ns0:metadata xmlns:ns0=\"http://www.openarchives.org/OAI/2.0/\" xmlns:ns1=\"http://www.loc.gov/MARC21/slim\"><ns1:record><ns1:leader>lead ' || doc_id || ' </ns1:leader><ns1:controlfield tag=\"001\">' || doc_id || '</ns1:controlfield><ns1:datafield tag=\"041\" ind2=\"1\"><ns1:subfield code=\"a\">' || lang || '</ns1:subfield></ns1:datafield></ns1:record></ns0:metadata>' end marcxml_xml from documents")
def parse_marc_pages(spark, sf_dir):
    marc = """'<m:record xmlns:m="http://www.loc.gov/MARC21/slim"><m:leader>lead ', doc_id, ' </m:leader><m:controlfield tag="001">', doc_id, '</m:controlfield><m:datafield tag="041" ind2="1"><m:subfield code="a">', lang, '</m:subfield></m:datafield></m:record>'"""
    rows = pages.records(pages.parsed(_pages(spark, sf_dir, marc), "marcxml"), "marcxml")
    j = F.col("marcxml_json")
    return rows.select("recid", j["leader"].alias("leader"), F.get(F.get(j["datafields"], 0)["subfields"], 0)["value"].alias("language"), F.concat(F.lit("["), F.get(j["datafields"], 0)["ind1"], F.lit("]["), F.get(j["datafields"], 0)["ind2"], F.lit("]")).alias("indicators"), "marcxml_xml")


@query("select '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as json from region")
def csv_to_json_records(spark, sf_dir):
    """Region as a headed CSV, its types inferred again, as one JSON text a row."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/region-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").write.option("header", True).csv(path)
    return files.json_rows(files.read_csv(spark, path))


@query("select n_name as entity, n_regionkey as region from nation where n_regionkey > 1 and n_name <> '$1' order by n_name")
def parameterised_query(spark, sf_dir):
    """SQL with bound parameters; a $ within quotes is none."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation_rows")
    return engine.bound(spark, "select n_name as entity, n_regionkey as region from nation_rows where n_regionkey > $1 and n_name <> '$1' order by n_name", [1])


@query("select * from (values " + ", ".join(f"('{e}', '{d}')" for e, d in S.ALLOWED_DOMAINS) + ") t(entity, domain)")
def seeded_domains(spark, sf_dir):
    """The domains that are allowed from the start, inserted twice."""
    rows = spark.createDataFrame(list(S.ALLOWED_DOMAINS), S.DOMAINS)
    return M.insert_ignore(M.insert_ignore(rows.limit(0), rows, ["entity", "domain"]), rows, ["entity", "domain"])
