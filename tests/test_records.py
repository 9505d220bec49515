"""Pages, merges, streams, accounts and files on small handcrafted input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge import cli, engine
from folioforge import schema as S
from folioforge.functions import normalize as N
from folioforge.operators import accounts, merge, search
from folioforge.sources import feed, files, pages
from folioforge.streaming import ingest

NOW = datetime(2025, 3, 1)
NS = 'xmlns="http://www.openarchives.org/OAI/2.0/" xmlns:o="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:marc="http://www.loc.gov/MARC21/slim"'


def page(*records: str, token: str = "") -> str:
    return f"<OAI-PMH {NS}><ListRecords>{''.join(records)}<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"


def record(ident: str, body: str = "", status: str = "") -> str:
    return f'<record><header{status and f" status={chr(34)}{status}{chr(34)}"}><identifier>{ident}</identifier><datestamp>2025-01-02T03:04:05Z</datestamp><setSpec>a</setSpec><setSpec>b</setSpec></header>{body}</record>'


def dc(inner: str) -> str:
    return f"<metadata><o:dc>{inner}</o:dc></metadata>"


def rows(spark, xml, prefix):
    return pages.records(pages.parsed(spark.createDataFrame([(0, xml)], "page_no int, xml string"), prefix), prefix, "http://feed").orderBy("pos").collect()


def test_dublin_core_pages(spark):
    xml = page(record("oai:h:12", dc("<dc:title>T</dc:title><dc:subject> b </dc:subject><dc:subject>  </dc:subject><dc:subject>a</dc:subject><dc:identifier>https://x</dc:identifier><dc:identifier>A/RES/79/1</dc:identifier><dc:date>2001</dc:date>")), "<record><metadata/></record>", record("oai:h:ab", status="deleted"))
    first, gone = rows(spark, xml, "oai_dc")
    assert (first.recid, first.dc_subject, first.document_symbol, first.title_primary, first.source_set, first.source_url) == (12, ["b", "a"], "A/RES/79/1", "T", "a", "http://feed")
    assert gone.deleted and gone.recid is None and gone.dc_title == [] and gone.title_primary is None


@pytest.mark.parametrize("form", ["<marc:record>{}</marc:record>", '<record xmlns="http://www.loc.gov/MARC21/slim">{}</record>'])
def test_marc_pages(spark, form):
    p = "marc:" if form.startswith("<marc") else ""
    inner = f'<{p}leader> L </{p}leader><{p}controlfield tag="001"> 7 </{p}controlfield><{p}datafield tag="245" ind2="1"><{p}subfield code="a"></{p}subfield></{p}datafield>'
    one, bare, gone = rows(spark, page(record("oai:h:1", f"<metadata>{form.format(inner)}</metadata>"), record("oai:h:2", "<metadata><x/></metadata>"), record("oai:h:3", status="deleted")), "marcxml")
    m = one.marcxml_json
    assert one.marcxml_xml.startswith("<ns0:metadata") and one.marcxml_xml.rstrip().endswith("</ns0:metadata>")
    assert m.leader == " L " and (m.controlfields[0].tag, m.controlfields[0].value) == ("001", "7")
    assert (m.datafields[0].ind1, m.datafields[0].ind2, m.datafields[0].subfields[0].value) == (" ", "1", "")
    assert bare.marcxml_xml and bare.marcxml_json is None and gone.marcxml_xml is None and gone.marcxml_json is None


def test_feed_error_page(spark):
    found = pages.parsed(spark.createDataFrame([(0, f'<OAI-PMH {NS}><error code="noRecordsMatch"> none </error></OAI-PMH>')], "page_no int, xml string"), "oai_dc")
    assert pages.first_error(found) == ("noRecordsMatch", "none") and pages.records(found, "oai_dc").isEmpty()


def test_urls_and_prefixes():
    assert "from=f" in feed.build_url("http://h", "oai_dc", "f") and "metadataPrefix=oai_dc" in feed.build_url("http://h", "oai_dc", "f")
    assert feed.build_url("http://h", "oai_dc", "f", token="a b") == "http://h?verb=ListRecords&resumptionToken=a+b"
    assert feed.prefixes_of(" oai_dc, ,marcxml") == ["oai_dc", "marcxml"] and feed.prefixes_of("") == []
    with pytest.raises(feed.BadConfiguration):
        feed.prefixes_of("other")


ANSWERS = {None: page(record("oai:h:1", dc("<dc:title>one</dc:title>")), record("oai:h:1", dc("<dc:title>two</dc:title>")), token="t1"), "t1": page(record("oai:h:2", dc("<dc:title>x</dc:title>")), token="t2"), "t2": page(record("oai:h:3", dc("<dc:title>é</dc:title>"))).encode("latin-1")}
ANSWERS["t2"] = b'<?xml version="1.0" encoding="ISO-8859-1"?>' + ANSWERS["t2"]


def answer(url, timeout):
    return next((v for k, v in ANSWERS.items() if k and f"resumptionToken={k}" in url), ANSWERS[None])


def test_harvest_resumes_without_loss(spark, tmp_path):
    journal = feed.Journal(spark, str(tmp_path / "s" / "state.json"))
    job = feed.Harvest(spark, "http://h", str(tmp_path / "land"), journal, max_pages=1, get=answer, wait=lambda s: None, say=lambda t: None)
    job.run("oai_dc")
    assert journal.entries()["oai_dc"]["resumptionToken"] == "t1"
    table = merge.VersionedTable(spark, str(tmp_path / "table"), S.DOCUMENTS, merge.KEY, buckets=3)
    run = lambda: ingest.ingest(spark, job.folder("oai_dc"), "oai_dc", table, str(tmp_path / "check"), now=NOW).awaitTermination()
    run()
    job.max_pages = 0
    assert job.run("oai_dc", resume=True)["pagesFetched"] == 2 and journal.entries()["oai_dc"]["resumptionToken"] is None
    run()
    run()
    got = {r.recid: r for r in table.read().collect()}
    assert sorted(got) == [1, 2, 3] and got[1].title_primary == "two" and got[1].metadata_prefix == merge.BOTH and got[2].metadata_prefix == "oai_dc" and got[3].title_primary == "é"
    assert [(e["batch"], e["pages"], e["records"]) for e in table.log()] == [("oai_dc-0", 1, 2), ("oai_dc-1", 2, 2)]
    table.publish(table.read(), batch="oai_dc-1")
    assert len(table.log()) == 2 and table.lookup("oai:h:2").head().recid == 2


def test_harvest_goes_on_behind_a_lost_connection(spark, tmp_path):
    """The token of each landed page is kept: what failed is fetched again under its own number, and nothing twice."""
    broken = {"t1"}

    def get(url, timeout):
        for k in sorted(broken):
            if f"resumptionToken={k}" in url:
                broken.discard(k)
                raise OSError("lost")
        return answer(url, timeout)

    said = []
    journal = feed.Journal(spark, str(tmp_path / "state.json"))
    job = feed.Harvest(spark, "http://h", str(tmp_path / "land"), journal, get=get, wait=lambda s: None, say=said.append)
    with pytest.raises(OSError):
        job.run("oai_dc")
    assert journal.entries()["oai_dc"] | {"updatedAt": ""} == {"updatedAt": "", "resumptionToken": "t1", "recordsWritten": 2, "pagesFetched": 1, "from": None, "until": None, "set": None, "nextPage": 1}
    job.run("oai_dc", resume=True)
    assert [p.name for p in sorted((tmp_path / "land/oai_dc").glob("*.xml"))] == ["00000000.xml", "00000001.xml", "00000002.xml"] and len(said) == 3
    text = (tmp_path / "state.json").read_text()
    assert text.endswith("}\n") and text.index('"from"') < text.index('"nextPage"') < text.index('"until"')


def test_command_line(spark, tmp_path, capsys):
    base = ["--store", str(tmp_path), "--base-url", "http://h", "--sleep", "0"]
    say = []
    assert cli.main(["--prefixes", "oai_dc,x"], spark) == 2 and cli.main(["--prefixes", "oai_dc"], spark) == 2
    assert cli.main([*base, "--prefixes", "oai_dc", "--max-records", "2"], spark, answer, say.append) == 0
    assert cli.main([*base, "--prefixes", "oai_dc", "--resume"], spark, answer, say.append) == 0
    store = engine.Engine(spark, f"{tmp_path}/tables")
    assert sorted(r[0] for r in store.query("select recid from documents where recid > $1 and title_primary <> $2", [0, "x"]).collect()) == [1, 3]
    error = f'<OAI-PMH {NS}><error> gone </error></OAI-PMH>'
    assert cli.main([*base, "--prefixes", "marcxml"], spark, lambda url, timeout: error, say.append) == 3
    assert "feed error unknown: gone (marcxml)" in capsys.readouterr().err
    assert set(feed.Journal(spark, f"{tmp_path}/state.json").entries()) == {"marcxml"} and store.table("allowed_domains").count() == len(S.ALLOWED_DOMAINS)


def test_engine_tables(spark, tmp_path):
    store = engine.Engine(spark, str(tmp_path))
    store.create()
    store.create()
    assert store.table("users").isEmpty() and store.query("select count(*) n from allowed_domains where entity = '*' and domain <> '$9'").head().n == 1
    with pytest.raises(ValueError):
        store.query("select $1")
    users = store.tables["users"]
    row = spark.createDataFrame([("i", "a@x", None, NOW, NOW, None)], S.USERS)
    users.merge(row, lambda old, new: old.unionByName(new))
    for bad, error in ((row, merge.KeyConflict), (row.withColumn("id", F.lit(None).cast("string")).withColumn("email", F.lit("b@x")), merge.MissingValue), (row.withColumn("email", F.lit(None).cast("string")), merge.KeyConflict)):
        with pytest.raises(error):
            users.merge(bad, lambda old, new: old.unionByName(new))
    assert users.read().count() == 1
    wider = merge.VersionedTable(spark, users.path, T.StructType([*S.USERS.fields, T.StructField("tags", T.ArrayType(T.StringType()))]), "email", defaults={"tags": F.array()})
    assert not wider.create() and wider.read().head().tags == []
    with pytest.raises(ValueError):
        merge.VersionedTable(spark, users.path, T.StructType([T.StructField("email", T.LongType())]), "email").create()


def test_merges_touch_only_their_buckets(spark, tmp_path):
    table = merge.VersionedTable(spark, str(tmp_path), T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())]), "k", buckets=8)
    table.publish(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    new = spark.createDataFrame([(5, "new"), (1000, "new")], "k long, v string")
    table.merge(new, lambda old, rows: old.join(rows, "k", "left_anti").unionByName(rows))
    before, after = (e["folders"] for e in table.log())
    assert len(before) == 8 and 1 <= sum(before[b] != after[b] for b in after) <= 2
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 201 and got[5] == got[1000] == "new" and sum(v == "new" for v in got.values()) == 2


def test_account_actions(spark, tmp_path):
    store = engine.Engine(spark, str(tmp_path))
    store.tables["allowed_domains"].publish(spark.createDataFrame([("*", "x.org")], S.DOMAINS))
    act = accounts.Actions(store.tables["users"], store.tables["magic_tokens"], store.tables["allowed_domains"])
    assert not act.request_link("  ", NOW).success and not act.request_link("a@y.org", NOW).success and not act.request_link(None, NOW).success
    asked = act.request_link(" A@X.org ", NOW)
    assert asked.success and len(asked.data["token"]) == 64 and not act.request_link("a@x.org", NOW).success
    token = asked.data["token"]
    assert act.check_entity(token, NOW).data == {"email": "a@x.org", "hasEntity": False, "entity": None}
    done = act.verify(token, NOW, "  E ")
    assert done.success and store.table("users").head().entity == "E" and store.table("users").head().id == done.data["userId"]
    assert not act.verify(token, NOW).success and not act.check_entity(token, NOW).success and not act.verify("", NOW).success
    again = act.request_link("a@x.org", NOW + timedelta(minutes=3))
    assert act.check_entity(again.data["token"], NOW + timedelta(minutes=3)).data["entity"] == "E"
    assert act.verify(again.data["token"], NOW + timedelta(minutes=3)).data == done.data
    assert not act.set_entity(None, "F").success and not act.set_entity(done.data["userId"], " ").success and act.set_entity(done.data["userId"], " F ").success
    assert store.table("users").head().entity == "F" and store.table("users").count() == 1


def test_upsert_groups_and_replay(spark):
    empty = spark.createDataFrame([], S.DOCUMENTS)
    d = pages.records(pages.parsed(spark.createDataFrame([(0, page(record("oai:h:1", dc("<dc:title>one</dc:title>"))))], "page_no int, xml string"), "oai_dc"), "oai_dc")
    m = pages.records(pages.parsed(spark.createDataFrame([(0, page(record("oai:h:1", "<metadata><x/></metadata>"), record("oai:h:9", "<metadata><x/></metadata>")))], "page_no int, xml string"), "marcxml"), "marcxml")
    one = merge.upsert(merge.upsert(empty, d, "oai_dc", NOW), m, "marcxml", NOW)
    other = merge.upsert(merge.upsert(empty, m, "marcxml", NOW), d, "oai_dc", NOW)
    key = lambda df: sorted(map(str, df.drop("metadata_prefix").collect()))
    assert key(one) == key(other)
    only = one.where("recid = 9").head()
    assert only.dc_title == [] and only.title_primary is None and only.metadata_prefix == merge.BOTH
    assert search.search(one.withColumn("deleted", F.lit(False)), "one").count() == 1
    again = merge.upsert(one, d, "oai_dc", NOW + timedelta(days=1)).where("recid = 1").head()
    assert again.created_at == NOW and again.updated_at == NOW + timedelta(days=1) and again.marcxml_xml is not None


def test_scalars(spark):
    one = spark.createDataFrame([("Report : ", " : ", "A@B.org", "abc", "a@b@c", "oai:h:12", "oai:h:ab", "", ["a", "b"], [])], "t string, u string, e string, f string, g string, i string, j string, k string, a array<string>, z array<string>")
    r = one.select(N.clean_title(F.col("t")), N.clean_title(F.col("u")), N.email_domain(F.col("e")), N.email_domain(F.col("f")), N.email_domain(F.col("g")), N.parse_recid(F.col("i")), N.parse_recid(F.col("j")), N.parse_recid(F.col("k")), N.render_array(F.col("a")), N.render_array(F.col("z")), N.render_array(F.lit(None).cast("array<string>"))).head()
    assert tuple(r) == ("Report", None, "b.org", None, "b", 12, None, None, "a | b", "[]", "")
    assert [N.integer_prefix(x) for x in ("123abc", " -4", "abc", "", None, "9" * 30)] == [123, -4, None, None, None, None]
    assert N.ilike_pattern("a\\b%_\\%\\") == "ab%_\\%\\\\"


def test_search_guards_and_plan(spark, tmp_path):
    records = spark.createDataFrame([("k", 1, NOW, False, "A/RES/1", "T : ", None, ["https://x", "B\\c"]), ("l", 2, NOW, True, None, None, None, None)], "oai_identifier string, recid long, datestamp timestamp, deleted boolean, document_symbol string, title_primary string, publication_date_primary string, dc_identifier array<string>")
    assert search.search(records, " a ").isEmpty() and search.search(records, None).isEmpty()
    assert search.search(records, "a/res").head().title == "T"
    assert search.detail(records, "1x").count() == 1
    with pytest.raises(search.InvalidArgument):
        search.detail(records, "x")
    records.write.parquet(str(tmp_path / "r"))
    plan = search.search(spark.read.parquet(str(tmp_path / "r")), "a/res")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_tokens_are_used_once(spark):
    tokens = accounts.add_token(spark.createDataFrame([], S.TOKENS), "t", "A@x.org", NOW)
    with pytest.raises(merge.KeyConflict):
        accounts.add_token(tokens, "t", "a@x.org", NOW)
    assert accounts.recent_token_exists(tokens, "a@X.org", NOW) and not accounts.recent_token_exists(tokens, "a@x.org", NOW + timedelta(minutes=5))
    wanted = spark.createDataFrame([("t",), ("t",)], "token string")
    used, got = accounts.consume(tokens, wanted, NOW)
    assert [r.email for r in got.collect()] == ["a@x.org"] and accounts.consume(used, wanted, NOW)[1].isEmpty()
    domains = spark.createDataFrame([("E", "x.org")], S.DOMAINS)
    assert accounts.is_allowed(domains, "a@X.org") and not accounts.is_allowed(domains, "a") and not accounts.is_allowed(domains, "a@")


def test_json_array(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,\n2,é\n", encoding="utf-8")
    files.write_json_array(files.read_csv(spark, str(tmp_path / "a.csv")), tmp_path / "out" / "a.json")
    import json

    assert json.loads((tmp_path / "out" / "a.json").read_text(encoding="utf-8")) == [{"a": 1, "b": None}, {"a": 2, "b": "é"}]
