"""Declared schemas of the record tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: The element names of unqualified Dublin Core.
DC_FIELDS = ("title", "creator", "subject", "description", "publisher", "contributor", "date", "type", "format", "identifier", "source", "language", "relation", "coverage", "rights")
DC_COLUMNS = tuple(f"dc_{f}" for f in DC_FIELDS)

_text, _texts = T.StringType(), T.ArrayType(T.StringType())
MARC = T.StructType(
    [
        T.StructField("leader", _text),
        T.StructField("controlfields", T.ArrayType(T.StructType([T.StructField("tag", _text), T.StructField("value", _text)]))),
        T.StructField("datafields", T.ArrayType(T.StructType([T.StructField("tag", _text), T.StructField("ind1", _text), T.StructField("ind2", _text), T.StructField("subfields", T.ArrayType(T.StructType([T.StructField("code", _text), T.StructField("value", _text)])))]))),
    ]
)
HEADER = [T.StructField("oai_identifier", _text), T.StructField("recid", T.LongType()), T.StructField("datestamp", T.TimestampType()), T.StructField("deleted", T.BooleanType()), T.StructField("source_set", _text), T.StructField("source_url", _text)]
NORMALISED = [T.StructField("document_symbol", _text), T.StructField("title_primary", _text), T.StructField("publication_date_primary", _text)]
DC = [T.StructField(c, _texts) for c in DC_COLUMNS]
MARC_PAYLOAD = [T.StructField("marcxml_xml", _text), T.StructField("marcxml_json", MARC)]
ORDER = [T.StructField("page_no", T.IntegerType()), T.StructField("pos", T.IntegerType())]
AUDIT = [T.StructField("metadata_prefix", _text), T.StructField("last_harvested_at", T.TimestampType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]

DC_ROWS = T.StructType(HEADER + NORMALISED + DC + ORDER)
MARC_ROWS = T.StructType(HEADER + MARC_PAYLOAD + ORDER)
DOCUMENTS = T.StructType(HEADER + NORMALISED + DC + MARC_PAYLOAD + AUDIT)
USERS = T.StructType([T.StructField("id", _text), T.StructField("email", _text), T.StructField("entity", _text), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("last_login_at", T.TimestampType())])
TOKENS = T.StructType([T.StructField("token", _text), T.StructField("email", _text), T.StructField("expires_at", T.TimestampType()), T.StructField("used_at", T.TimestampType())])
DOMAINS = T.StructType([T.StructField("entity", _text), T.StructField("domain", _text)])
ENTITIES = T.StructType([T.StructField("entity", _text), T.StructField("entity_long", _text)])

#: The mail domains that are allowed from the start, with the entity they belong to ('*': any).
ALLOWED_DOMAINS = (
    ("*", "un.org"),
    ("UNDP", "undp.org"),
    ("UNICEF", "unicef.org"),
    ("UNFPA", "unfpa.org"),
    ("WFP", "wfp.org"),
    ("UNHCR", "unhcr.org"),
    ("UNRWA", "unrwa.org"),
    ("UN-Habitat", "unhabitat.org"),
    ("UNEP", "unep.org"),
    ("UNODC", "unodc.org"),
    ("UN-Women", "unwomen.org"),
    ("WHO", "who.int"),
    ("UNESCO", "unesco.org"),
    ("ILO", "ilo.org"),
    ("FAO", "fao.org"),
    ("IFAD", "ifad.org"),
    ("IMO", "imo.org"),
    ("ICAO", "icao.int"),
    ("ITU", "itu.int"),
    ("UPU", "upu.int"),
    ("WIPO", "wipo.int"),
    ("UNIDO", "unido.org"),
    ("UNWTO", "unwto.org"),
    ("WMO", "wmo.int"),
    ("IAEA", "iaea.org"),
    ("WTO", "wto.org"),
    ("IOM", "iom.int"),
    ("ICJ", "icj-cij.org"),
    ("ECLAC", "cepal.org"),
    ("ESCAP", "un.org"),
    ("ESCWA", "un.org"),
    ("ECA", "un.org"),
    ("ECE", "un.org"),
    ("UNCTAD", "unctad.org"),
    ("ITC", "intracen.org"),
    ("UNAIDS", "unaids.org"),
    ("UNSSC", "unssc.org"),
    ("UNU", "unu.edu"),
)
