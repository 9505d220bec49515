"""Feed pages (XML) to typed rows.

The pages' prefixes and namespaces differ by producer, so they are parsed with ElementTree in mapInArrow, one page a
row; nothing is inferred and nothing is lost to attribute or white-space rules.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as S
from ..functions import normalize as N

#: The namespaces of the feed.
OAI = "{http://www.openarchives.org/OAI/2.0/}"
OAI_DC = "{http://www.openarchives.org/OAI/2.0/oai_dc/}"
DC = "{http://purl.org/dc/elements/1.1/}"
MARC = "{http://www.loc.gov/MARC21/slim}"

#: What a page gives: rows of records, and one row with pos -1 for the page itself.
RECORDS = T.StructType(
    [T.StructField("page_no", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("oai_identifier", T.StringType()), T.StructField("datestamp", T.StringType()), T.StructField("deleted", T.BooleanType()), T.StructField("source_set", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in S.DC_COLUMNS]
    + [T.StructField("marcxml_xml", T.StringType()), T.StructField("marcxml_json", S.MARC)]
    + [T.StructField(c, T.StringType()) for c in ("error_code", "error_message", "resumption_token")]
)


#: Parsed rows that are handed on together.
ROWS = 5000


class FeedError(RuntimeError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def _text(e: ET.Element | None) -> str:
    return (e.text or "").strip() if e is not None else ""


def dublin_core(record: ET.Element) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {c: [] for c in S.DC_COLUMNS}
    holder = record.find(f"{OAI}metadata/{OAI_DC}dc")
    for e in holder if holder is not None else ():
        if isinstance(e.tag, str) and e.tag.startswith(DC):
            name, value = "dc_" + e.tag[len(DC) :], _text(e)
            if value and name in out:
                out[name].append(value)
    return out


def marc_payload(record: ET.Element) -> tuple[str | None, dict | None]:
    metadata = record.find(f"{OAI}metadata")
    if metadata is None:
        return None, None
    payload = metadata.find(f"{MARC}record")
    if payload is None:
        return ET.tostring(metadata, "unicode"), None
    leader = payload.find(f"{MARC}leader")
    control = [{"tag": e.get("tag", ""), "value": _text(e)} for e in payload.findall(f"{MARC}controlfield")]
    data = [
        {"tag": e.get("tag", ""), "ind1": e.get("ind1", " "), "ind2": e.get("ind2", " "), "subfields": [{"code": x.get("code", ""), "value": _text(x)} for x in e.findall(f"{MARC}subfield")]}
        for e in payload.findall(f"{MARC}datafield")
    ]
    return ET.tostring(metadata, "unicode"), {"leader": leader.text if leader is not None else None, "controlfields": control, "datafields": data}


def page_rows(xml: str | bytes, page_no: int, prefix: str) -> Iterator[dict]:
    root = ET.fromstring(xml)
    error = root.find(f"{OAI}error")
    if error is not None:
        yield {"page_no": page_no, "pos": -1, "error_code": error.get("code", "unknown"), "error_message": _text(error)}
        return
    yield {"page_no": page_no, "pos": -1, "resumption_token": _text(root.find(f".//{OAI}resumptionToken")) or None}
    for pos, record in enumerate(root.iter(f"{OAI}record")):
        header = record.find(f"{OAI}header")
        if header is None:
            continue
        deleted = header.get("status") == "deleted"
        row = {"page_no": page_no, "pos": pos, "oai_identifier": header.findtext(f"{OAI}identifier", ""), "datestamp": header.findtext(f"{OAI}datestamp", ""), "deleted": deleted, "source_set": header.findtext(f"{OAI}setSpec")}
        if prefix == "oai_dc":
            row |= {c: [] for c in S.DC_COLUMNS} if deleted else dublin_core(record)
        else:
            row["marcxml_xml"], row["marcxml_json"] = marc_payload(record)
        yield row


def parsed(pages: DataFrame, prefix: str) -> DataFrame:
    """RECORDS of pages(page_no, xml); xml is text, or the bytes as they came."""
    arrow = to_arrow_schema(RECORDS)

    def whole(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            for page_no, xml in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += page_rows(xml.as_py(), page_no, prefix) if xml.is_valid and len(xml.as_py()) else ()
                if len(held) >= ROWS:
                    yield whole(held)
                    held = []
            if held:
                yield whole(held)

    return pages.select(F.col("page_no").cast("int"), F.col("xml")).mapInArrow(run, RECORDS)


def records(found: DataFrame, prefix: str, source_url: str | None = None) -> DataFrame:
    """Typed rows of a harvest pass from what parsed() gave."""
    rows = found.where("pos >= 0")
    header = [F.col("oai_identifier"), N.parse_recid(F.col("oai_identifier")).alias("recid"), F.to_timestamp(F.trim("datestamp")).alias("datestamp"), F.col("deleted"), F.col("source_set"), F.lit(source_url).cast("string").alias("source_url")]
    order = [F.col("page_no"), F.col("pos")]
    if prefix == "oai_dc":
        normal = [N.extract_symbol(F.col("dc_identifier")).alias("document_symbol"), N.first_of(F.col("dc_title")).alias("title_primary"), N.first_of(F.col("dc_date")).alias("publication_date_primary")]
        return rows.select(*header, *normal, *S.DC_COLUMNS, *order)
    return rows.select(*header, "marcxml_xml", "marcxml_json", *order)


def first_error(found: DataFrame) -> tuple[str, str] | None:
    row = found.where("error_code is not null").orderBy("page_no").select("error_code", "error_message").head()
    return (row[0], row[1]) if row else None
