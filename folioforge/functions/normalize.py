"""Column functions that normalise record fields. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = "^https?://"
#: Fixed value: symbols of resolutions and decisions.
SYMBOL = r"^(A|S|E)/(RES|DEC)/[A-Z0-9().-]+(?:/[A-Z0-9().-]+)*$"


def ilike_pattern(query: str) -> str:
    """The query as an ILIKE pattern body: % and _ stay live, a backslash before anything else is dropped."""
    out, k = [], 0
    while k < len(query):
        c = query[k]
        if c == "\\":
            follower = query[k + 1 : k + 2]
            out.append("\\" + follower if follower in ("%", "_", "\\") else "\\\\" if not follower else follower)
            k += 2
        else:
            out.append(c)
            k += 1
    return "".join(out)


def strip(c: Column) -> Column:
    """Trims any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_of(a: Column) -> Column:
    return F.get(a, 0)


def display_identifier(symbol: Column, identifiers: Column) -> Column:
    """The symbol, or else the first identifier that is no URL."""
    return F.coalesce(F.nullif(symbol, F.lit("")), F.get(F.filter(identifiers, lambda i: ~i.rlike(URL)), 0))


def extract_symbol(identifiers: Column) -> Column:
    """The first identifier that, stripped, reads as a symbol."""
    return F.get(F.filter(F.transform(identifiers, strip), lambda i: i.rlike(SYMBOL)), 0)


def clean_title(title: Column) -> Column:
    """Without a trailing colon and outer white space; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(title, r"(?U)\s*:\s*$", "")), F.lit(""))


def parse_recid(identifier: Column) -> Column:
    """The number after the last colon; null unless it is all ASCII digits. Too large a number raises."""
    tail = F.substring_index(identifier, ":", -1)
    return F.when(tail.rlike("^[0-9]+$"), tail.cast("long"))


def email_domain(email: Column) -> Column:
    """The piece behind the first @, lower case; null if there is none."""
    return F.nullif(F.split_part(F.lower(email), F.lit("@"), F.lit(2)), F.lit(""))


def render_array(a: Column) -> Column:
    return F.when(a.isNull(), "").when(F.size(a) == 0, "[]").otherwise(F.array_join(a, " | "))


def render_value(c: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return render_array(c)
    if kind.startswith("timestamp"):
        return F.coalesce(utc_text(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def utc_text(ts: Column) -> Column:
    """A timestamp as text with its offset, fractions of a second as far as there are; the session's time zone is UTC."""
    return F.concat(ts.cast("string"), F.lit("+00"))


def integer_prefix(text: str | None) -> int | None:
    """The integer a text begins with, as lenient parsers read it; None if there is none or it is beyond 64 bits."""
    m = re.match(r"\s*([+-]?[0-9]+)", text or "")
    value = int(m[1]) if m else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None
