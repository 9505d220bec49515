"""Secret scans with DataFrame functions alone: patterns, and Shannon entropy in a sliding window.

Patterns give the kinds assign, access and hex. Further candidates are runs of 20 and more key characters that hold a
letter and a digit. Each is of one character class (hex or base64); a window of 20 characters slides over it. The counts
of the window's characters are carried along, five bits each in six numbers, and with them the sum of n log n over the
counts n: a step changes those of the character that leaves and of the one that enters. A candidate whose highest window entropy reaches its class's threshold is a span, unless the allow-list
knows it. Spans are in code points, end exclusive.

Positions come from splitting the text by a pattern and from the matches between the parts, so a text is gone through
once a pattern, and only if it has a match at all. Positions are summed up by blocks of matches, so that many matches in
a text cost little more than their number. No pattern repeats a group but possessively: Java's matcher would need stack
for each repetition.

Defined results: a null text counts as empty: no spans, and a redacted null stays null; rows with equal or null
doc_id are scanned each by itself; an empty table gives no rows; other columns are ignored or, by redacted(), kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Bits a character that the best window must reach.
HEX_BITS = 3.0
BASE64_BITS = 3.75
#: Strings that look random and are no secrets: UUIDs, named digests, runs of the alphabet, dates, words and numbers joined by hyphens or underlines, placeholders.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(?:sha1|sha256|sha384|sha512|md5)[-=_]",
    r"(?i)example|placeholder|abcdefghij|0123456789",
    r"^\d{4}-\d{2}-\d{2}",
    r"^(?:[A-Za-z]++|\d++)(?:[-_/=+](?:[A-Za-z]++|\d++))++$",
)
PLACEHOLDER = "[SECRET]"
#: The characters of candidates; a window's count of each takes COUNT_BITS bits, COUNTS of them a number.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"
COUNT_BITS, COUNTS = 5, 12
#: Matches whose positions are summed up together.
SPANS = 128


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def _blocks(rows: Column) -> Column:
    """An array (of one row at least) in arrays of SPANS rows: what grows with the square of rows does so within and across blocks only."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / SPANS).cast("int")), lambda b: F.slice(rows, b * SPANS + 1, F.lit(SPANS)))


def located(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Matches as array<struct<start, kind, end, what>>, in order; those whose group is shorter than `least` are dropped."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,what:string>>")
    advance = lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + advance(x)
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["what"].alias("what"))
        more = F.when(F.length(x["what"]) >= least, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + advance(x)))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        of_block = lambda block, begin: F.aggregate(block, F.struct(begin.alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])
        return F.flatten(F.zip_with(blocks, _let(begins, lambda all_: F.slice(all_, F.lit(1), F.size(all_) - 1)), of_block))

    rows = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("what"))
    return F.when(text.rlike(pattern), _let(_let(rows, _blocks), placed)).otherwise(nothing)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any `window` consecutive characters of ALPHABET; texts are at least that long."""
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    units = F.array(*[F.lit(1 << (COUNT_BITS * k)) for k in range(COUNTS)])
    nothing = F.array(*[F.lit(0).cast("long")] * -(-len(ALPHABET) // COUNTS))

    def after(acc: Column, code: Column, by: int) -> Column:
        """counts and sum when the character's count changes by one."""
        cell = F.floor(code / COUNTS).cast("int")
        place = (code % COUNTS).cast("int")
        n = F.call_function("shiftright", F.get(acc["counts"], cell), place * COUNT_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
        counts = F.transform(acc["counts"], lambda x, k: F.when(k == cell, x + by * F.get(units, place)).otherwise(x))
        return _let(n, lambda n: F.struct(counts.alias("counts"), (acc["sum"] + F.get(terms, n + by) - F.get(terms, n)).alias("sum")))

    def step(acc: Column, pair: Column) -> Column:
        moved = _let(after(acc, pair["out"], -1), lambda rest: after(rest, pair["new"], 1))
        return _let(moved, lambda now: F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), F.least(acc["least"], now["sum"]).alias("least")))

    def slid(codes: Column) -> Column:
        first = F.aggregate(F.slice(codes, 1, window), F.struct(nothing.alias("counts"), F.lit(0.0).alias("sum")), lambda acc, code: after(acc, code, 1))
        # the pairs of the character that leaves and the one behind the window that enters
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - window), F.slice(codes, F.lit(window + 1), F.size(codes)), lambda out, new: F.struct(out.alias("out"), new.alias("new")))
        start = _let(first, lambda f: F.struct(f["counts"].alias("counts"), f["sum"].alias("sum"), f["sum"].alias("least")))
        return F.aggregate(pairs, start, step, lambda acc: acc["least"])

    least = _let(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), slid)
    return F.lit(math.log2(window)) - least / window


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW, hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS) -> Column:
    is_hex = lambda s: s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")

    def secret(x: Column) -> Column:
        known = F.lit(False)
        for pattern in allow:
            known = known | x["what"].rlike(pattern)
        mixed = x["what"].rlike("[0-9]") & x["what"].rlike("[A-Za-z]")
        return F.when(mixed & ~known, window_entropy(x["what"]) >= F.when(is_hex(x["what"]), hex_bits).otherwise(base64_bits)).otherwise(F.lit(False))

    kept = F.filter(located(text, CANDIDATE, 3), secret)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.when(is_hex(x["what"]), 3).otherwise(4).alias("kind"), x["end"].alias("end"), x["what"].alias("what")))


def found(text: Column) -> Column:
    """All spans of a text, by start, then kind: array<struct<start, kind, end>>."""
    text = F.coalesce(text, F.lit(""))
    spans = F.concat(located(text, ASSIGN, 0, 8, 1), located(text, ACCESS, 1), located(text, HEX, 2), entropy_spans(text))
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def shown(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, found (the spans)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found(F.col(text_col)).alias("found"))


def secret_report(docs: DataFrame) -> DataFrame:
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return scanned(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def without(text: Column, spans: Column, placeholder: str = PLACEHOLDER) -> Column:
    """The text with each stretch of spans (overlapping ones are one) put out by the placeholder."""

    def cut(block: Column, begin: Column) -> Column:
        """What is left of the text from begin to the block's last end."""
        end = F.greatest(begin, F.array_max(F.transform(block, lambda x: x["end"])))

        def step(acc: Column, x: Column) -> Column:
            kept = F.array(F.substring(acc["own"], acc["at"] - begin + 1, x["start"] - acc["at"]), F.lit(placeholder))
            out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], kept)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["own"].alias("own"), out.alias("out"))

        first = F.struct(begin.alias("at"), F.substring(text, begin + 1, end - begin).alias("own"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(block, first, step, lambda acc: F.array_join(acc["out"], ""))

    def done(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda x: x["end"])))
        begins = F.aggregate(ends, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), n))))
        return _let(begins, lambda all_: F.concat(F.array_join(F.zip_with(blocks, F.slice(all_, F.lit(1), F.size(all_) - 1), cut), ""), F.substring(text, F.element_at(all_, -1) + 1, F.length(text))))

    return F.when(F.size(spans) > 0, _let(_let(spans, _blocks), done)).otherwise(text)


def redacted(docs: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """All documents and columns; secrets in text are put out, and n_chars, if there, counts the new text."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), found(F.col("text")).alias("found"))
    whole = whole.select("whole", without(F.col("whole.text"), F.col("found"), placeholder).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean"), F.lit(0))}
    types = dict(docs.dtypes)
    columns = [new[c].cast(types[c]).alias(c) if c in new and (c == "text" or types[c] in ("bigint", "int")) else F.col(f"whole.`{c}`") for c in docs.columns]
    return whole.select(*columns)
