"""Candidate values of each field, found in the pages routed to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.fields import (
    ALLERGY_LABELS, BIRTH_ANCHORS, INSURANCE_NON_VALUES, INSURANCE_WORDS,
    MEDICATION_LABELS, PHONE_ANCHORS,
)
from attesta.functions.matches import on_lines, page_matches
from attesta.functions.text import (
    WS, contains_any, let, normalize_text, strip, wide_digit_count,
)
from attesta.functions.values import normalize_date, normalize_phone, read_date
from attesta.schemas import EVIDENCE, SCORES

HIT = ("struct<seq1:int,seq2:int,raw:string,norm:string,quote:string,anchor:double,"
       "flags:array<string>>")
ANCHOR_WIDTH = 50

# Date shapes, case-insensitive, in the order they are tried.
DATE_PATTERNS = [
    r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b",
    r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b",
    r"\b([A-Za-z]+\s+\d{1,2},?\s+\d{4})\b",
    r"\b(\d{1,2}\s+[A-Za-z]+\s+\d{4})\b",
]
# Phone shapes in the order they are tried.
PHONE_PATTERNS = [
    r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
    r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\b1\d{10}\b",
    r"\b\d{10}\b",
]
# An identifier token and the labelled lines, case-insensitive.
ID_PATTERN = r"\b[A-Za-z0-9]{4,20}\b"
NAME_PATTERNS = [r"(?:patient\s+)?name\s*:\s*(.+)", r"full\s+name\s*:\s*(.+)", r"patient\s*:\s*(.+)"]
ADDRESS_PATTERNS = [r"address\s*:\s*(.+)", r"street\s*:\s*(.+)",
                    r"mailing\s+address\s*:\s*(.+)", r"home\s+address\s*:\s*(.+)"]


def _java(pattern: str, ignore_case: bool) -> str:
    """Flags and whitespace class that give the pattern its Unicode meaning."""
    widened = pattern.replace(r"[-.\s]", r"[-.\s\x1c-\x1f]").replace(r"\s*", WS + "*").replace(r"\s+", WS + "+")
    return ("(?idU)" if ignore_case else "(?dU)") + widened


def _hit(seq1: Column, seq2: Column, raw: Column, norm: Column, quote: Column,
         anchor: Column, flags: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        seq1.cast("int").alias("seq1"), seq2.cast("int").alias("seq2"), raw.alias("raw"),
        norm.alias("norm"), quote.alias("quote"), anchor.cast("double").alias("anchor"),
        (none if flags is None else flags).alias("flags"))


def _placed(found: Column, valued: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """Hits of page-wide patterns. ``valued`` gives the normal form of a match and its flags, or NULL."""
    none = F.array().cast("array<string>")
    hits = let(found, lambda page: F.transform(page["found"], lambda m, i: let(valued(m), lambda v: _hit(
        m["tag"], i, m["raw"], v["norm"], F.get(page["lines"], m["line"]), F.when(m["anchored"], 1.0).otherwise(0.0), F.coalesce(v["flags"], none)))))
    return F.filter(hits, lambda h: keep(h["norm"]) & (h["quote"] != ""))


def _with_digits(text: Column) -> Column:
    """Every shape holds four digits in a row; other pages need no scan."""
    return F.when(F.rlike(text, F.lit(r"(?U)\d{4}")), text)


_dates = page_matches(DATE_PATTERNS, True, BIRTH_ANCHORS, ANCHOR_WIDTH)
_phones = page_matches(PHONE_PATTERNS, False, PHONE_ANCHORS, ANCHOR_WIDTH)


def date_hits(text: Column, lowered: Column) -> Column:
    def valued(m: Column) -> Column:
        # The pattern that found the text tells the shape it starts with.
        norm = F.coalesce(*[F.when(m["tag"] == i, read_date(m["raw"], i)) for i in range(len(DATE_PATTERNS))])
        return F.struct(norm.alias("norm"), F.lit(None).cast("array<string>").alias("flags"))

    return _placed(_dates(_with_digits(text)), valued, lambda norm: norm.isNotNull())


def phone_hits(text: Column, lowered: Column) -> Column:
    def valued(m: Column) -> Column:
        return let(normalize_phone(m["raw"]), lambda p: F.struct(
            p["digits"].alias("norm"), F.when(p["assumed"], F.array(F.lit("default_country_assumed"))).alias("flags")))

    return _placed(_phones(_with_digits(text)), valued, lambda norm: F.length(norm) >= 10)


def insurance_hits(text: Column, lowered: Column) -> Column:
    one = F.lit(1.0)

    def tokens_of(line: Column, number: Column) -> Column:
        words = F.transform(F.regexp_extract_all(line, F.lit(_java(ID_PATTERN, False)), F.lit(0)),
                            lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        kept = F.filter(words, lambda t: ~F.lower(t["w"]).isin(INSURANCE_NON_VALUES)
                        & normalize_date(t["w"]).isNull())
        hits = F.filter(F.transform(kept, lambda t: _hit(
            number, t["i"], t["w"], normalize_text(t["w"]), strip(line), one)), lambda h: h["norm"] != "")
        return F.when(let(F.lower(line), lambda low: contains_any(low, INSURANCE_WORDS)), hits).otherwise(
            F.array().cast(f"array<{HIT}>"))

    return on_lines(text, tokens_of)


def labelled_hits(text: Column, patterns: list[str], clean: Callable[[Column], Column],
                  valid: Callable[[Column], Column]) -> Column:
    """Hits of ``label: value`` patterns, the first match of each per line."""
    def of_line(line: Column, number: Column) -> Column:
        values = [F.struct(F.lit(i).alias("i"), clean(strip(F.regexp_extract(line, _java(p, True), 1))).alias("raw"))
                  for i, p in enumerate(patterns)]
        kept = F.filter(F.array(*values), lambda v: valid(v["raw"]))
        hits = F.filter(F.transform(kept, lambda v: _hit(
            number, v["i"], v["raw"], normalize_text(v["raw"]), strip(line), F.lit(1.0))),
            lambda h: h["norm"] != "")
        return F.when(F.contains(line, F.lit(":")), hits).otherwise(F.array().cast(f"array<{HIT}>"))

    return on_lines(text, of_line)


def name_hits(text: Column, lowered: Column) -> Column:
    return labelled_hits(
        text, NAME_PATTERNS,
        clean=lambda raw: strip(F.regexp_replace(raw, r"[,;:.|]+\z", "")),
        valid=lambda raw: F.length(raw).between(2, 100) & (wide_digit_count(raw) * 2 <= F.length(raw)))


def address_hits(text: Column, lowered: Column) -> Column:
    return labelled_hits(text, ADDRESS_PATTERNS, clean=lambda raw: raw,
                         valid=lambda raw: F.length(raw) >= 5)


def list_hits(labels: list[str]) -> Callable[[Column, Column], Column]:
    pattern = f"(?:{'|'.join(labels)})" + r"\s*:\s*(.+)"
    return lambda text, lowered: labelled_hits(
        text, [pattern], clean=lambda raw: raw, valid=lambda raw: F.length(raw) >= 2)


# Field key -> function of (page text, lower-cased page text) giving an array of
# hits. Further entries may be added for keys of one's own.
EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {
    "full_name": name_hits,
    "dob": date_hits,
    "phone": phone_hits,
    "address": address_hits,
    "insurance_member_id": insurance_hits,
    "allergies": list_hits(ALLERGY_LABELS),
    "medications": list_hits(MEDICATION_LABELS),
}


_HIT = ["seq1", "seq2", "raw", "norm", "quote", "anchor", "flags"]


def asked_pages(routing: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of the routed documents, each once, with the fields asked of their document; unknown documents drop out.

    ``asked`` holds a document's fields and ranks, and ``bits`` has one for each of ``keys`` among them.
    Documents are grouped by a struct, so that the join deals both its sides anew and a document
    of very many pages can be split there.
    """
    bit = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("field")) - 1
    asked = (routing.filter(F.col("field").isin(keys)).withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))
             .groupBy(F.struct("run_id", "doc_id").alias("doc"))
             .agg(F.collect_list(F.struct("field", "doc_rank")).alias("asked"), F.bit_or("bit").alias("bits")))
    return asked.select("doc.run_id", "doc.doc_id", "asked", "bits").join(pages, ["run_id", "doc_id"])


def _hits(extractors: dict[str, Callable[[Column, Column], Column]]) -> Column:
    """The hits of all fields asked of a page. Each extractor sees the pages of its own field only, as Python functions run for every row."""
    parts = []
    for i, (key, extractor) in enumerate(extractors.items()):
        own = F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        ranks = F.filter("asked", lambda a: a["field"] == key)
        told = lambda found: F.flatten(F.transform(ranks, lambda a: F.transform(found, lambda h: F.struct(
            a["field"].alias("field"), a["doc_rank"].alias("doc_rank"), *[h[c].alias(c) for c in _HIT]))))
        parts.append(F.when(own, let(extractor(F.when(own, F.col("full_text")), F.when(own, F.lower("full_text"))), told)))
    return F.flatten(F.array_compact(F.array(*parts)))


def heuristic_candidates(routing: DataFrame, pages: DataFrame,
                         extractors: dict[str, Callable[[Column, Column], Column]] | None = None,
                         ) -> DataFrame:
    """Candidates of every field, one per value and document, first place wins.

    All fields are handled in one pass: each page meets the fields asked of its document
    once, and only their extractors run on it.
    """
    extractors = EXTRACTORS if extractors is None else extractors
    joined = asked_pages(routing, pages, list(extractors)).select("run_id", "doc_id", "page", "page_ord", "asked", "bits", "full_text")
    rows = joined.select("run_id", "doc_id", "page", "page_ord", F.inline(_hits(extractors)))
    first = F.min(F.struct("page_ord", "seq1", "seq2", "page", "raw", "quote", "anchor", "flags"))
    kept = rows.groupBy("run_id", "field", "doc_rank", "doc_id", "norm").agg(first.alias("h"))
    zero = F.lit(0.0)
    return kept.select(
        "run_id", "field", F.col("h.raw").alias("raw_value"), F.col("norm").alias("normalized_value"),
        F.array(F.struct(F.col("doc_id"), F.col("h.page").alias("page"),
                         F.col("h.quote").alias("quoted_text"),
                         F.lit(None).cast("array<double>").alias("bbox"))).cast(f"array<{EVIDENCE}>")
        .alias("evidence"),
        F.lit("heuristic").alias("from_method"), F.col("h.flags").alias("validators"),
        F.array().cast("array<string>").alias("rejected_reasons"),
        F.struct(F.col("h.anchor"), zero, zero, zero, zero).cast(SCORES).alias("scores"),
        F.array("doc_rank", "h.page_ord", "h.seq1", "h.seq2").alias("seq"))
