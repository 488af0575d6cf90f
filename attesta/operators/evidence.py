"""Does the quoted evidence support the value it is quoted for?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.fields import field_type
from attesta.functions.text import ascii_digits, digits, let, normalize_text, strip
from attesta.functions.values import MONTHS

UNSUPPORTED = "unsupported_by_evidence"
_DATE = r"(?U)^(\d{4})-(\d{2})-(\d{2})"


def _quotes(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: e["quoted_text"])


def supports_string(value: Column, evidence: Column) -> Column:
    return let(normalize_text(value), lambda v: F.exists(
        _quotes(evidence), lambda q: F.contains(normalize_text(q), v)))


def supports_date(value: Column, evidence: Column) -> Column:
    """Some quote shows the date in digits, or its year, day and month name."""
    year, month, day = (F.regexp_extract(value, _DATE, i) for i in (1, 2, 3))
    plain = lambda part: ascii_digits(part).try_cast("int").cast("string")
    name = F.element_at(F.array(*[F.lit(m[:3]) for m in MONTHS]),
                        F.when(F.rlike(month, F.lit("^(0[1-9]|1[0-2])$")), month.try_cast("int")))
    parts = F.struct(
        F.array(F.concat_ws("-", year, month, day), F.concat_ws("-", year, plain(month), plain(day)),
                F.concat_ws("-", month, day, year), F.concat_ws("-", plain(month), plain(day), year))
        .alias("forms"),
        year.alias("year"), F.ltrim(day, F.lit("0")).alias("day"), name.alias("name"))

    def shown(p: Column, quote: Column) -> Column:
        # Slash and hyphen are interchangeable between the numbers.
        dashed = F.translate(quote, "/", "-")
        in_digits = let(dashed, lambda t: F.exists(p["forms"], lambda f: F.contains(t, f)))
        in_words = (F.contains(quote, p["year"]) & F.contains(quote, p["day"])
                    & F.coalesce(F.contains(F.lower(quote), p["name"]), F.lit(False)))
        return in_digits | in_words

    return F.when(F.rlike(value, F.lit(_DATE)),
                  let(parts, lambda p: F.exists(_quotes(evidence), lambda q: shown(p, q)))
                  ).otherwise(F.lit(False))


def supports_phone(value: Column, evidence: Column) -> Column:
    def found(v: Column) -> Column:
        local = F.when(F.startswith(v, F.lit("1")), F.substring(v, F.lit(2), F.length(v)))
        return (F.length(v) >= 10) & F.exists(_quotes(evidence), lambda q: let(
            digits(q), lambda d: F.contains(d, v) | F.coalesce(F.contains(d, local), F.lit(False))))

    return let(digits(value), found)


def supports_list(value: Column, evidence: Column) -> Column:
    items = F.filter(F.transform(F.split(value, "[,;]", -1), strip), lambda i: i != "")
    whole = normalize_text(F.array_join(_quotes(evidence), " "))
    every = let(whole, lambda w: F.forall(items, lambda i: F.contains(w, normalize_text(i))))
    return F.when(F.rlike(value, F.lit("[,;]")), (F.size(items) > 0) & every).otherwise(
        supports_string(value, evidence))


def supported(field: Column, value: Column, evidence: Column) -> Column:
    """Every evidence entry is complete and the test for the field's type passes."""
    complete = (F.size(evidence) > 0) & F.forall(evidence, lambda e: (
        (e["doc_id"] != "") & (e["page"] != 0) & (e["quoted_text"] != "")))
    kind = field_type(field)
    fits = (F.when(kind == "date", supports_date(value, evidence))
            .when(kind == "phone", supports_phone(value, evidence))
            .when(kind == "string_or_list", supports_list(value, evidence))
            .otherwise(supports_string(value, evidence)))
    return F.coalesce(complete, F.lit(False)) & fits


def check_evidence(candidates: DataFrame) -> DataFrame:
    """Mark unsupported candidates with a reason; nothing is dropped."""
    ok = supported(F.col("field"), F.col("normalized_value"), F.col("evidence"))
    return candidates.withColumn("rejected_reasons", F.when(ok, F.col("rejected_reasons")).otherwise(
        F.array_append("rejected_reasons", F.lit(UNSUPPORTED))))


def is_accepted() -> Column:
    return F.size("rejected_reasons") == 0
