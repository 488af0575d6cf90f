"""Normal forms of dates and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.fields import field_type
from attesta.functions.text import WS, ascii_digits, digits, let, lookup, normalize_text

# Month names; a three-letter form stands for the month as well.
MONTHS = ["january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december"]

# Date shapes a value may start with, and where year, month and day sit.
_SHAPES = [
    (r"(?U)^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", (1, 2, 3)),
    (r"(?U)^(\d{1,2})[-/](\d{1,2})[-/](\d{4})", (3, 1, 2)),
    (rf"(?iU)^([a-zA-Z]+){WS}*(\d{{1,2}}),?{WS}*(\d{{4}})", (3, 1, 2)),
    (rf"(?iU)^(\d{{1,2}}){WS}+([a-zA-Z]+){WS}+(\d{{4}})", (3, 2, 1)),
]


def month_number(name: Column) -> Column:
    """Two-digit month of an English month name or its first three letters."""
    table = {n: f"{i:02d}" for i, full in enumerate(MONTHS, 1) for n in (full, full[:3])}
    return lookup(table)[F.lower(name)]


def read_date(c: Column, shape: int) -> Column:
    """``YYYY-MM-DD`` of a value known to start with the given shape.

    NULL only for an unknown month name. The calendar is not consulted, so
    month 99 passes.
    """
    pattern, (year, month, day) = _SHAPES[shape]
    part = lambda group: F.regexp_extract(c, pattern, group)
    two = lambda text: F.lpad(ascii_digits(text), 2, "0")
    named = shape >= 2
    mm = month_number(part(month)) if named else two(part(month))
    return F.concat(part(year), F.lit("-"), mm, F.lit("-"), two(part(day)))


def normalize_date(c: Column) -> Column:
    """``YYYY-MM-DD`` of a value starting with a date, else NULL; shapes in order."""
    return F.coalesce(*[F.when(F.rlike(c, F.lit(pattern)), read_date(c, i))
                        for i, (pattern, _) in enumerate(_SHAPES)])


def normalize_phone(c: Column) -> Column:
    """Struct of the digits and whether a leading 1 was assumed (ten digits)."""
    def build(d: Column) -> Column:
        assumed = F.length(d) == 10
        return F.struct(F.when(assumed, F.concat(F.lit("1"), d)).otherwise(d).alias("digits"),
                        assumed.alias("assumed"))

    return let(digits(c), build)


def normalize_for_field(field: Column, raw: Column) -> Column:
    """Normal form of a raw value by the type of its field."""
    kind = field_type(field)
    return (F.when(kind == "date", F.coalesce(normalize_date(raw), normalize_text(raw)))
            .when(kind == "phone", normalize_phone(raw)["digits"])
            .otherwise(normalize_text(raw)))
