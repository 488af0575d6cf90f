"""String expressions. Everything here is a Column built from Spark functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as whitespace, from the Unicode whitespace rule plus the
# four information separators.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Regex class for the same set; needs the (?U) flag.
WS = r"[\s\x1c-\x1f]"


def _ranges(test: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Maximal code point ranges whose characters pass ``test``."""
    out: list[tuple[int, int]] = []
    for code in range(0x20000):
        if test(chr(code)):
            if out and out[-1][1] == code - 1:
                out[-1] = (out[-1][0], code)
            else:
                out.append((code, code))
    return out


# Digits in the wide sense (superscripts and circled digits included).
_WIDE_DIGITS = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _ranges(str.isdigit))
# Decimal digits of other scripts and the ASCII digit each one stands for.
_FOREIGN = [c for a, b in _ranges(str.isdecimal) for c in map(chr, range(a, b + 1)) if c > "9"]
_FOREIGN_DIGITS = "".join(_FOREIGN)
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(table: dict[str, str]) -> Column:
    """A constant map. Keys and values hold neither comma nor equals sign."""
    return F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in table.items())), F.lit(","), F.lit("="))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def contains_any(c: Column, words: list[str]) -> Column:
    """True when ``c`` holds any of the fixed words."""
    found = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(c, F.lit(word))
    return found


def normalize_text(c: Column) -> Column:
    """Lower case, single spaces, only word characters, spaces and hyphens.

    Whitespace collapses before punctuation goes, so a lone symbol between two
    words leaves two spaces.
    """
    spaced = F.regexp_replace(F.lower(c), rf"(?U){WS}+", " ")
    return strip(F.regexp_replace(spaced, r"(?U)[^\p{L}\p{N}_ \-]", ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, _FOREIGN_DIGITS, _ASCII_DIGITS)


def wide_digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{_WIDE_DIGITS}]", ""))


def tokenize(c: Column) -> Column:
    """Distinct lower-case ASCII alphanumeric tokens of two or more characters."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_distinct(words)


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query tokens the document has; 0 for an empty query."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(query, doc)) / F.size(query))


def utc_text(ts: Column) -> Column:
    """ISO-8601 text of a timestamp with microseconds; the session zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
