"""Pattern matches with their place in a text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_MATCH = StructType().add("tag", "integer").add("raw", "string").add("line", "integer").add("anchored", "boolean")
MATCHES = StructType().add("lines", ArrayType(StringType())).add("found", ArrayType(_MATCH))


def find_all(text: str, patterns: list[re.Pattern], words: list[str], width: int) -> tuple[list[str], list[int], list[int], list[bool]]:
    """Matches of each pattern in turn: what matched, which pattern, on which line it starts, and if a word stands before it.

    A page is gone through once a pattern. The line of a match comes by bisection from the
    starts of all lines, and at most ``width`` characters before it are looked at, so a page
    twice as long costs twice.
    """
    lowered = text.lower()
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    raw, tags, lines, anchored = [], [], [], []
    for tag, pattern in enumerate(patterns):
        for m in pattern.finditer(text):
            at = m.start()
            near = lowered[max(0, at - width):at]
            raw.append(m.group())
            tags.append(tag)
            lines.append(bisect_right(starts, at) - 1)
            anchored.append(any(w in near for w in words))
    return raw, tags, lines, anchored


def page_matches(patterns: list[str], ignore_case: bool, words: list[str], width: int) -> Callable[[Column], Column]:
    """Every non-overlapping match of each pattern in a text, pattern after pattern.

    Gives the stripped match, the place among ``lines`` of the line it starts on, and whether
    one of ``words`` stands within ``width`` characters before it; ``lines`` has the stripped
    lines that hold a match, each once. A match may run across line ends, so it is found on
    the whole page. Spark's functions give no offsets of matches; rebuilding them from gaps
    copies a growing array, so this runs in Arrow batches. A null text has none.
    """
    compiled = [re.compile(p, re.IGNORECASE if ignore_case else 0) for p in patterns]

    @F.arrow_udf(MATCHES)
    def matches(texts: pa.Array) -> pa.Array:
        ends, line_ends, lines, raw, tags, at, anchored = [0], [0], [], [], [], [], []
        for text in texts.to_pylist():
            if text is not None:
                found, which, on, near = find_all(text, compiled, words, width)
                rows = text.split("\n") if found else []
                place = {line: i for i, line in enumerate(sorted(set(on)))}
                lines += [rows[i].strip() for i in place]
                raw += [r.strip() for r in found]
                tags += which
                at += [place[i] for i in on]
                anchored += near
            ends.append(len(raw))
            line_ends.append(len(lines))
        each = pa.StructArray.from_arrays([pa.array(tags, pa.int32()), pa.array(raw, pa.string()), pa.array(at, pa.int32()), pa.array(anchored, pa.bool_())],
                                          ["tag", "raw", "line", "anchored"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(line_ends, pa.int32()), pa.array(lines, pa.string())),
                                           pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["lines", "found"])

    return matches


def on_lines(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Concatenate ``body(line, line_number)`` arrays over the lines of a text."""
    return F.flatten(F.transform(F.split(text, "\n", -1), body))
