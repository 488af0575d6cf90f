"""JSON text as VARIANT, with the acceptance rules of a strict parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import let


def decode_utf8(content: Column) -> Column:
    """Text of UTF-8 bytes; NULL for an invalid sequence."""
    return F.try_validate_utf8(content.cast("string"))


def parse(text: Column) -> Column:
    """The document as VARIANT; NULL unless the whole text is one JSON value.

    The built-in parser stops after the first value. Wrapped as an array item
    and as an object member, trailing text breaks at least one of the two.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(as_member.isNotNull(), F.try_variant_get(as_item, "$[0]", "variant"))


def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def items(v: Column) -> Column:
    """The elements of an array; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def member(v: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", as_type)


def objects(v: Column, **members: str) -> Column:
    """The objects of an array in order, each cut down to the named members of the given types; NULL for anything but an array.

    One cast reads them all. A member that is missing or cannot be read as its type is NULL.
    """
    kinds = ", ".join(f"{name}: {kind}" for name, kind in members.items())
    return F.filter(F.try_variant_get(v, "$", f"array<struct<{kinds}>>"), lambda o: o.isNotNull())


def told(v: Column) -> Column:
    """A value's type and its text as ``schema`` and ``text``, each read once; the type of a missing one is NULL."""
    return F.struct(F.schema_of_variant(v).alias("schema"), F.try_variant_get(v, "$", "string").alias("text"), v.alias("v"))


def told_text(t: Column) -> Column:
    """``text_of`` a value that has been ``told``."""
    return F.when(t["schema"] == "BOOLEAN", F.initcap(t["text"])).otherwise(t["text"])


def told_given(t: Column) -> Column:
    """``is_given`` of a value that has been ``told``."""
    schema, text = t["schema"], t["text"]
    begins = lambda name: F.startswith(schema, F.lit(name))
    return F.coalesce(F.when(schema == "STRING", text != "")
                      .when(schema == "BOOLEAN", text == "true")
                      .when(schema.isin("BIGINT", "DOUBLE", "FLOAT") | begins("DECIMAL"), F.try_variant_get(t["v"], "$", "double") != 0)
                      .when(begins("ARRAY"), text != "[]")
                      .when(begins("OBJECT"), text != "{}"), F.lit(False))


def text_of(v: Column) -> Column:
    """A scalar or nested value as text; NULL for a missing or null value."""
    return let(told(v), told_text)


def is_given(v: Column) -> Column:
    """False for a missing value, null, false, zero, and an empty text, array or object."""
    return let(told(v), told_given)
