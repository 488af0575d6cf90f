"""The seven supported fields and their fixed vocabulary."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field keys in their fixed order, with their value types.
FIELD_TYPES = {
    "full_name": "string",
    "dob": "date",
    "phone": "phone",
    "address": "string",
    "insurance_member_id": "string",
    "allergies": "string_or_list",
    "medications": "string_or_list",
}

# Words that stand for a field in form field names and queries.
FIELD_ALIASES = {
    "full_name": ["full_name", "name", "patient_name"],
    "dob": ["dob", "date_of_birth", "birthdate"],
    "phone": ["phone", "mobile", "telephone"],
    "address": ["address", "street"],
    "insurance_member_id": ["insurance_member_id", "member_id", "policy", "insurance_id"],
    "allergies": ["allergies", "allergy"],
    "medications": ["medications", "meds"],
}

# Words that anchor a date or phone number, and the words that
# mark a line as one about insurance.
BIRTH_ANCHORS = ["dob", "date of birth", "birthdate", "birth date", "born"]
PHONE_ANCHORS = ["phone", "mobile", "telephone", "tel", "cell", "contact"]
INSURANCE_WORDS = ["member", "policy", "id", "insurance", "subscriber", "group"]
INSURANCE_NON_VALUES = ["member", "policy", "insurance", "group", "subscriber"]
ALLERGY_LABELS = ["allergies", "allergy", "allergic to", "known allergies"]
MEDICATION_LABELS = ["medications", "meds", "current medications", "prescriptions", "rx"]

# The allowed values of the enumerated columns.
SCHEMA_SOURCES = ["user_schema", "fillable_pdf", "fallback_v1"]
FIELD_STATUSES = ["filled", "needs_review", "missing"]
METHODS = ["heuristic", "llm"]
UNREADABLE_REASONS = ["no_text_layer", "parse_error"]

FIELD_KEYS = list(FIELD_TYPES)


def _tokens(words: list[str]) -> list[str]:
    found = re.sub("[^a-z0-9]", " ", " ".join(words).lower()).split()
    return sorted({t for t in found if len(t) > 1})


QUERY_TOKENS = {key: _tokens([key, *FIELD_ALIASES[key]]) for key in FIELD_KEYS}


def per_field(key: Column, choose: Callable[[str], Any]) -> Column:
    """Literal chosen by field key; NULL for an unknown key.

    The vocabulary is seven rows of code, so it is folded into the plan as a
    ``CASE`` instead of joined.
    """
    expr: Column | None = None
    for name in FIELD_KEYS:
        value = choose(name)
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(key == name, value) if expr is None else expr.when(key == name, value)
    return expr


def field_type(key: Column) -> Column:
    return per_field(key, FIELD_TYPES.get)


def literal_words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])
