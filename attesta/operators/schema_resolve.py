"""Which fields a bundle asks for: its own schema, else a form, else all seven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.fields import FIELD_ALIASES, FIELD_KEYS, FIELD_TYPES
from attesta.functions import json as J
from attesta.functions.text import contains_any
from attesta.schemas import FIELD_SPEC
from attesta.settings import RunOptions

_SPECS = f"array<{FIELD_SPEC}>"
_DETAILS = "map<string,string>"


def _spec(key: str, label: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), label.alias("label"), F.lit(FIELD_TYPES[key]).alias("type"))


def ordered_specs(present: dict[str, Column], label: dict[str, Column], max_fields: int) -> Column:
    """Field specs in the fixed order, the first ``max_fields`` of those present."""
    every = F.array(*[F.when(present[k], _spec(k, label[k])) for k in FIELD_KEYS])
    return F.slice(F.filter(every, lambda s: s.isNotNull()), 1, max_fields).cast(_SPECS)


def parse_user_schemas(user_schemas: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """(run_id, resolved_fields, unsupported_fields, message) of each user schema.

    ``message`` is set for an invalid document and the fields are then NULL. A
    key given twice keeps its last label; the type comes from the key alone.
    Everything happens inside the row, so nothing is shuffled.
    """
    doc = user_schemas.select("run_id", J.parse(J.decode_utf8(F.col("schema_json"))).alias("doc"))
    fields = J.member(F.col("doc"), "fields")
    # The wording of the three messages.
    message = (F.when(F.col("doc").isNull(), "Failed to parse schema JSON")
               .when(~J.is_object(F.col("doc")) | fields.isNull(),
                     "Schema JSON must be an object with a 'fields' array")
               .when(J.items(fields).isNull(), "'fields' must be an array"))
    text = lambda v, name: F.when(J.kind(J.member(v, name)) == "STRING", J.member(v, name, "string"))
    read = F.transform(F.filter(J.items(fields), J.is_object), lambda v: F.struct(
        text(v, "key").alias("key"), text(v, "label").alias("label")))
    parsed = doc.select("run_id", message.alias("message"),
                        F.filter(read, lambda s: s["key"].isNotNull()).alias("given"))

    def with_key(key: str) -> Column:
        return F.filter("given", lambda s: s["key"] == key)

    of_key = {k: with_key(k) for k in FIELD_KEYS}
    specs = ordered_specs({k: F.size(v) > 0 for k, v in of_key.items()},
                          {k: F.try_element_at(v, F.lit(-1))["label"] for k, v in of_key.items()},
                          options.max_fields)
    unknown = F.transform(F.filter("given", lambda s: ~s["key"].isin(FIELD_KEYS)), lambda s: s["key"])
    valid = F.col("message").isNull()
    return parsed.select("run_id", F.when(valid, specs).alias("resolved_fields"),
                         F.when(valid, unknown).alias("unsupported_fields"), "message")


def matching_keys(field_name: Column) -> Column:
    """Keys with an alias inside the lower-cased form field name."""
    lowered = F.lower(field_name)
    return F.filter(F.array(*[F.when(contains_any(lowered, FIELD_ALIASES[k]), k) for k in FIELD_KEYS]),
                    lambda k: k.isNotNull())


def match_form_fields(form_fields: DataFrame) -> DataFrame:
    """Matching keys of every field of every form file, with the file's place in order."""
    name = F.col("file_name")
    place = F.struct(F.lower(name).alias("lowered"), (~name.endswith(".pdf")).alias("upper"), name)
    return (form_fields.filter(name.endswith(".pdf") | name.endswith(".PDF"))
            .withColumn("keys", matching_keys(F.col("field_name")))
            .withColumn("key", F.when(F.size("keys") == 1, F.col("keys")[0]))
            .withColumn("place", place))


def first_forms(matched: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """The first file of each bundle with a mappable field, and the specs it gives."""
    files = (matched.filter(F.col("key").isNotNull()).groupBy("run_id", "place")
             .agg(F.collect_set("key").alias("keys")))
    first = files.groupBy("run_id").agg(F.min(F.struct("place", "keys")).alias("f"))
    specs = ordered_specs({k: F.array_contains("f.keys", k) for k in FIELD_KEYS},
                          {k: F.lit(None).cast("string") for k in FIELD_KEYS}, options.max_fields)
    return first.select("run_id", F.col("f.place").alias("place"), specs.alias("resolved_fields"))


def fallback_specs(options: RunOptions = RunOptions()) -> Column:
    none = F.lit(None).cast("string")
    return F.array(*[_spec(k, none) for k in FIELD_KEYS[:options.max_fields]]).cast(_SPECS)


def fallback_schemas(runs: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    return runs.select("run_id", F.lit("fallback_v1").alias("schema_source"),
                       fallback_specs(options).alias("resolved_fields"),
                       F.array().cast("array<string>").alias("unsupported_fields"))


def resolve_schemas(runs: DataFrame, user_schemas: DataFrame, form_fields: DataFrame,
                    options: RunOptions = RunOptions()) -> DataFrame:
    """One schema per bundle: a valid user schema, else its first form, else all fields."""
    user = parse_user_schemas(user_schemas, options).filter("message IS NULL").select(
        "run_id", F.col("resolved_fields").alias("user_specs"), "unsupported_fields")
    form = first_forms(match_form_fields(form_fields), options).select(
        "run_id", F.col("resolved_fields").alias("form_specs"))
    given = F.col("user_specs").isNotNull()
    mapped = F.col("form_specs").isNotNull()
    return (runs.select("run_id").join(user, "run_id", "left").join(form, "run_id", "left")
            .select("run_id",
                    F.when(given, "user_schema").when(mapped, "fillable_pdf").otherwise("fallback_v1")
                    .alias("schema_source"),
                    F.coalesce("user_specs", "form_specs", fallback_specs(options)).alias("resolved_fields"),
                    F.coalesce("unsupported_fields", F.array().cast("array<string>"))
                    .alias("unsupported_fields")))


def schema_fields(schemas: DataFrame) -> DataFrame:
    """Flat form: one row per resolved field with its 0-based position."""
    return schemas.select("run_id", F.posexplode("resolved_fields").alias("ord", "f")).select(
        "run_id", "ord", "f.key", "f.label", "f.type")


def schema_warnings(user_schemas: DataFrame, form_fields: DataFrame,
                    options: RunOptions = RunOptions()) -> DataFrame:
    """(run_id, kind, message, details) of everything that was skipped over.

    Forms are looked at in order until one maps, and only without a valid user
    schema, so later files give no warnings. A form that could not be read may
    be passed as a row with a ``read_error`` column.
    """
    user = parse_user_schemas(user_schemas, options)
    none = F.lit(None).cast(_DETAILS)
    invalid = user.filter("message IS NOT NULL").select(
        "run_id", F.lit("user_schema_invalid").alias("kind"), "message", none.alias("details"))

    matched = match_form_fields(form_fields)
    stop = first_forms(matched, options).select("run_id", F.col("place").alias("stop"))
    seen = (matched.join(user.filter("message IS NULL").select("run_id"), "run_id", "left_anti")
            .join(stop, "run_id", "left").filter(F.col("stop").isNull() | (F.col("place") <= F.col("stop"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform("keys", lambda k: F.concat(
        F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    ambiguous = seen.filter(F.size("keys") > 1).select(
        "run_id", F.lit("acroform_ambiguous_field").alias("kind"),
        F.concat(F.lit("Field '"), "field_name", F.lit("' matches multiple keys: "), listed).alias("message"),
        F.create_map(F.lit("field_name"), F.col("field_name"), F.lit("matched_keys"), listed).alias("details"))
    out = invalid.unionByName(ambiguous)
    if "read_error" in form_fields.columns:
        out = out.unionByName(seen.filter("read_error IS NOT NULL").select(
            "run_id", F.lit("acroform_read_error").alias("kind"),
            F.concat(F.lit("Failed to read AcroForm fields from "), "file_name", F.lit(": "), "read_error")
            .alias("message"), none.alias("details")))
    return out
