"""Counts, the model gate and the order of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.evidence import is_accepted
from attesta.operators.numbering import with_position
from attesta.settings import RunOptions, written

FIELD = ["run_id", "field"]


def provisional_confidence() -> Column:
    return F.col("scores.anchor_match") * 0.45


def resolved(schema_fields: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """The fields a bundle extracts, in order, as (run_id, field, label)."""
    return (schema_fields.filter(F.col("ord") < options.max_fields)
            .select("run_id", F.col("key").alias("field"), "label"))


def routed_fields(schema_fields: DataFrame, routing: DataFrame, doc_index: DataFrame,
                  options: RunOptions = RunOptions()) -> DataFrame:
    """Fields of each bundle and whether a document with pages was routed to them.

    The document index says which ones have pages, so no page is looked at.
    """
    documents = doc_index.filter("pages > 0").select("run_id", "doc_id")
    present = (routing.join(documents, ["run_id", "doc_id"], "left_semi")
               .select(*FIELD).distinct().withColumn("routed", F.lit(True)))
    return (resolved(schema_fields, options).join(present, FIELD, "left")
            .withColumn("routed", F.coalesce("routed", F.lit(False))))


def model_gate(fields: DataFrame, heuristics: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """Best accepted confidence per routed field and whether to ask the model."""
    best = heuristics.groupBy(*FIELD).agg(
        F.max(F.when(is_accepted(), provisional_confidence())).alias("best_confidence"))
    return (fields.filter("routed").join(best, FIELD, "left")
            .select(*FIELD, "label", "best_confidence",
                    (F.coalesce("best_confidence", F.lit(-1.0)) < options.autofill_threshold)
                    .alias("call_model")))


def field_stats(fields: DataFrame, gate: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts per field; a field without routed documents has zeros."""
    counts = candidates.groupBy(*FIELD).agg(
        F.count_if(F.col("from_method") == "heuristic").alias("heuristic_count"),
        F.count_if(is_accepted()).alias("accepted_count"),
        F.count_if(~is_accepted()).alias("rejected_count"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return (fields.select(*FIELD)
            .join(gate.select(*FIELD, F.col("call_model").alias("llm_used")), FIELD, "left")
            .join(counts, FIELD, "left")
            .select(*FIELD, zero("heuristic_count"), F.coalesce("llm_used", F.lit(False)).alias("llm_used"),
                    zero("accepted_count"), zero("rejected_count")))


def method_rank(method: Column) -> Column:
    return F.when(method == "heuristic", 0).when(method == "llm", 1).otherwise(2)


def sort_candidates(candidates: DataFrame) -> DataFrame:
    """Each candidate's ``place`` in its bundle: field, heuristic before model, value; ties keep the order of finding.

    Places are counted behind one sort of all candidates, so a hot bundle is ranked by many tasks.
    """
    ordered = candidates.orderBy("run_id", "field", method_rank(F.col("from_method")), "normalized_value", "seq")
    return with_position(written(ordered.withColumn("_row", F.monotonically_increasing_id()), "ordered"), "run_id", "_row", "place").drop("_row")


def with_kind(errors: DataFrame) -> DataFrame:
    """Errors with their kind; a table that names none holds invalid answers."""
    return errors if "kind" in errors.columns else errors.withColumn("kind", F.lit("llm_invalid_json"))


def field_events(stats: DataFrame, model_errors: DataFrame | None = None) -> DataFrame:
    """Step rows ``field:<key>:heuristic`` and ``field:<key>:llm`` of routed fields.

    ``stats`` carries a ``routed`` column; ``model_errors`` has
    (run_id, field, message) and maybe a kind for fields without a usable model answer.
    """
    step = lambda kind: F.concat(F.lit("field:"), F.col("field"), F.lit(f":{kind}")).alias("step")
    no_error = F.lit(None).cast("struct<kind:string,message:string>").alias("error")
    first = stats.filter("routed").select("run_id", step("heuristic"), F.lit("ok").alias("status"), no_error)
    asked = stats.filter("llm_used").select(*FIELD)
    if model_errors is None:
        second = asked.select("run_id", step("llm"), F.lit("ok").alias("status"), no_error)
    else:
        failed = F.col("message").isNotNull()
        # Fixed value: the name of the error of an invalid answer.
        name = F.when(F.col("kind") == "llm_unavailable", "LLMUnavailableError").otherwise("LLMInvalidJSONError")
        second = asked.join(with_kind(model_errors).select(*FIELD, "message", "kind"), FIELD, "left").select(
            "run_id", step("llm"), F.when(failed, "error").otherwise("ok").alias("status"),
            F.when(failed, F.struct(name.alias("kind"), F.col("message"))).alias("error"))
    return first.unionByName(second)
