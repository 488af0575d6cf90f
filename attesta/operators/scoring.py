"""Validators, confidence, contradiction, winner and final value of each field."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.fields import per_field
from attesta.functions.text import digits, is_blank, wide_digit_count
from attesta.operators.candidates import FIELD, method_rank, resolved, with_kind
from attesta.operators.evidence import is_accepted
from attesta.operators.routing import is_readable
from attesta.schemas import CANDIDATE, EVIDENCE
from attesta.settings import RunOptions

# Weights, bonuses, limits and validator scores.
ANCHOR_WEIGHT, VALIDATOR_WEIGHT, RELEVANCE_WEIGHT = 0.45, 0.30, 0.25
AGREEMENT_BONUS, CONTRADICTION_PENALTY, CONTRADICTION_FLOOR = 0.10, 0.30, 0.60
PASS, WARN, FAIL = 1.0, 0.6, 0.0
ASSUMED = "default_country_assumed"
ALTERNATIVES = 2


def validator_score(field: Column, value: Column, validators: Column, as_of: datetime.date) -> Column:
    """Pass, warn or fail of the checks of a field; ``as_of`` stands for today."""
    present = ~is_blank(value)
    date = F.try_to_date(value, "yyyy-MM-dd")
    today = F.lit(as_of)
    check = {
        "full_name": present & F.rlike(value, F.lit(r"\p{L}")) & (wide_digit_count(value) * 2 <= F.length(value)),
        "dob": date.isNotNull() & (date <= today) & (date > F.add_months(today, -1440)),
        "phone": F.length(digits(value)) >= 10,
        "address": present,
        "insurance_member_id": F.length(value).between(4, 32),
        "allergies": present,
        "medications": present,
    }
    ok = F.coalesce(per_field(field, check.get), F.lit(False))
    return F.when(~ok, FAIL).when(F.array_contains(validators, ASSUMED), WARN).otherwise(PASS)


def with_relevance(candidates: DataFrame, routing: DataFrame) -> DataFrame:
    """Add the routing score of the document of the first evidence entry.

    Candidates meet the few documents of their field: the join deals by field, as all that follows does,
    and compares documents within it, which the two bounds below say without naming a further key.
    """
    named = candidates.withColumn("doc_id", F.get("evidence", F.lit(0))["doc_id"]).alias("c")
    scores = routing.select(*FIELD, "doc_id", F.col("score").alias("relevance")).alias("r")
    same_field = (F.col("c.run_id") == F.col("r.run_id")) & (F.col("c.field") == F.col("r.field"))
    same_doc = (F.col("c.doc_id") <= F.col("r.doc_id")) & (F.col("c.doc_id") >= F.col("r.doc_id"))
    return (named.join(scores, same_field & same_doc, "left")
            .select("c.*", F.coalesce("r.relevance", F.lit(0.0)).alias("relevance")))


def _clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def score_candidates(candidates: DataFrame, routing: DataFrame, as_of: datetime.date) -> DataFrame:
    """Fill in the scores and add ``base`` and ``confidence`` (before any penalty).

    Candidates are dealt once, by field; a field's come from the few documents routed to it, and from
    its answer. Two documents agree on an accepted value if its least and greatest document id
    differ, two strong values contradict each other if the least and the greatest of the field differ: no
    set is gathered. The penalty stands with the winner.
    """
    accepted = is_accepted()
    value, field = Window.partitionBy(*FIELD, "normalized_value"), Window.partitionBy(*FIELD)
    least = lambda c, over: F.min(F.when(accepted, c)).over(over)
    greatest = lambda c, over: F.max(F.when(accepted, c)).over(over)
    method = method_rank(F.col("from_method"))
    based = (with_relevance(candidates, routing)
             .withColumn("validator", validator_score(F.col("field"), F.col("normalized_value"), F.col("validators"), as_of))
             .withColumn("base", F.col("scores.anchor_match") * ANCHOR_WEIGHT + F.col("validator") * VALIDATOR_WEIGHT
                         + F.col("relevance") * RELEVANCE_WEIGHT))
    # A missing key or value is like no other: nothing agrees with it or contradicts it.
    keyed = F.col("run_id").isNotNull() & F.col("field").isNotNull()
    bonus = lambda agrees: F.when(accepted & agrees, AGREEMENT_BONUS).otherwise(0.0)
    agreed = (based.withColumn("agrees", least(F.col("doc_id"), value) != greatest(F.col("doc_id"), value))
              .withColumn("agreement", bonus(F.col("agrees") & keyed & F.col("normalized_value").isNotNull()))
              .withColumn("confidence", _clamped(F.col("base") + F.col("agreement"))))
    place = F.struct((-_clamped(F.col("base") + bonus(F.col("agrees")))).alias("o1"), method.alias("o2"), F.col("normalized_value").alias("o3"), F.col("seq").alias("o4"))
    strong = F.when(F.round("base", 9) >= CONTRADICTION_FLOOR, F.col("normalized_value"))
    clash = F.coalesce(least(strong, field) != greatest(strong, field), F.lit(False)) & keyed
    own = F.struct(method.alias("o2"), F.col("normalized_value").alias("o3"), F.col("seq").alias("o4"))
    first = F.col("first")
    return (agreed.withColumn("first", least(place, field)).withColumn("clash", clash)
            .withColumn("wins", own == F.struct(first["o2"].alias("o2"), first["o3"].alias("o3"), first["o4"].alias("o4")))
            .withColumn("scores", F.struct(
                F.col("scores.anchor_match").alias("anchor_match"), F.col("validator").alias("validator"),
                F.col("relevance").alias("doc_relevance"), F.col("agreement").alias("cross_doc_agreement"),
                F.when(accepted & F.col("clash") & F.col("wins"), CONTRADICTION_PENALTY).otherwise(0.0).alias("contradiction_penalty")))
            .drop("validator", "agreement", "relevance", "agrees", "first", "clash", "wins"))


def contradictions(scored: DataFrame) -> DataFrame:
    """Fields whose winner has the penalty: they have two or more different strong accepted values."""
    return scored.filter("scores.contradiction_penalty > 0").select(*FIELD)


def front_runners(scored: DataFrame) -> DataFrame:
    """Per field, a short array of the best accepted and the best rejected candidates.

    Candidates are dealt once, by field. At most ``2 * (1 + ALTERNATIVES)`` rows per field are gathered.
    """
    order = [F.desc("confidence"), method_rank(F.col("from_method")), F.col("normalized_value"), F.col("seq")]
    marked = scored.repartition(*FIELD).withColumn("accepted", is_accepted())
    ranked = marked.withColumn("place", F.row_number().over(
        Window.partitionBy(*FIELD, "accepted").orderBy(*order))).filter(F.col("place") <= 1 + ALTERNATIVES)
    entry = F.struct(
        (-F.col("confidence")).alias("o1"), method_rank(F.col("from_method")).alias("o2"),
        F.col("normalized_value").alias("o3"), F.col("seq").alias("o4"), "accepted", "place", "confidence", "doc_id",
        F.struct("field", "raw_value", "normalized_value", "evidence", "from_method", "validators",
                 "rejected_reasons", "scores").cast(CANDIDATE).alias("candidate"))
    listed = ranked.groupBy(*FIELD).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    wins = lambda e: e["accepted"] & (e["place"] == 1)
    return listed.select(*FIELD, F.get(F.filter("entries", wins), F.lit(0)).alias("winner"),
                         F.slice(F.filter("entries", lambda e: ~wins(e)), 1, ALTERNATIVES).alias("others"))


def document_state(doc_index: DataFrame) -> DataFrame:
    """Per bundle: readable documents, and documents without a text layer."""
    return doc_index.groupBy("run_id").agg(
        F.count_if(is_readable()).alias("readable"),
        F.count_if(F.col("unreadable_reason") == "no_text_layer").alias("no_text"))


def select_final(schema_fields: DataFrame, scored: DataFrame, routing: DataFrame, doc_index: DataFrame,
                 errors: DataFrame | None = None, options: RunOptions = RunOptions()) -> DataFrame:
    """One row per resolved field: status, value, confidence, rationale, alternatives.

    The winner is the accepted candidate of greatest confidence; a contradiction
    takes the penalty off the winner and asks for review.
    """
    # What a bundle has to say joins the bare fields: candidates are dealt by field only.
    fields = resolved(schema_fields, options).select(*FIELD).join(document_state(doc_index), "run_id", "left")
    top = routing.groupBy(*FIELD).agg(F.max("score").alias("top_score"))
    joined = fields.join(front_runners(scored), FIELD, "left").join(top, FIELD, "left")
    if errors is None:
        joined = joined.withColumn("kind", F.lit(None).cast("string"))
    else:
        joined = joined.join(with_kind(errors).select(*FIELD, "kind"), FIELD, "left")

    won = F.col("winner").isNotNull()
    chosen = F.col("winner.candidate")
    assumed = F.array_contains(chosen["validators"], ASSUMED)
    scores = chosen["scores"]
    clashed = F.coalesce(scores["contradiction_penalty"] > 0, F.lit(False))
    confidence = F.coalesce(_clamped(
        scores["anchor_match"] * ANCHOR_WEIGHT + scores["validator"] * VALIDATOR_WEIGHT + scores["doc_relevance"] * RELEVANCE_WEIGHT
        + scores["cross_doc_agreement"] - scores["contradiction_penalty"]), F.lit(0.0))
    review = clashed | assumed | (F.round(confidence, 9) < options.autofill_threshold)
    reason = lambda test, name: F.when(test, F.lit(name))
    readable = F.coalesce("readable", F.lit(0).cast("long"))
    rationale = F.array_compact(F.array(
        reason(won & (scores["anchor_match"] == 1), "literal_anchor"),
        reason(won & (scores["validator"] == PASS), "validator_passed"),
        reason(won & (scores["doc_relevance"] > 0) & (scores["doc_relevance"] >= F.col("top_score")),
               "best_doc_relevance"),
        reason(won & (scores["cross_doc_agreement"] > 0), "cross_doc_agreement"),
        reason(~won & (readable == 0), "no_readable_docs"),
        reason(~won & (readable == 0) & (F.col("no_text") > 0), "no_text_layer"),
        F.when(~won, F.col("kind"))))
    return joined.select(
        *FIELD, F.when(~won, "missing").when(review, "needs_review").otherwise("filled").alias("status"),
        chosen["raw_value"].alias("value"), chosen["normalized_value"].alias("normalized_value"),
        confidence.alias("confidence"), rationale.alias("rationale"),
        F.coalesce(chosen["evidence"], F.array().cast(f"array<{EVIDENCE}>")).alias("evidence"),
        F.coalesce(F.col("others")["candidate"], F.array().cast(f"array<{CANDIDATE}>")).alias("alternatives"),
        clashed.alias("contradiction"))


def final_map(schemas: DataFrame, final_fields: DataFrame) -> DataFrame:
    """One row per bundle with a map from field key to its final value."""
    columns = ["field", "status", "value", "normalized_value", "confidence", "rationale", "evidence", "alternatives"]
    entries = final_fields.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col("field").alias("key"), F.struct(*columns).alias("value"))))).alias("fields"))
    return schemas.select("run_id", "schema_source").join(entries, "run_id")
