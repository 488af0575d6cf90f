"""The whole extraction as one job."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attesta.operators import candidates as C
from attesta.operators import evidence as G
from attesta.operators import excerpts as X
from attesta.operators import extract as E
from attesta.operators import inference as N
from attesta.operators import routing as R
from attesta.operators import schema_resolve as S
from attesta.operators import scoring as L
from attesta.operators import steps as O
from attesta.settings import RunOptions, shared_folder, written


@dataclass(frozen=True)
class Extracted:
    """The tables a job leaves behind: its results, and what it has to say about them."""

    schemas: DataFrame
    routing: DataFrame
    candidates: DataFrame  # with their scores
    stats: DataFrame
    final: DataFrame
    warnings: DataFrame  # of schema resolution
    errors: DataFrame  # of model calls, by field
    events: DataFrame  # of fields: heuristic, model
    steps: DataFrame  # rows in and out by step


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def extract_fields(runs: DataFrame, doc_index: DataFrame, pages: DataFrame, user_schemas: DataFrame,
                   form_fields: DataFrame, *, as_of: datetime.date, responses: DataFrame | None = None,
                   model: Callable[[list[dict], int], str] | None = None,
                   options: RunOptions = RunOptions(), ledger: str | None = None) -> Extracted:
    """Documents and schema requests to final fields.

    Routing, heuristic candidates and scores each feed several later stages, so they
    are written once to the shared folder; page text is read for routing, for
    extraction and for excerpts, and never again. Answers come from ``model``,
    or from a stored ``responses`` table, or there are none. ``ledger`` names the folder of
    model answers; a job run again with it asks only for those it did not get.
    """
    folder = fresh_folder(runs.sparkSession, "job")
    schemas = S.resolve_schemas(runs, user_schemas, form_fields, options)
    fields = S.schema_fields(schemas)
    routing = written(R.route(fields, doc_index, pages, options), "routing", folder)
    heuristics = written(G.check_evidence(E.heuristic_candidates(routing, pages)), "heuristics", folder)
    routed = C.routed_fields(fields, routing, doc_index, options)
    gate = C.model_gate(routed, heuristics, options)

    settled = None
    if model is not None or responses is not None:
        prompts = N.build_prompts(gate, X.build_excerpts(gate.filter("call_model"), routing, pages, options))
        if model is not None:
            settled = N.ask(written(prompts, "prompts", folder), model, options, ledger or f"{folder}/answers")
        else:
            answers = N.replay(prompts, responses, 1).unionByName(N.replay(prompts, responses, 2))
            settled = N.settle_attempts(N.parse_responses(answers))
        settled = written(settled, "settled", folder)
    found = heuristics if settled is None else heuristics.unionByName(
        G.check_evidence(N.response_candidates(settled)))
    scored = written(L.score_candidates(found, routing, as_of), "scored", folder)
    errors = None if settled is None else N.model_errors(settled)
    final = written(L.select_final(fields, scored, routing, doc_index, errors, options), "final", folder)
    stats = C.field_stats(routed, gate, scored)
    events = C.field_events(stats.join(routed.select("run_id", "field", "routed"), ["run_id", "field"]), errors)
    steps = O.step_status(runs, doc_index=doc_index, pages=pages, schema_fields=fields, routing=routing, candidates=scored, final=final)
    none = runs.sparkSession.createDataFrame([], "run_id string, field string, message string, kind string")
    return Extracted(schemas, routing, scored, stats, final, S.schema_warnings(user_schemas, form_fields),
                     none if errors is None else errors, events, steps)
