"""The registered queries: every operator over whole tables, with flat results."""

from __future__ import annotations

import datetime
import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions import values as V
from attesta.operators import candidates as C
from attesta.operators import evidence as G
from attesta.operators import excerpts as X
from attesta.operators import extract as E
from attesta.operators import inference as N
from attesta.operators import ingest as I
from attesta.operators import report as P
from attesta.operators import routing as R
from attesta.operators import schema_resolve as S
from attesta.operators import scoring as L
from attesta.operators import steps as O
from attesta.operators import validate as K
from attesta.plans import bundle_job as J
from attesta.settings import RunOptions, tune, written
from attesta.sources import store
from checks import bundles as B

AS_OF = datetime.date(2025, 1, 1)
# Budgets small enough to bind on the rendered pages.
TIGHT = RunOptions(excerpt_total_chars=150, excerpt_doc_chars=90, excerpt_doc_pages=2)


class Bundles:
    """Tables of the rendered bundles, put together from the operators.

    With ``stored``, tables that several later stages read are written to the
    shared folder once, as the whole job does.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False) -> None:
        self.spark, self.sf_dir, self.stored = tune(spark), sf_dir, stored

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        return written(df, label) if self.stored else df

    def rendered(self, name: str) -> DataFrame:
        return B.rendered(self.spark, self.sf_dir, name)

    @cached_property
    def runs(self) -> DataFrame:
        return B.runs(self.spark, self.sf_dir)

    @cached_property
    def extractions(self) -> DataFrame:
        return B.extractions(self.spark, self.sf_dir)

    @cached_property
    def pages(self) -> DataFrame:
        return self.keep(I.page_table(self.extractions), "pages")

    @cached_property
    def doc_index(self) -> DataFrame:
        return self.keep(I.update_doc_index(B.doc_stubs(self.extractions), self.extractions), "doc_index")

    @cached_property
    def schemas(self) -> DataFrame:
        return S.fallback_schemas(self.runs)

    @cached_property
    def schema_fields(self) -> DataFrame:
        return S.schema_fields(self.schemas)

    @cached_property
    def routing(self) -> DataFrame:
        return self.keep(R.route(self.schema_fields, self.doc_index, self.pages), "routing")

    @cached_property
    def fields(self) -> DataFrame:
        return C.routed_fields(self.schema_fields, self.routing, self.doc_index)

    @cached_property
    def heuristics(self) -> DataFrame:
        return self.keep(G.check_evidence(E.heuristic_candidates(self.routing, self.pages)), "heuristics")

    @cached_property
    def gate(self) -> DataFrame:
        return C.model_gate(self.fields, self.heuristics)

    @cached_property
    def settled(self) -> DataFrame:
        return self.keep(N.settle_attempts(N.parse_responses(self.rendered("responses"))), "settled")

    @cached_property
    def candidates(self) -> DataFrame:
        return self.heuristics.unionByName(G.check_evidence(N.response_candidates(self.settled)))

    @cached_property
    def scored(self) -> DataFrame:
        return self.keep(L.score_candidates(self.candidates, self.routing, AS_OF), "scored")

    @cached_property
    def final(self) -> DataFrame:
        return L.select_final(self.schema_fields, self.scored, self.routing, self.doc_index,
                              N.model_errors(self.settled))

    def every_doc(self, field: str) -> DataFrame:
        """Every readable document routed to one field."""
        return self.doc_index.filter(R.is_readable()).select(
            "run_id", F.lit(field).alias("field"), F.lit(1).alias("doc_rank"), "doc_id", F.lit(0.0).alias("score"))


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def six(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def flat(candidates: DataFrame) -> DataFrame:
    """Candidates with one evidence entry each, as scalar columns."""
    ev = F.get("evidence", F.lit(0))
    return candidates.select(
        "run_id", "field", "raw_value", "normalized_value", ev["doc_id"].alias("doc_id"), long(ev["page"]).alias("page"),
        ev["quoted_text"].alias("quoted_text"), six("scores.anchor_match").alias("anchor_match"),
        F.array_join("validators", ",").alias("validators"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return B.table(tune(spark), sf_dir, table)


# ---- scalars and routing ------------------------------------------------

def tokenize_docs(spark, sf):
    tokens = T.tokenize(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", tokens.alias("tokens")).select(
        long("doc_id").alias("doc_id"), long(F.size("tokens")).alias("token_count"),
        F.md5(F.array_join(F.sort_array("tokens"), " ")).alias("tokens_md5"))


def normalize_text(spark, sf):
    return read(spark, sf, "documents").select(long("doc_id").alias("doc_id"),
                                               F.md5(T.normalize_text(F.col("text"))).alias("normalized_md5"))


def normalize_date(spark, sf):
    return Bundles(spark, sf).rendered("date_text").select("ok", "t", V.normalize_date(F.col("t")).alias("normalized"))


def normalize_phone(spark, sf):
    p = V.normalize_phone(F.col("t"))
    return Bundles(spark, sf).rendered("phone_text").select(
        "ok", p["digits"].alias("digits"), long(p["assumed"].cast("int")).alias("assumed"))


def score_docs(spark, sf):
    b = Bundles(spark, sf)
    return R.score_docs(b.schema_fields, b.doc_index, b.pages).select("run_id", "field", "doc_id", six("score").alias("score"))


def route_topk(spark, sf):
    return Bundles(spark, sf).routing.select("run_id", "field", long("doc_rank").alias("doc_rank"), "doc_id",
                                             six("score").alias("score"))


def _corpus_routing(spark, sf):
    """The corpus with its sources as bundles: few, large bundles of long documents."""
    pages = B.document_pages(tune(spark), sf)
    index = pages.select("run_id", "doc_id", F.lit(True).alias("has_text_layer"),
                         F.lit(None).cast("string").alias("unreadable_reason"))
    fields = S.schema_fields(S.fallback_schemas(pages.select("run_id").distinct()))
    return fields, R.route(fields, index, pages), pages


def route_documents(spark, sf):
    return _corpus_routing(spark, sf)[1].select("run_id", "field", long("doc_rank").alias("doc_rank"), "doc_id",
                                                six("score").alias("score"))


def document_excerpts(spark, sf):
    """Excerpts of the corpus under the default budgets."""
    fields, routing, pages = _corpus_routing(spark, sf)
    return X.build_excerpts(C.resolved(fields), routing, pages).select(
        "run_id", "field", long("excerpt_ord").alias("excerpt_ord"), "doc_id", long(F.length("text")).alias("chars"),
        F.md5("text").alias("text_md5"))


def route_nested(spark, sf):
    """Bundles without their forms, so customers without orders have nothing readable."""
    b = Bundles(spark, sf)
    index = b.doc_index.filter("doc_id <> 'doc_000000000'")
    nested = R.nest_routing(b.schema_fields, R.route(b.schema_fields, index, b.pages))
    return nested.select("run_id", "field", F.array_join("doc_ids", ",").alias("doc_ids"), long(F.size("scores")).alias("scored"),
                         six(F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x)).alias("score_sum"))


def route_labelled(spark, sf):
    """Routing under the schemas the bundles asked for, labels included."""
    b = Bundles(spark, sf)
    schemas = S.resolve_schemas(b.runs, B.user_schemas(spark, sf), b.rendered("form_fields"))
    return R.route(S.schema_fields(schemas), b.doc_index, b.pages).select(
        "run_id", "field", long("doc_rank").alias("doc_rank"), "doc_id", six("score").alias("score"))


def readable_status(spark, sf):
    b = Bundles(spark, sf)
    return R.readable_status(b.runs, b.doc_index.filter("doc_id <> 'doc_000000000'"))


# ---- extraction ---------------------------------------------------------

def _extracted(field):
    def query(spark, sf):
        b = Bundles(spark, sf)
        return flat(E.heuristic_candidates(b.every_doc(field), b.pages))

    query.__name__ = f"{field}_candidates"
    return query


def phone_in_documents(spark, sf):
    pages = B.document_pages(tune(spark), sf)
    routed = pages.select("run_id", F.lit("phone").alias("field"), F.lit(1).alias("doc_rank"), "doc_id")
    return flat(E.heuristic_candidates(routed, pages)).select(
        "run_id", "doc_id", "raw_value", "normalized_value", F.md5("quoted_text").alias("quote_md5"), "anchor_match", "validators")


def evidence_check(spark, sf):
    b = Bundles(spark, sf)
    return flat(b.heuristics.withColumn("validators", F.col("rejected_reasons"))).withColumnRenamed("validators", "rejected")


def model_gate(spark, sf):
    return Bundles(spark, sf, stored=True).gate.select("run_id", "field", six(F.coalesce("best_confidence", F.lit(-1.0))).alias("best_confidence"),
                                          long(F.col("call_model").cast("int")).alias("call_model"))


def field_stats(spark, sf):
    b = Bundles(spark, sf, stored=True)
    return C.field_stats(b.fields, b.gate, b.candidates).withColumn("llm_used", long(F.col("llm_used").cast("int")))


def field_events(spark, sf):
    b = Bundles(spark, sf, stored=True)
    stats = C.field_stats(b.fields, b.gate, b.candidates).join(b.fields.select("run_id", "field", "routed"), ["run_id", "field"])
    return C.field_events(stats, N.model_errors(b.settled)).select(
        "run_id", "step", "status", F.coalesce("error.kind", F.lit("")).alias("error_kind"))


def sorted_candidates(spark, sf):
    b = Bundles(spark, sf, stored=True)
    placed = C.sort_candidates(b.candidates)
    return placed.select("run_id", long("place").alias("place"), "field", "from_method", "normalized_value", F.get("evidence", F.lit(0))["doc_id"].alias("doc_id"))


def excerpts(spark, sf):
    b = Bundles(spark, sf, stored=True)
    return X.build_excerpts(C.resolved(b.schema_fields), b.routing, b.pages, TIGHT).select(
        "run_id", "field", long("excerpt_ord").alias("excerpt_ord"), "doc_id", long("page").alias("page"), "text")


def prompts(spark, sf):
    b = Bundles(spark, sf, stored=True)
    made = N.build_prompts(b.gate, X.build_excerpts(C.resolved(b.schema_fields), b.routing, b.pages, TIGHT))
    return made.select("run_id", "field", long(F.length("prompt")).alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"),
                       F.md5(N.retry_prompt(F.col("field"), F.lit(N.INVALID_JSON))).alias("retry_md5"))


# ---- model answers ------------------------------------------------------

def parse_responses(spark, sf):
    """Every answer: its error, and its items with valid evidence."""
    parsed = N.parse_responses(Bundles(spark, sf).rendered("responses"))
    item = parsed.select("run_id", "field", "attempt", "parse_error", F.explode_outer("found").alias("f"))
    ev = F.get("f.evidence", F.lit(0))
    none = F.lit("")
    return item.select(
        "run_id", "field", long("attempt").alias("attempt"), F.coalesce("parse_error", none).alias("parse_error"),
        F.coalesce("f.raw_value", none).alias("raw_value"), F.coalesce("f.normalized_value", none).alias("given_value"),
        F.coalesce(ev["doc_id"], none).alias("doc_id"), long(F.coalesce(ev["page"], F.lit(0))).alias("page"),
        F.coalesce(ev["quoted_text"], none).alias("quoted_text"))


def retry_responses(spark, sf):
    return Bundles(spark, sf).settled.select(
        "run_id", "field", long("attempt").alias("attempt"), "status", long(F.coalesce(F.size("found"), F.lit(0))).alias("found"))


def response_candidates(spark, sf):
    return flat(N.response_candidates(Bundles(spark, sf).settled))


def answering(messages: list[dict], limit: int) -> str:
    """A caller's model for the check: by the hash of the prompt it raises, answers badly at first, finds something or nothing."""
    kind = int(hashlib.md5(messages[0]["content"].encode()).hexdigest()[:2], 16) % 4
    if kind == 0:
        raise ConnectionError("down")
    if kind == 1 and len(messages) == 1:
        return "no json"
    return '[{"raw_value":"x","evidence":[{"doc_id":"d","page":1,"quoted_text":"q"}]}]' if kind == 2 else "[]"


def model_job(spark, sf):
    """The fields the gate lets through, asked of a model that sometimes fails; asked twice with one ledger."""
    b = Bundles(spark, sf, stored=True)
    ledger = J.fresh_folder(b.spark, "ledger")
    made = b.keep(N.build_prompts(b.gate, X.build_excerpts(C.resolved(b.schema_fields), b.routing, b.pages, TIGHT)), "prompts")
    N.ask(made, answering, ledger=ledger)
    return N.ask(made, answering, ledger=ledger).select(
        "run_id", "field", long("attempt").alias("attempt"), "status", long(F.coalesce(F.size("found"), F.lit(0))).alias("found"),
        F.coalesce("parse_error", F.lit("")).alias("error"))


# ---- schemas ------------------------------------------------------------

def _specs(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["key"], F.coalesce(s["label"], F.lit("-")), s["type"])), "|")


def schema_user(spark, sf):
    parsed = S.parse_user_schemas(B.user_schemas(tune(spark), sf), RunOptions(max_fields=2))
    none = F.lit("")
    return parsed.select("run_id", F.coalesce(_specs("resolved_fields"), none).alias("fields"),
                         F.coalesce(F.array_join("unsupported_fields", ","), none).alias("unsupported"),
                         F.coalesce("message", none).alias("message"))


def schema_forms(spark, sf):
    forms = S.first_forms(S.match_form_fields(Bundles(spark, sf).rendered("form_fields")))
    return forms.select("run_id", F.col("place.file_name").alias("file_name"), _specs("resolved_fields").alias("fields"))


def schema_resolved(spark, sf):
    b = Bundles(spark, sf)
    return S.resolve_schemas(b.runs, B.user_schemas(spark, sf), b.rendered("form_fields")).select(
        "run_id", "schema_source", _specs("resolved_fields").alias("fields"), F.array_join("unsupported_fields", ",").alias("unsupported"))


def schema_warnings(spark, sf):
    b = Bundles(spark, sf)
    return S.schema_warnings(B.user_schemas(spark, sf), b.rendered("form_fields")).select("run_id", "kind", "message")


# ---- ingest -------------------------------------------------------------

def ingest_index(spark, sf):
    return I.ingest(B.uploads(tune(spark), sf)).select("run_id", "doc_id", "filename", "mime_type", "sha256")


def rejected_uploads(spark, sf):
    return I.rejected_uploads(B.uploads(tune(spark), sf)).select("run_id", long("upload_ord").alias("upload_ord"), "reason")


def stored_files(spark, sf):
    return I.stored_files(B.uploads(tune(spark), sf)).select("run_id", "safe_name", long("stored_ord").alias("stored_ord"), "sha256")


def doc_index(spark, sf):
    return Bundles(spark, sf).doc_index.select(
        "run_id", "doc_id", long(F.coalesce("pages", F.lit(-1))).alias("pages"),
        long(F.col("has_text_layer").cast("int")).alias("has_text_layer"), F.coalesce("unreadable_reason", F.lit("")).alias("reason"))


def page_table(spark, sf):
    return Bundles(spark, sf).pages.select("run_id", "doc_id", long("page").alias("page"), F.md5("full_text").alias("text_md5"))


def nested_layout(spark, sf):
    return I.layout(Bundles(spark, sf).extractions).select(
        "run_id", "doc_id", long(F.size("pages")).alias("pages"),
        F.md5(F.array_join(F.transform("pages", lambda p: p["full_text"]), "|")).alias("text_md5"))


def split_pages(content: bytes) -> list[str]:
    """Stand-in reader for the rendered files: form feeds part the pages."""
    text = content.decode("utf-8")
    if "damaged" in text:
        raise ValueError("damaged file")
    return text[4:].split("\f")


def _kept(spark, sf):
    """The rendered uploads with their contents kept by hash, in two batches of page texts: the second parses what is new."""
    root = J.fresh_folder(tune(spark), "contents")
    kept = written(I.describe(B.uploads(spark, sf), root), "kept")
    for batch in (kept.filter("upload_ord % 2 = 0"), kept):
        store.add_page_texts(I.page_texts(I.stored_files(batch), split_pages, store.read_page_texts(spark, root)), root)
    index = I.ingest(kept)
    return kept, index, I.extractions_by_content(index, store.read_page_texts(spark, root))


def page_extract_job(spark, sf):
    """Uploads to readable documents, with a caller's page reader in Python workers."""
    _, index, extractions = _kept(spark, sf)
    return I.update_doc_index(index, extractions).select("run_id", "doc_id", long(F.coalesce("pages", F.lit(-1))).alias("pages"),
                                                         F.coalesce("unreadable_reason", F.lit("")).alias("reason"))


def page_text_hashes(spark, sf):
    """The text of every page that job reads."""
    return I.page_table(_kept(spark, sf)[2]).select("run_id", "doc_id", long("page").alias("page"), F.md5("full_text").alias("text_md5"))


def new_files(spark, sf):
    """Files of uploads with odd numbers whose names no upload with an even number has taken."""
    uploads = B.uploads(tune(spark), sf)
    return I.new_files(uploads.filter("upload_ord % 2 = 1"), I.stored_files(uploads.filter("upload_ord % 2 = 0"))).select(
        "run_id", "safe_name", long("stored_ord").alias("stored_ord"), "sha256")


def stored_listing(spark, sf):
    return I.stored_listing(B.uploads(tune(spark), sf)).select("run_id", long("place").alias("place"), "safe_name", "sha256")


def file_uploads(spark, sf):
    """The pages' html written as files of a few bundles, then listed, opened once for their hash, and indexed."""
    root = J.fresh_folder(tune(spark), "files")
    name = F.concat(F.lit("site_"), F.lpad((F.col("page_id") % 7).cast("string"), 3, "0"), F.lit("/in/p "), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".html"))
    files = read(spark, sf, "pages").select(name.alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    written(store.write_files(files, root, "name"), "names")
    described = written(I.describe(store.spread_files(store.list_uploads(spark, root))), "described")
    return I.ingest(described).select("run_id", "doc_id", "filename", "mime_type", "sha256")


# ---- scores and final values --------------------------------------------

def doc_relevance(spark, sf):
    b = Bundles(spark, sf, stored=True)
    return L.with_relevance(b.candidates, b.routing).select(
        "run_id", "field", "normalized_value", "from_method", "doc_id", six("relevance").alias("relevance"))


def validators(spark, sf):
    b = Bundles(spark, sf, stored=True)
    score = L.validator_score(F.col("field"), F.col("normalized_value"), F.col("validators"), AS_OF)
    return b.candidates.select("run_id", "field", "normalized_value", "from_method", six(score).alias("validator"))


def confidence(spark, sf):
    return Bundles(spark, sf, stored=True).scored.select(
        "run_id", "field", "normalized_value", "from_method", "doc_id", six("base").alias("base"),
        six("scores.cross_doc_agreement").alias("agreement"), six("scores.contradiction_penalty").alias("penalty"), six("confidence").alias("confidence"))


def contradictions(spark, sf):
    return L.contradictions(Bundles(spark, sf, stored=True).scored)


def _final_columns(df: DataFrame) -> DataFrame:
    none = F.lit("")
    return df.select("run_id", "field", "status", F.coalesce("value", none).alias("value"),
                     F.coalesce("normalized_value", none).alias("normalized_value"), six("confidence").alias("confidence"),
                     F.array_join("rationale", ",").alias("rationale"))


def final_fields(spark, sf):
    alternatives = F.array_join(F.transform("alternatives", lambda c: c["normalized_value"]), "|")
    final = Bundles(spark, sf, stored=True).final
    return _final_columns(final.withColumn("rationale", F.array_append("rationale", F.concat(F.lit("alt="), alternatives))))


def overrides(spark, sf):
    b = Bundles(spark, sf, stored=True)
    done = P.apply_overrides(b.final, b.rendered("overrides"))
    return _final_columns(done.withColumn("status", F.concat_ws("/", "status", F.size("evidence").cast("string"), F.when(F.array_contains("rationale", "override"), "override")))).drop("rationale")


def final_unavailable(spark, sf):
    """Final fields where the model failed for every field of every second bundle."""
    b = Bundles(spark, sf, stored=True)
    down = b.schema_fields.filter(F.substring("run_id", 5, 9).cast("int") % 2 == 0).select(
        "run_id", F.col("key").alias("field"), F.lit("down").alias("message"), F.lit("llm_unavailable").alias("kind"))
    final = L.select_final(b.schema_fields, b.scored, b.routing, b.doc_index, down)
    return final.select("run_id", "field", "status", long(F.array_contains("rationale", "llm_unavailable").cast("int")).alias("unavailable"))


def population_report(spark, sf):
    b = Bundles(spark, sf, stored=True)
    return P.population_report(b.final, b.rendered("targets")).select(
        "run_id", "field", "status", F.coalesce("value", F.lit("")).alias("value"),
        long(F.col("population_skipped").cast("int")).alias("population_skipped"), F.coalesce("reason", F.lit("")).alias("reason"))


def eval_metrics(spark, sf):
    b = Bundles(spark, sf, stored=True)
    rate = lambda n: six(F.coalesce(n, F.lit(-1.0))).alias(n)
    return P.eval_metrics(b.final, b.rendered("truth")).select(
        F.coalesce("run_id", F.lit("overall")).alias("run_id"), rate("exact_match"), rate("evidence_coverage"),
        rate("needs_review_rate"), rate("hallucination_rate"))


def final_map(spark, sf):
    b = Bundles(spark, sf, stored=True)
    mapped = L.final_map(b.schemas, b.final)
    return mapped.select("run_id", "schema_source", long(F.size("fields")).alias("fields"),
                         F.col("fields")["dob"]["status"].alias("dob_status"),
                         F.coalesce(F.col("fields")["dob"]["normalized_value"], F.lit("")).alias("dob"))


# ---- checks, steps, storage ---------------------------------------------

def violations(spark, sf):
    """Candidates with faults put in by rule, checked against the row constraints."""
    b = Bundles(spark, sf)
    k = F.substring("run_id", 5, 9).cast("int")
    bad = F.transform("evidence", lambda e: F.struct(
        F.when(k % 5 == 0, " ").otherwise(e["doc_id"]).alias("doc_id"),
        F.when(k % 7 == 0, 0).otherwise(e["page"]).alias("page"), e["quoted_text"].alias("quoted_text"), e["bbox"].alias("bbox")))
    broken = (E.heuristic_candidates(b.every_doc("full_name"), b.pages)
              .withColumn("field", F.when(k % 3 == 0, "ssn").otherwise(F.col("field")))
              .withColumn("from_method", F.when(k % 4 == 0, "regex").otherwise(F.col("from_method")))
              .withColumn("evidence", F.when(k % 11 == 0, F.slice("evidence", 1, 0)).otherwise(bad))
              .withColumn("scores", F.col("scores").withField("validator", F.when(k % 6 == 0, 1.5).otherwise(0.0)))
              .withColumn("row_id", F.col("normalized_value")))
    return K.violations(broken, "candidates").select("run_id", "row_id", "loc", "msg")


def json_violations(spark, sf):
    """Model answers taken as stored candidate lists: shape and missing members."""
    rows = Bundles(spark, sf).rendered("responses").select(
        "run_id", F.concat_ws("/", "field", F.col("attempt").cast("string")).alias("row_id"), F.col("text").cast("binary").alias("content"))
    return K.json_violations(K.decode_json(rows), "candidates").select("run_id", "row_id", "loc", "msg")


def artifact_faults(spark, sf):
    """Stored documents of all six artifacts with faults at every depth."""
    docs = Bundles(spark, sf).rendered("faulty").select("run_id", "artifact", F.col("doc").cast("binary").alias("content"))
    parts = [K.json_violations(K.decode_json(docs.filter(F.col("artifact") == name)), name) for name in K.SHAPES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("run_id", "artifact", "loc", "msg")


def step_status(spark, sf):
    b = Bundles(spark, sf, stored=True)
    root, final = J.fresh_folder(b.spark, "steps"), b.keep(b.final, "final")
    store.write_artifact(L.final_map(b.schemas, final), "final", root)
    return O.step_status(b.runs, uploads=b.extractions.select("run_id"), doc_index=b.doc_index, pages=b.pages, schema_fields=b.schema_fields,
                         routing=b.routing, candidates=b.candidates, final=final, stored=store.read_artifact(b.spark, "final", root))


def artifact_roundtrip(spark, sf):
    """Index, routing and trace rows written to the shared folder and read back."""
    b = Bundles(spark, sf, stored=True)
    root = J.fresh_folder(b.spark, "roundtrip")
    store.write_artifact(b.doc_index, "doc_index", root)
    store.write_artifact(R.nest_routing(b.schema_fields, b.routing), "routing", root, "json")
    store.append_trace(O.trace_rows(R.readable_status(b.runs, b.doc_index).withColumn("step", F.lit("route_docs")),
                                    F.lit("2025-12-12 11:40:12.123456").cast("timestamp")), root)
    docs = store.read_artifact(b.spark, "doc_index", root).groupBy("run_id").agg(F.count("*").alias("docs"))
    routed = store.read_artifact(b.spark, "routing", root, "json").groupBy("run_id").agg(F.sum(long(F.size("doc_ids"))).alias("routed"))
    trace = store.read_trace(b.spark, root).select("run_id", "ts", "status")
    return docs.join(routed, "run_id").join(trace, "run_id")


def bundle_job(spark, sf):
    """The whole job over user schemas, forms and uploads' text, with stored answers."""
    b = Bundles(spark, sf, stored=True)
    out = J.extract_fields(b.runs, b.doc_index, b.pages, B.user_schemas(spark, sf), b.rendered("form_fields"),
                           responses=b.rendered("responses"), as_of=AS_OF)
    return _final_columns(out.final).drop("rationale")


def job_reports(spark, sf):
    """What that job says about itself: its steps, field events and warnings, counted per bundle."""
    b = Bundles(spark, sf, stored=True)
    out = J.extract_fields(b.runs, b.doc_index, b.pages, B.user_schemas(spark, sf), b.rendered("form_fields"),
                           responses=b.rendered("responses"), as_of=AS_OF)
    rows = lambda df, kind: df.select("run_id", kind.alias("kind"))
    said = (rows(out.warnings, F.col("kind")).unionByName(rows(out.errors, F.col("kind")))
            .unionByName(rows(out.events, F.concat(F.lit("event_"), F.col("status")))))
    counts = said.groupBy("run_id", "kind").agg(F.count("*").alias("n"))
    return counts.unionByName(out.steps.select("run_id", F.concat_ws("/", "step", "status").alias("kind"), F.col("rows_out").alias("n")))


QUERIES = {f.__name__: f for f in [
    tokenize_docs, normalize_text, normalize_date, normalize_phone, score_docs, route_topk, route_documents, route_nested,
    route_labelled, readable_status,
    *[_extracted(k) for k in ["full_name", "dob", "phone", "address", "insurance_member_id", "allergies", "medications"]],
    phone_in_documents, evidence_check, model_gate, field_stats, field_events, sorted_candidates, excerpts, document_excerpts, prompts,
    parse_responses, retry_responses, response_candidates, model_job, schema_user, schema_forms, schema_resolved, schema_warnings,
    ingest_index, rejected_uploads, stored_files, doc_index, page_table, nested_layout, page_extract_job, page_text_hashes, new_files, stored_listing, file_uploads,
    doc_relevance, validators, confidence, contradictions, final_fields, final_unavailable, overrides, population_report, eval_metrics, final_map,
    violations, json_violations, artifact_faults, step_status, artifact_roundtrip, bundle_job, job_reports,
]}
