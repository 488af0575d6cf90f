import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from attesta.operators import inference as N
from attesta.operators import ingest as I
from attesta.operators import report as P
from attesta.operators import schema_resolve as S
from attesta.operators import scoring as L
from attesta.operators import steps as O
from attesta.operators import validate as K
from attesta.operators.numbering import with_position
from attesta.plans.bundle_job import extract_fields
from attesta.schemas import (ARTIFACTS, DOC_INDEX, EXTRACTIONS, FINAL_FIELD, FORM_FIELDS, OVERRIDES, PAGES, RESPONSES, ROUTING_ROWS,
                             SCHEMA_FIELDS, TRUTH, UPLOADS, USER_SCHEMAS)
from attesta.settings import RunOptions, written
from attesta.sources import store

AS_OF = datetime.date(2025, 1, 1)


# ---- schemas ------------------------------------------------------------

def user(spark, *texts):
    rows = [(f"r{i}", bytearray(t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, USER_SCHEMAS)


def test_user_schemas(spark):
    df = user(spark,
              '{"fields":[{"key":"medications"},{"key":"full_name","label":"N"},{"key":"dob","label":3},{"key":"full_name","label":"M"}]}',
              '{"fields":[{"key":"full_name"},{"key":"unknown_field"},{"key":"another_bad"},{"key":"another_bad"}]}',
              b"\xff\xfe", "not json", "[]", '{"fields":{}}', '{"fields":[]}', '{"fields":[1,null,"x",{"key":4},{"label":"y"}]}', '{"fields":null}')
    out = {r.run_id: r for r in S.parse_user_schemas(df).collect()}
    assert [(f.key, f.label, f.type) for f in out["r0"].resolved_fields] == [
        ("full_name", "M", "string"), ("dob", None, "date"), ("medications", None, "string_or_list")]
    assert out["r1"].unsupported_fields == ["unknown_field", "another_bad", "another_bad"]
    assert [out[f"r{i}"].message is None for i in range(9)] == [True, True, False, False, False, False, True, True, False]
    assert out["r6"].resolved_fields == [] and out["r7"].resolved_fields == []
    capped = S.parse_user_schemas(df, RunOptions(max_fields=1)).filter("run_id = 'r0'").first()
    assert [f.key for f in capped.resolved_fields] == ["full_name"]


def test_form_matching(spark):
    names = {"user_phone_number": ["phone"], "patient_name_dob": ["full_name", "dob"], "random_field_xyz": [], "StreetLine": ["address"]}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.k for r in df.select("n", S.matching_keys(F.col("n")).alias("k")).collect()} == names


def test_precedence_and_warnings(spark):
    runs = spark.createDataFrame([("u",), ("f",), ("b",), ("n",)], "run_id string")
    users = spark.createDataFrame([("u", bytearray(b'{"fields":[{"key":"dob"}]}')), ("f", bytearray(b"x"))], USER_SCHEMAS)
    forms = spark.createDataFrame([
        ("u", "a.pdf", "patient_name_dob"), ("f", "b.pdf", "phone_home"), ("f", "A.pdf", "notes"), ("f", "A.pdf", "name_dob"),
        ("f", "c.pdf", "name phone"), ("b", "z.pdf", "name_address"), ("b", "q.Pdf", "dob"), ("b", "y.PDF", None)], FORM_FIELDS)
    got = {r.run_id: (r.schema_source, [f.key for f in r.resolved_fields]) for r in S.resolve_schemas(runs, users, forms).collect()}
    assert got["u"] == ("user_schema", ["dob"]) and got["f"] == ("fillable_pdf", ["phone"])
    assert got["b"][0] == got["n"][0] == "fallback_v1" and len(got["n"][1]) == 7
    warned = sorted((r.run_id, r.kind) for r in S.schema_warnings(users, forms).collect())
    assert warned == [("b", "acroform_ambiguous_field"), ("f", "acroform_ambiguous_field"), ("f", "user_schema_invalid")]
    message = S.schema_warnings(users, forms).filter("run_id = 'b'").first()
    assert message.message == "Field 'name_address' matches multiple keys: ['full_name', 'address']"
    flat = S.schema_fields(S.fallback_schemas(runs, RunOptions(max_fields=2))).filter("run_id = 'n'").orderBy("ord").collect()
    assert [(r.ord, r.key) for r in flat] == [(0, "full_name"), (1, "dob")]


# ---- ingest -------------------------------------------------------------

def test_positions_across_blocks(spark, monkeypatch):
    monkeypatch.setattr("attesta.operators.numbering.BLOCK", 10)
    rows = [("a", i * 3) for i in range(100)] + [("b", i) for i in (5, 7, 1000)]
    out = with_position(spark.createDataFrame(rows, "run_id string, o int"), "run_id", "o", "p").collect()
    assert {(r.run_id, r.o): r.p for r in out} == {**{("a", i * 3): i + 1 for i in range(100)}, ("b", 5): 1, ("b", 7): 2, ("b", 1000): 3}


def test_filenames_and_types(spark):
    cases = [("D:\\scans\\2024\\intake form.tif", "intake form.tif"), ("visit...notes..txt", "visit_.notes_txt"), (" .. ", None), ("inbox\\", None),
             ("\tlabs.csv\n", "labs.csv"), ("  ", None), ("./.", None), ("2023/../q4/Summary.PDF", "Summary.PDF")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n string, want string")
    assert all(r.got == r.want for r in df.select("want", I.safe_filename(F.col("n")).alias("got")).collect())
    types = [("scan0001", True, "application/pdf"), ("labs.csv", False, "text/csv"), ("scan0002", False, "application/octet-stream"),
             ("Summary.PDF", False, "application/pdf"), ("old.tar.gz", False, "application/x-tar"), ("old.tgz", False, "application/x-tar"),
             (".html", False, "application/octet-stream"), ("chart.qqq", True, "application/pdf")]
    df = spark.createDataFrame(types, "n string, p boolean, want string")
    for r in df.select("n", "want", I.mime_type(F.col("n"), F.col("p")).alias("got")).collect():
        assert r.got == r.want, r


def test_ingest_extract_and_index(spark, tmp_path):
    def reader(content):
        if b"bad" in content:
            raise ValueError("broken")
        return content.decode()[4:].split("|")

    uploads = spark.createDataFrame([
        ("r", 0, "a.pdf", bytearray(b"%PDFone |two\n  \n")), ("r", 1, "x/a.pdf", bytearray(b"other")), ("r", 2, "n.txt", bytearray(b"%PDFtext")),
        ("r", 3, "bad.pdf", bytearray(b"%PDFbad")), ("r", 4, "blank.pdf", bytearray(b"%PDF  | ")), ("r", 5, "fake.pdf", bytearray(b"no")),
        ("r", 6, "..", bytearray(b"z"))], UPLOADS)
    kept = written(I.describe(uploads, f"{tmp_path}/contents"), "kept")
    index = I.ingest(kept)
    extractions = I.extractions_by_content(index, I.page_texts(I.stored_files(kept), reader))
    got = {r.doc_id: (r.filename, r.pages, r.has_text_layer, r.unreadable_reason) for r in I.update_doc_index(index, extractions).collect()}
    assert got == {"doc_001": ("a.pdf", 2, True, None), "doc_002": ("a.pdf", 2, True, None), "doc_003": ("n.txt", None, False, "no_text_layer"),
                   "doc_004": ("bad.pdf", None, False, "parse_error"), "doc_005": ("blank.pdf", 2, False, "no_text_layer"),
                   "doc_006": ("fake.pdf", None, False, "no_text_layer")}
    hashes = {r.doc_id: r.sha256 for r in index.collect()}
    assert hashes["doc_001"] == hashes["doc_002"]
    assert [r.upload_ord for r in I.rejected_uploads(uploads).collect()] == [6]
    pages = sorted((r.doc_id, r.page, r.full_text) for r in I.page_table(extractions).filter("doc_id < 'doc_002'").collect())
    assert pages == [("doc_001", 1, "one"), ("doc_001", 2, "two")]
    error, = [r.error for r in extractions.collect() if r.doc_id == "doc_004"]
    assert error == "parse_error: broken"
    already = I.stored_files(uploads).filter("safe_name = 'a.pdf'")
    assert I.new_files(uploads, already).filter("safe_name = 'a.pdf'").count() == 0
    nested = I.layout(spark.createDataFrame([("r", "d", ["a  \n\n", "b\nc "], 2, None)], EXTRACTIONS)).first()
    assert [(p.page, p.full_text, p.spans) for p in nested.pages] == [(1, "a", []), (2, "b\nc", [])]


# ---- model answers ------------------------------------------------------

GOOD = '[{"raw_value":"555-123-4567","evidence":[{"doc_id":"d","page":1,"quoted_text":"call 555-123-4567"}]}]'


def test_response_parsing(spark):
    texts = [GOOD, f"```json\n{GOOD}\n```\ntrailing", '{"raw_value":"x"}', "oops", "[]", '[1,"x",{"raw_value":"v"},{"raw_value":"","evidence":[1]}]',
             '[{"raw_value":"v","normalized_value":"w","evidence":[{"doc_id":"d","page":"2","quoted_text":"q"},{"doc_id":"d","page":"2.7","quoted_text":"q"},'
             '{"doc_id":"d","page":2.7,"quoted_text":"q"},{"doc_id":" ","page":1,"quoted_text":"q"},{"doc_id":"d","page":-1,"quoted_text":"q"}]}]', f"{GOOD} extra"]
    df = spark.createDataFrame([("r", "phone", i, t) for i, t in enumerate(texts)], RESPONSES)
    out = {r.attempt: r for r in N.parse_responses(df).collect()}
    assert [out[i].parse_error for i in range(8)] == [None, None, N.NOT_AN_ARRAY, N.INVALID_JSON, None, None, None, N.INVALID_JSON]
    assert [len(out[i].found or []) for i in range(8)] == [1, 1, 0, 0, 0, 0, 1, 0]
    assert [e.page for e in out[6].found[0].evidence] == [2, 2]
    rows = N.response_candidates(N.parse_responses(df)).filter("raw_value <> 'v'").collect()
    assert {(r.normalized_value, tuple(r.validators)) for r in rows} == {("15551234567", ("default_country_assumed",))}


def test_members_of_an_answer_are_read_by_one_cast(spark):
    from attesta.functions import json as J

    text = '[1, {"a": "x", "n": "2"}, null, {"n": 2.7, "b": 1}, {"a": true, "n": "no"}, "s", [], {}]'
    df = spark.createDataFrame([(text,), ('{"a": 1}',), ("[]",)], "t string").select(J.objects(J.parse(F.col("t")), a="variant", n="int").alias("o"))
    read = df.select(F.transform("o", lambda o: F.struct(J.text_of(o["a"]).alias("a"), J.is_given(o["a"]).alias("given"), o["n"].alias("n"))).alias("o"))
    assert [None if r.o is None else [tuple(e) for e in r.o] for r in read.collect()] == [
        [("x", True, 2), (None, False, 2), ("True", True, None), (None, False, None)], None, []]
    answers = spark.createDataFrame([("r", "phone", 1, GOOD)], RESPONSES)
    plan = N.parse_responses(answers)._jdf.queryExecution().executedPlan().toString()
    assert "$.raw_value" not in plan


def test_asking_retries_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(messages, limit):
        with open(log, "a") as f:
            f.write(f"{len(messages)}\n")
        first = messages[0]["content"]
        if "good" in first or ("later" in first and len(messages) == 3):
            return GOOD
        return "not json"

    prompts = spark.createDataFrame([("r", "phone", "good"), ("r", "dob", "later"), ("r", "address", "never")], "run_id string, field string, prompt string")
    settled = N.ask(prompts, model)
    assert {r.field: (r.status, r.attempt) for r in settled.collect()} == {"phone": ("ok", 1), "dob": ("retried", 2), "address": ("invalid_json", 2)}
    assert sorted(open(log).read().split()) == ["1", "1", "1", "3", "3"]
    settled.count()
    assert len(open(log).read().split()) == 5
    error, = N.model_errors(settled).collect()
    assert error.message == "Invalid JSON from LLM for field address: Invalid JSON"


def test_a_failed_call_leaves_the_others(spark):
    def model(messages, limit):
        if "down" in messages[0]["content"] or len(messages) == 3:
            raise TimeoutError("no answer")
        return GOOD if "good" in messages[0]["content"] else "not json"

    prompts = spark.createDataFrame([("r", "phone", "good"), ("r", "dob", "down"), ("r", "address", "odd")], "run_id string, field string, prompt string")
    settled = N.ask(prompts, model)
    assert {r.field: (r.status, r.attempt) for r in settled.collect()} == {"phone": ("ok", 1), "dob": ("unavailable", 1), "address": ("unavailable", 2)}
    assert {(r.field, r.kind, r.message) for r in N.model_errors(settled).collect()} == {
        (f, "llm_unavailable", f"LLM unavailable for field {f}: TimeoutError: no answer") for f in ("dob", "address")}


def test_a_killed_task_asks_only_for_what_it_did_not_write(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "ANSWERS_HELD", 4)
    log, fuse = tmp_path / "calls", tmp_path / "fuse"
    fuse.write_text("lit")

    def model(messages, limit):
        text = messages[0]["content"]
        with open(log, "a") as f:
            f.write(f"{text}\n")
        if text == "p30" and fuse.exists():
            fuse.unlink()
            os._exit(1)
        if text == "p7":
            raise TimeoutError("slow")
        return "[]"

    prompts = spark.createDataFrame([(f"r{i:02d}", "phone", f"p{i}") for i in range(60)], "run_id string, field string, prompt string").coalesce(1)
    ledger = f"{tmp_path}/ledger"
    with pytest.raises(Exception):
        N.ask(prompts, model, ledger=ledger).collect()
    before = log.read_text().split()
    got = {r.run_id: r.status for r in N.ask(prompts, model, ledger=ledger).collect()}
    calls = log.read_text().split()
    assert got == {f"r{i:02d}": "unavailable" if i == 7 else "ok" for i in range(60)}
    again = [p for p in set(calls) if calls.count(p) > 1]
    # Besides the failed call, at most the answers that the killed task had not written yet.
    assert "p30" in before and len(set(before)) < 60 and len(set(calls)) == 60 and len(again) <= 4 * 4 + 1
    calls_of = len(calls)
    assert N.ask(prompts.filter("prompt <> 'p7'"), model, ledger=ledger).count() == 59 and len(log.read_text().split()) == calls_of
    other = N.ask(prompts.filter("prompt = 'p1'").withColumn("prompt", F.lit("p1 other")), model, ledger=ledger)
    assert other.count() == 1 and log.read_text().split("\n").count("p1 other") == 1


def test_a_ledger_has_one_file_a_batch(spark, tmp_path):
    prompts = spark.createDataFrame([(f"r{i:03d}", "phone", f"p{i}") for i in range(500)], "run_id string, field string, prompt string").coalesce(1)
    ledger = tmp_path / "ledger"

    def model(messages, limit):
        if messages[0]["content"] == "p7":
            raise TimeoutError("slow")
        return "[]" if len(messages) == 3 or messages[0]["content"] != "p9" else "odd"

    got = {r.run_id: (r.status, r.attempt) for r in N.ask(prompts, model, ledger=str(ledger)).collect()}
    assert len(got) == 500 and [(k, v) for k, v in sorted(got.items()) if v != ("ok", 1)] == [("r007", ("unavailable", 1)), ("r009", ("retried", 2))]
    # One file an attempt, not one for ANSWERS_HELD answers, and no parts are left.
    assert len([f for f in ledger.rglob("*.parquet")]) == 2
    answers = N.read_answers(spark, str(ledger)).collect()
    assert len(answers) == 501 and len({(r.run_id, r.attempt) for r in answers}) == 501


def test_parts_of_a_batch_have_a_folder_of_their_own(spark, tmp_path, monkeypatch):
    """Tasks that write parts into one folder wait for each other; and what an earlier job answered is not asked again from its parts."""
    monkeypatch.setattr(N, "ANSWERS_HELD", 4)
    ledger, fuse = tmp_path / "ledger", tmp_path / "fuse"
    fuse.write_text("lit")

    def model(messages, limit):
        if messages[0]["content"] == "p30" and fuse.exists():
            fuse.unlink()
            os._exit(1)
        return "[]"

    prompts = spark.createDataFrame([(f"r{i:02d}", "phone", f"p{i}") for i in range(60)], "run_id string, field string, prompt string").coalesce(1)
    with pytest.raises(Exception):
        N.ask(prompts, model, ledger=str(ledger)).collect()
    parts = list(ledger.rglob("*.parquet"))
    assert parts and {p.relative_to(ledger).parts[0] for p in parts} == {N.PARTS} and {len(p.relative_to(ledger).parts) for p in parts} == {3}
    assert N.ask(prompts, model, ledger=str(ledger)).filter("status = 'ok'").count() == 60


def test_prompts(spark):
    gate = spark.createDataFrame([("r", "dob", "Birth", None, True), ("r", "phone", None, 0.45, True), ("r", "address", None, 0.9, False)],
                                 "run_id string, field string, label string, best_confidence double, call_model boolean")
    excerpts = spark.createDataFrame([("r", "dob", 2, "d2", 3, "two"), ("r", "dob", 1, "d1", 1, "one"), ("r", "address", 1, "d", 1, "x")],
                                     "run_id string, field string, excerpt_ord int, doc_id string, page int, text string")
    row, = N.build_prompts(gate, excerpts).collect()
    assert "Field: dob\nType: date\nLabel: Birth\n\nReturn the date" in row.prompt
    assert "[Document: d1, Page: 1]\none\n\n[Document: d2, Page: 3]\ntwo\n\nReturn ONLY the JSON array" in row.prompt


# ---- scores and final values --------------------------------------------

def candidates(spark, *rows):
    """(field, value, doc, method, anchor, accepted) rows as a candidate table."""
    data = [("r", f, v, v, [(d, 1, v, None)], m, [], [] if ok else ["unsupported_by_evidence"], (a, 0.0, 0.0, 0.0, 0.0), [i])
            for i, (f, v, d, m, a, ok) in enumerate(rows)]
    return spark.createDataFrame(data, ARTIFACTS["candidates"].ddl + ", seq array<int>")


def final_of(spark, cands, routing, keys, index=None, errors=None):
    fields = spark.createDataFrame([("r", i, k, None, "string") for i, k in enumerate(keys)], SCHEMA_FIELDS)
    index = index or spark.createDataFrame([("r", "d1", "f", "m", 1, True, None, "0")], DOC_INDEX)
    routing = spark.createDataFrame(routing, ROUTING_ROWS)
    return {r.field: r for r in L.select_final(fields, L.score_candidates(cands, routing, AS_OF), routing, index, errors).collect()}


def test_contradiction_agreement_and_alternatives(spark):
    routing = [("r", "dob", 1, "d1", 1.0), ("r", "dob", 2, "d2", 0.5), ("r", "full_name", 1, "d1", 1.0), ("r", "full_name", 2, "d2", 1.0)]
    got = final_of(spark, candidates(
        spark, ("dob", "1990-01-01", "d1", "heuristic", 1.0, True), ("dob", "1980-01-01", "d2", "heuristic", 1.0, True), ("dob", "1970-01-01", "d2", "llm", 1.0, False),
        ("full_name", "jane doe", "d2", "heuristic", 1.0, True), ("full_name", "jane doe", "d1", "heuristic", 1.0, True), ("full_name", "12", "d1", "llm", 0.0, False)),
        routing, ["full_name", "dob", "phone"])
    dob, name = got["dob"], got["full_name"]
    assert (dob.status, dob.normalized_value, round(dob.confidence, 6)) == ("needs_review", "1990-01-01", 0.7)
    assert [a.normalized_value for a in dob.alternatives] == ["1970-01-01", "1980-01-01"] or [a.normalized_value for a in dob.alternatives] == ["1980-01-01", "1970-01-01"]
    assert (name.status, name.confidence, name.evidence[0].doc_id) == ("filled", 1.0, "d2")
    assert dob.contradiction and not name.contradiction
    assert name.rationale == ["literal_anchor", "validator_passed", "best_doc_relevance", "cross_doc_agreement"]
    assert [(a.normalized_value, a.rejected_reasons) for a in name.alternatives] == [("jane doe", []), ("12", ["unsupported_by_evidence"])]
    assert (got["phone"].status, got["phone"].value, got["phone"].confidence, got["phone"].rationale) == ("missing", None, 0.0, [])


def test_candidates_are_dealt_once(spark):
    """Scoring and choosing deal the wide rows of candidates by field, once each, and all else joins there."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = [("r", "dob", "v", "1990-01-0" + d, [(f"d{d}", 1, "1990-01-0" + d, None)], "heuristic", [], [], (1.0, 0.0, 0.0, 0.0, 0.0), [1, 0, 0, 0]) for d in "12"]
        ddl = "run_id string, field string, raw_value string, normalized_value string, evidence array<struct<doc_id:string,page:int,quoted_text:string,bbox:array<double>>>, " \
              "from_method string, validators array<string>, rejected_reasons array<string>, scores struct<anchor_match:double,validator:double,doc_relevance:double,cross_doc_agreement:double,contradiction_penalty:double>, seq array<int>"
        routing = spark.createDataFrame([("r", "dob", 1, "d1", 0.5), ("r", "dob", 2, "d2", 0.2)], ROUTING_ROWS)
        scored = L.score_candidates(spark.createDataFrame(rows, ddl), routing, datetime.date(2025, 1, 1))
        wide = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
        assert len(wide(scored)) == 2  # candidates and routing
        assert len(wide(L.front_runners(written(scored, "scored")))) <= 1
        assert {(r.normalized_value, round(r.base, 3), r.scores.contradiction_penalty) for r in scored.collect()} == {
            ("1990-01-01", 0.875, 0.3), ("1990-01-02", 0.8, 0.0)}
        # A candidate without a value or bundle agrees with none, and one document routed twice gives two rows, as any join does.
        odd = spark.createDataFrame([(None, *rows[0][1:]), (*rows[0][:3], None, *rows[0][4:]), (*rows[0][:3], None, [("d2", 1, "q", None)], *rows[0][5:])], ddl)
        assert [r.scores.cross_doc_agreement for r in L.score_candidates(odd, routing, datetime.date(2025, 1, 1)).collect()] == [0.0, 0.0, 0.0]
        assert L.score_candidates(spark.createDataFrame(rows[:1], ddl), routing.unionByName(routing), datetime.date(2025, 1, 1)).count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_missing_says_why(spark):
    index = spark.createDataFrame([("r", "d1", "f", "m", 1, False, "no_text_layer", "0")], DOC_INDEX)
    errors = spark.createDataFrame([("r", "dob", "bad")], "run_id string, field string, message string")
    got = final_of(spark, candidates(spark).limit(0), [], ["dob", "phone"], index, errors)
    assert got["phone"].rationale == ["no_readable_docs", "no_text_layer"] and got["dob"].rationale[-1] == "llm_invalid_json"


def test_validators(spark):
    cases = [("full_name", "jane", [], 1.0), ("full_name", "123a", [], 0.0), ("dob", "2024-02-30", [], 0.0), ("dob", "2030-01-01", [], 0.0),
             ("dob", "1904-12-31", [], 0.0), ("dob", "1990-05-05", [], 1.0), ("phone", "15551234567", ["default_country_assumed"], 0.6),
             ("phone", "123", [], 0.0), ("insurance_member_id", "abc", [], 0.0), ("insurance_member_id", "x" * 33, [], 0.0), ("address", " ", [], 0.0), ("allergies", "none", [], 1.0)]
    df = spark.createDataFrame(cases, "f string, v string, w array<string>, want double")
    for r in df.select("f", "v", "want", L.validator_score(F.col("f"), F.col("v"), F.col("w"), AS_OF).alias("got")).collect():
        assert r.got == r.want, r


def test_overrides_population_and_metrics(spark):
    final = final_of(spark, candidates(spark, ("dob", "1990-01-01", "d1", "heuristic", 1.0, True), ("full_name", "jane", "d1", "heuristic", 0.0, True)),
                     [("r", "dob", 1, "d1", 1.0)], ["full_name", "dob", "phone", "address"])
    table = spark.createDataFrame(list(final.values()), f"run_id string, {FINAL_FIELD[7:-1].replace('field:', 'field: ', 1)}, contradiction boolean")
    rows = spark.createDataFrame([("r", "dob", "missing", None, 1), ("r", "dob", "override", "2/3/1991", 2), ("r", "full_name", "confirm", None, 1), ("r", "phone", "confirm", None, 1)], OVERRIDES)
    done = {r.field: r for r in P.apply_overrides(table, rows).collect()}
    assert len(done) == 4 and (done["dob"].evidence, done["dob"].confidence, done["dob"].rationale) == ([], 0.0, ["override"]) and len(done["full_name"].evidence) == 1
    after = [r for r in P.eval_metrics(P.apply_overrides(table, rows), spark.createDataFrame([("r", "dob", "2/3/1991")], TRUTH)).collect() if r.overall][0]
    assert (after.exact_match, after.hallucination_rate, after.evidence_coverage) == (1.0, 0.0, 1.0)
    got = {r.field: (r.status, r.normalized_value) for r in done.values()}
    assert got == {"dob": ("filled", "1991-02-03"), "full_name": ("filled", "jane"), "phone": ("missing", None), "address": ("missing", None)}
    report = P.population_report(table, spark.createDataFrame([("r", False)], "run_id string, fillable boolean")).collect()
    assert {(r.population_skipped, r.reason) for r in report} == {(True, "target_not_fillable")}
    truth = spark.createDataFrame([("r", "dob", "January 1, 1990"), ("r", "phone", "1")], TRUTH)
    rates = {r.overall: r for r in P.eval_metrics(table, truth).collect()}
    assert rates[True].exact_match == 0.5 and rates[False].evidence_coverage == 1.0 and rates[True].hallucination_rate == 0.0
    assert rates[True].needs_review_rate == 0.25


# ---- checks and storage -------------------------------------------------

def test_row_violations(spark):
    row = ("r", "ssn", "v", "v", [(" ", 0, "", None)], "regex", [], [], (1.5, -0.1, 0.0, 0.0, 0.0))
    good = ("r", "dob", "v", "v", [("d", 1, "q", None)], "llm", [], [], (1.0, 0.0, 0.0, 0.0, 0.0))
    bare = ("r", "dob", "v", "v", [], "llm", [], [], (1.0, 0.0, 0.0, 0.0, 0.0))
    df = spark.createDataFrame([row, good, bare], ARTIFACTS["candidates"].ddl)
    found = sorted(r.loc for r in K.violations(df, "candidates").collect())
    assert found == ["evidence", "evidence.0.doc_id", "evidence.0.page", "evidence.0.quoted_text", "field", "from_method", "scores.anchor_match", "scores.validator"]
    assert K.sound_rows(df, "candidates").count() == 1
    message = [r.message for r in K.summary(df, "candidates").collect() if r.field == "ssn"][0]
    assert message.startswith("field: Unsupported field key: ssn; evidence.0.doc_id: doc_id must not be empty; ") and "; from_method: Input should be 'heuristic' or 'llm'; " in message
    with pytest.raises(ValueError):
        K.violations_of("unknown")


def test_json_documents(spark):
    docs = [b"", b'{"a":', b"\xff\xfe", b'"text"', b'[{"doc_id":"d","filename":"f","mime_type":"m","has_text_layer":true,"sha256":"s","extra":1}]',
            b'[{"doc_id":1,"filename":"f"}, 5]', b"{}"]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "row_id int, content binary")
    decoded = K.decode_json(df)
    assert [r.parse_error is None for r in decoded.orderBy("row_id").collect()] == [False, False, False, True, True, True, True]
    found = {}
    for r in K.json_violations(decoded, "doc_index").collect():
        found.setdefault(r.row_id, set()).add((r.loc, r.msg))
    assert 4 not in found and found[6] == found[3] == {("", "Input should be a valid list")}
    assert ("0.doc_id", "Input should be a valid string") in found[5] and ("0.sha256", "Field required") in found[5] and ("1", "Input should be an object") in found[5]


FAULTS = {
    "schema": ('{"run_id":"r","schema_source":"odd","resolved_fields":[{"key":"dob","type":"date"},{"key":"ssn","label":null,"type":"blob"}]}',
               [("schema_source", "Input should be 'user_schema', 'fillable_pdf' or 'fallback_v1'"), ("resolved_fields.1.key", "Unsupported field key: ssn"),
                ("resolved_fields.1.type", "Input should be 'date', 'phone', 'string' or 'string_or_list'")]),
    "doc_index": ('{"doc_id":"d","filename":"f","mime_type":"m","has_text_layer":true,"unreadable_reason":"torn","sha256":"s"}',
                  [("unreadable_reason", "Input should be 'no_text_layer' or 'parse_error'")]),
    "layout": ('{"doc_id":"d","pages":[{"page":1,"full_text":""},{"page":-2,"full_text":"t","spans":[{"text":"x","bbox":[1,2]}]}]}', [("pages.1.page", "Page must be >= 1, got -2")]),
    "routing": ('{"field":"ssn","doc_ids":["d"],"scores":{"d":0.5}}', [("field", "Unsupported field key: ssn")]),
    "candidates": ('{"field":"dob","raw_value":"v","normalized_value":"v","evidence":[{"doc_id":"d","page":0,"quoted_text":" "}],"from_method":"llm","scores":{"anchor_match":1,"validator":2,"doc_relevance":0}}',
                   [("evidence.0.page", "Page must be >= 1, got 0"), ("evidence.0.quoted_text", "quoted_text must not be empty"), ("scores.validator", "validator must be in [0, 1], got 2.0")]),
    "final": ('{"run_id":"r","schema_source":"fallback_v1","fields":{"dob":{"field":"dob","status":"done","confidence":-0.5,"rationale":[],"alternatives":[{"field":"ssn","raw_value":"v","normalized_value":"v",'
              '"evidence":[],"from_method":"guess","scores":{"anchor_match":1,"validator":1,"doc_relevance":0}}]}}}',
              [("fields.dob.status", "Input should be 'filled', 'needs_review' or 'missing'"), ("fields.dob.confidence", "confidence must be in [0, 1], got -0.5"),
               ("fields.dob.alternatives.0.field", "Unsupported field key: ssn"), ("fields.dob.alternatives.0.evidence", "evidence must not be empty"),
               ("fields.dob.alternatives.0.from_method", "Input should be 'heuristic' or 'llm'")]),
}


@pytest.mark.parametrize("artifact", list(FAULTS))
def test_rows_and_json_of_an_artifact_have_the_same_nested_faults(spark, artifact):
    text, want = FAULTS[artifact]
    spec = ARTIFACTS[artifact]
    df = spark.createDataFrame([(f"[{text}]" if spec.is_list else text,)], "t string")
    deep = sorted((r.loc.removeprefix("0."), r.msg) for r in K.json_violations(K.decode_json(df.select(F.col("t").cast("binary").alias("content"))), artifact).collect())
    rows = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", spec.ddl).alias("r")).select("r.*")
    assert deep == sorted((r.loc, r.msg) for r in K.violations(rows, artifact).collect()) == sorted(want)


def test_kinds_of_json_scalars(spark):
    def doc(**members):
        return {"doc_id": "d", "filename": "f", "mime_type": "m", "pages": 1, "has_text_layer": True, "sha256": "s", **members}

    valid, whole, real = (f"Input should be a valid {k}" for k in ("boolean", "integer", "number"))
    cases = [(doc(pages=v), None) for v in (None, 3, 3.0, "3", " 4 ", "5.0", True)] + [(doc(has_text_layer=v), None) for v in ("yes", "OFF", 0, 1.0, False)]
    cases += [(doc(pages=2.5), f"{whole}, got a number with a fractional part"), (doc(pages="x"), f"{whole}, unable to parse string as an integer"), (doc(pages=[1]), whole),
              (doc(has_text_layer="maybe"), f"{valid}, unable to interpret input"), (doc(has_text_layer=2), f"{valid}, unable to interpret input"), (doc(has_text_layer=None), valid), (doc(has_text_layer={}), valid),
              (doc(sha256=5), "Input should be a valid string"), (doc(sha256=None), "Input should be a valid string")]
    df = spark.createDataFrame([(i, bytearray(json.dumps([c]).encode())) for i, (c, _) in enumerate(cases)], "row_id int, content binary")
    found = {r.row_id: r.msg for r in K.json_violations(K.decode_json(df), "doc_index").collect()}
    assert [found.get(i) for i in range(len(cases))] == [w for _, w in cases]
    scores = [("1e3", None), ('"0.5"', None), ("true", None), ('"x"', f"{real}, unable to parse string as a number"), ("null", real), ("[]", real)]
    df = spark.createDataFrame([(i, bytearray(f'[{{"field":"dob","doc_ids":[],"scores":{{"a.b":{v}}}}}]'.encode())) for i, (v, _) in enumerate(scores)], "row_id int, content binary")
    found = {r.row_id: (r.loc, r.msg) for r in K.json_violations(K.decode_json(df), "routing").collect()}
    assert [found.get(i, (0, None))[1] for i in range(len(scores))] == [w for _, w in scores] and found[3][0] == "0.scores.a.b"


def test_artifacts_and_trace(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"r{i}", "d", "f.pdf", "application/pdf", 1, True, None, "0") for i in range(200)]
    store.write_artifact(spark.createDataFrame(rows, DOC_INDEX), "doc_index", root)
    fresh = spark.createDataFrame([("r7", "e", "g.pdf", "application/pdf", 2, True, None, "1"), ("new", "d", "h", "m", 1, True, None, "2")], DOC_INDEX)
    store.replace_bundles(fresh, "doc_index", root)
    back = store.read_artifact(spark, "doc_index", root)
    assert back.count() == 201 and [r.doc_id for r in back.filter("run_id = 'r7'").collect()] == ["e"]
    row = ("r", "dob", "v", "v", [("d", 1, "q", None)], "llm", [], [], (1.0, 0.0, 0.0, 0.0, 0.0))
    for name, data in {"candidates": row, "routing": ("r", "dob", ["d"], {"d": 0.5}), "schema": ("r", "fallback_v1", [("dob", None, "date")], [])}.items():
        for fmt in ("parquet", "json"):
            store.write_artifact(spark.createDataFrame([data], ARTIFACTS[name].ddl), name, f"{root}/{fmt}", fmt)
            assert [tuple(r) for r in store.read_artifact(spark, name, f"{root}/{fmt}", fmt).collect()] == [data]
    steps = spark.createDataFrame([("r", "route_docs", "warn")], "run_id string, step string, status string")
    for _ in range(2):
        store.append_trace(O.trace_rows(steps, F.lit("2025-01-01 00:00:00").cast("timestamp")), root)
    assert [r.ts for r in store.read_trace(spark, root).filter("status = 'warn'").collect()] == ["2025-01-01T00:00:00.000000Z"] * 2
    line = "".join(f.read_text() for f in (tmp_path / "trace").glob("*.json")).splitlines()[0]
    assert list(json.loads(line)) == sorted(json.loads(line))


def test_uploads_from_files(spark, tmp_path):
    for run, name, body in [("a", "x.pdf", b"%PDF1"), ("a", "b.txt", b"t"), ("b", "x.pdf", b"%PDF2")]:
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_bytes(body)
    uploads = store.read_uploads(spark, str(tmp_path))
    rows = sorted(uploads.collect(), key=lambda r: (r.run_id, r.upload_ord))
    assert [(r.run_id, r.filename, bytes(r.content)) for r in rows] == [
        ("a", "b.txt", b"t"), ("a", "x.pdf", b"%PDF1"), ("b", "x.pdf", b"%PDF2")]
    assert sorted((r.run_id, r.doc_id, r.filename) for r in I.ingest(uploads).collect()) == [
        ("a", "doc_001", "b.txt"), ("a", "doc_002", "x.pdf"), ("b", "doc_001", "x.pdf")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contents_stay_out_of_exchanges_and_joins(spark, tmp_path):
    for i in range(6):
        (tmp_path / "in" / f"r{i % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"r{i % 2}" / f"f {i}%20.pdf").write_bytes(b"%PDF" + b"xyz"[i % 3:i % 3 + 1] * 10)
    listed = store.list_uploads(spark, str(tmp_path / "in"))
    assert "content" not in listed.columns
    uploads = store.open_files(store.spread_files(listed))
    assert {(r.filename, bytes(r.content)) for r in uploads.collect()} == {(f"f {i}%20.pdf", b"%PDF" + b"xyz"[i % 3:i % 3 + 1] * 10) for i in range(6)}
    calls = tmp_path / "calls"

    def reader(content):
        with open(calls, "a") as log:
            log.write(content.decode() + "\n")
        return [content.decode()[4:]]

    kept = written(I.describe(listed), "kept")
    root, stored = f"{tmp_path}/store", I.stored_files(kept)
    first = I.page_texts(stored.filter("run_id = 'r0'"), reader, store.read_page_texts(spark, root))
    lines = plan_of(first).split("\n")
    above = [line for line in lines[: next(i for i, line in enumerate(lines) if "MapInArrow" in line)] if "Join" in line or "Aggregate" in line or "Repartition" in line]
    assert not above and plan_of(first).count("MapInPandas") == 1
    store.add_page_texts(first, root)
    texts = store.add_page_texts(I.page_texts(stored, reader, store.read_page_texts(spark, root)), root)
    assert texts.count() == 3 and sorted(calls.read_text().split()) == sorted("%PDF" + c * 10 for c in "xyz")
    index = I.ingest(kept)
    got = {(r.run_id, r.doc_id): r.pages for r in I.extractions_by_content(index, texts).collect()}
    assert got == {(f"r{i % 2}", f"doc_00{i // 2 + 1}"): ["xyz"[i % 3] * 10] for i in range(6)}


def test_small_contents_share_files(spark, tmp_path):
    bodies = [f"%PDF {i}#1+2".encode() for i in range(300)] + [b"", b"%PDF" + b"x" * store.SMALL_BYTES]
    uploads = spark.createDataFrame([(f"r{i % 3}", i, f"{i}.pdf", bytearray(b)) for i, b in enumerate(bodies * 2)] + [("r0", 9999, "null.pdf", None)], UPLOADS).repartition(2)
    root = f"{tmp_path}/a #7+3"
    for _ in range(2):
        kept = written(I.describe(uploads, root), "kept")
    files = [f for f in (tmp_path / "a #7+3").rglob("*") if f.is_file()]
    # The large one, and one file a task: not one a content.
    assert len(files) == 3 and sum(f.stat().st_size == len(bodies[-1]) for f in files) == 1
    opened = store.open_files(kept.filter("path IS NOT NULL")).collect()
    assert len(opened) == len(bodies) * 2 and all(bytes(r.content) == bodies[r.upload_ord % len(bodies)] for r in opened)
    assert [r.path for r in kept.filter("upload_ord = 9999").collect()] == [None]
    texts = I.page_texts(I.stored_files(kept), lambda content: [content.decode()[4:]]).collect()
    assert sorted(r.pages[0] for r in texts) == sorted(b.decode()[4:] for b in bodies if b)


def test_written_files_appear_once_and_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/x", bytearray(b"one")), ("a/x", bytearray(b"one")), ("b/y z", bytearray(b""))], "name string, content binary")
    for _ in range(2):
        assert sorted(r.path for r in store.write_files(rows, str(tmp_path), "name").collect()) == [f"{tmp_path}/a/x"] * 2 + [f"{tmp_path}/b/y z"]
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"a/x": b"one", "b/y z": b""}
    with pytest.raises(ValueError):
        store.read_file("ftp://host/x")


def test_uploads_in_nested_folders(spark, tmp_path):
    for name, body in [("a/sub/b.pdf", b"%PDF1"), ("b/sub/b.pdf", b"%PDF2"), ("b/sub/deep/c.txt", b"t"), ("beside.txt", b"x")]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = store.read_uploads(spark, f"file://{tmp_path}").orderBy("run_id", "upload_ord").collect()
    assert [(r.run_id, r.filename, bytes(r.content)) for r in rows] == [
        ("a", "sub/b.pdf", b"%PDF1"), ("b", "sub/b.pdf", b"%PDF2"), ("b", "sub/deep/c.txt", b"t")]
    with pytest.raises(ValueError):
        store.read_uploads(spark, "bundles")


def test_whole_job_with_a_model(spark, tmp_path):
    pages = spark.createDataFrame([("r", "d1", 1, 0, "Patient Name: Jane Doe\nDOB: 1990-05-15\nreach her on 555-123-4567"),
                                   ("r", "d2", 1, 0, "Name: Jane Doe")], PAGES)
    index = spark.createDataFrame([("r", d, "f", "application/pdf", 1, True, None, "0") for d in ("d1", "d2")], DOC_INDEX)

    def model(messages, limit):
        if 'field "address"' in messages[0]["content"]:
            return '[{"raw_value":"1 Side St","evidence":[{"doc_id":"d1","page":1,"quoted_text":"made up"}]}]'
        return "[]"

    out = extract_fields(spark.createDataFrame([("r",)], "run_id string"), index, pages, spark.createDataFrame([], USER_SCHEMAS),
                         spark.createDataFrame([], FORM_FIELDS), as_of=AS_OF, model=model)
    final = {r.field: (r.status, r.normalized_value) for r in out.final.collect()}
    assert final["full_name"][1] == "jane doe" and final["dob"][1] == "1990-05-15" and final["phone"] == ("needs_review", "15551234567")
    assert final["address"] == ("missing", None)
    stats = {r.field: (r.heuristic_count, r.rejected_count) for r in out.stats.collect()}
    assert stats["full_name"] == (2, 0) and stats["address"] == (0, 1)
    steps = {r.step: (r.status, r.rows_in, r.rows_out) for r in out.steps.collect()}
    assert steps == {"resolve_schema": ("ok", 1, 7), "extract_text": ("ok", 2, 2), "route_docs": ("ok", 2, 14), "extract_candidates": ("ok", 14, 5), "score_select": ("ok", 5, 7)}
    assert out.events.count() == 14 and out.warnings.count() == out.errors.count() == 0
    assert {"base", "confidence"} <= set(out.candidates.columns)
    assert store.write_artifact(out.candidates, "candidates", str(tmp_path))
