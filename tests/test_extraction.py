import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.operators import candidates as C
from attesta.operators import evidence as G
from attesta.operators import excerpts as X
from attesta.operators import extract as E
from attesta.operators import routing as R
from attesta.schemas import DOC_INDEX, PAGES, ROUTING_ROWS, SCHEMA_FIELDS
from attesta.settings import RunOptions


def pages_of(spark, docs):
    """{(run, doc): [page text, ...]} as a page table."""
    rows = [(run, doc, i + 1, i, text) for (run, doc), texts in docs.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, PAGES)


def index_of(spark, docs, unreadable=()):
    rows = [(run, doc, f"{doc}.pdf", "application/pdf", 1, doc not in unreadable or unreadable[doc] == "flag_only",
             unreadable[doc] if doc in unreadable else None, "0") for run, doc in docs]
    rows = [r if r[6] != "flag_only" else (*r[:6], "parse_error", r[7]) for r in rows]
    return spark.createDataFrame(rows, DOC_INDEX)


def fields_of(spark, run, *keys, labels={}):
    rows = [(run, i, k, labels.get(k), "string") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, SCHEMA_FIELDS)


def extract(spark, field, *texts, doc="d1"):
    pages = pages_of(spark, {("r", doc): list(texts)})
    routing = spark.createDataFrame([("r", field, 1, doc, 1.0)], ROUTING_ROWS)
    return E.heuristic_candidates(routing, pages).collect()


def values(rows):
    return {r.normalized_value for r in rows}


def test_date_candidates(spark):
    page_two, = extract(spark, "dob", "nothing", "DOB: 1990-05-15")
    assert (page_two.evidence[0].page, page_two.scores.anchor_match) == (2, 1.0)
    plain, = extract(spark, "dob", "Some text 2024-01-15 more text")
    assert plain.scores.anchor_match == 0.0 and plain.evidence[0].quoted_text == "Some text 2024-01-15 more text"
    assert len(extract(spark, "dob", "DOB: 1990-05-15\nBirthdate: 05/15/1990", "born 1990-05-15")) == 1
    across, = extract(spark, "dob", "DOB: May 5,\n1980")
    assert across.evidence[0].quoted_text == "DOB: May 5," and across.raw_value == "May 5,\n1980"


def test_phone_candidates(spark):
    flagged, = extract(spark, "phone", "call +1 555-123-4567")
    assert flagged.normalized_value == "15551234567" and flagged.validators == ["default_country_assumed"]
    rows = {r.normalized_value: r.validators for r in extract(spark, "phone", "Tel: 15551234567")}
    assert rows == {"11555123456": ["default_country_assumed"], "15551234567": []}
    assert extract(spark, "phone", "123-4567") == []


def test_insurance_candidates(spark):
    assert values(extract(spark, "insurance_member_id", "Insurance member information")) == {"information"}
    assert values(extract(spark, "insurance_member_id", "He said fine\nother")) == {"said", "fine"}
    assert values(extract(spark, "insurance_member_id", "Policy XYZ12 Jan151990 group")) == {"xyz12"}


def test_labelled_candidates(spark):
    assert values(extract(spark, "full_name", "Patient: Jane Doe")) == {"jane doe"}
    assert values(extract(spark, "full_name", "Username: bob\nName: 12345a\nName: x")) == {"bob"}
    assert values(extract(spark, "full_name", "Full Name: Ann Lee,;.")) == {"ann lee"}
    assert values(extract(spark, "address", "Address: x Street: 45 Elm St")) == {"x street 45 elm st", "45 elm st"}
    assert values(extract(spark, "allergies", "Known allergies: Penicillin, Sulfa")) == {"penicillin sulfa"}
    assert values(extract(spark, "medications", "RX: a\nmeds : Aspirin 81mg")) == {"aspirin 81mg"}


def test_values_are_kept_per_document_and_unknown_documents_drop(spark):
    docs = {("r", "d1"): ["Name: Jane Doe"], ("r", "d2"): ["Patient: Jane Doe"]}
    routing = spark.createDataFrame([("r", "full_name", i + 1, d, 1.0) for i, d in enumerate(["d2", "gone", "d1"])], ROUTING_ROWS)
    rows = E.heuristic_candidates(routing, pages_of(spark, docs)).orderBy("seq").collect()
    assert [r.evidence[0].doc_id for r in rows] == ["d2", "d1"]


def test_all_missing_text(spark):
    text = "Subjective:\nReports tightness when walking uphill, relieved by rest.\nPlan:\n- Schedule f/u in two weeks."
    for field in ("full_name", "dob", "phone", "address", "allergies", "medications"):
        assert extract(spark, field, text) == []


def plain_phones(text):
    """First-wins phone scan written from the rules."""
    shapes = [r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
              r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\b1\d{10}\b", r"\b\d{10}\b"]
    seen = {}
    for shape in shapes:
        for m in re.finditer(shape, text):
            number = re.sub(r"\D", "", m.group(0))
            value = "1" + number if len(number) == 10 else number
            left, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            line = text[left:len(text) if end < 0 else end].strip()
            if len(value) >= 10 and line and value not in seen:
                near = text.lower()[max(0, m.start() - 50):m.start()]
                anchor = any(w in near for w in ["phone", "mobile", "telephone", "tel", "cell", "contact"])
                seen[value] = (m.group(0).strip(), line, 1.0 if anchor else 0.0, len(number) == 10)
    return seen


def test_random_pages_match_a_plain_phone_scan(spark):
    rng = random.Random(3)
    bits = ["555", "1", "12", "4567", "-", " ", "(", ")", "+1", "\n", "tel", "cell ", ".", "5551234567", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(5, 60))) for _ in range(200)]
    pages = spark.createDataFrame([("r", f"d{i:03d}", 1, 0, t) for i, t in enumerate(texts)], PAGES)
    routing = pages.select("run_id", F.lit("phone").alias("field"), F.lit(1).alias("doc_rank"), "doc_id", F.lit(0.0).alias("score"))
    got = {}
    for r in E.heuristic_candidates(routing, pages).collect():
        got.setdefault(r.evidence[0].doc_id, {})[r.normalized_value] = (
            r.raw_value, r.evidence[0].quoted_text, r.scores.anchor_match, bool(r.validators))
    for i, text in enumerate(texts):
        assert got.get(f"d{i:03d}", {}) == plain_phones(text), repr(text)


EVIDENCE_CASES = [
    ("full_name", "john doe", ["Patient Name: Jane Smith"], False), ("full_name", "jane doe", ["Name:  Jane   DOE."], True),
    ("address", "45 maple ave  co", ["45 Maple Ave & Co"], False), ("full_name", "", ["x"], True),
    ("dob", "1990-01-15", ["Born: January 15, 1990"], True), ("dob", "1990-01-15", ["DOB 01/15/1990"], True),
    ("dob", "1990-01-05", ["11/5/1990"], True), ("dob", "1990-01-05", ["seen 1990/1/5"], True),
    ("dob", "1990-11-05", ["x 1/5/1990"], False), ("dob", "1990-1-5", ["1990-1-5"], False),
    ("dob", "1990-01-05", ["21/5/1990 and 1/5/1990"], True), ("dob", "2024-99-99", ["99/99/2024"], True),
    ("phone", "15551234567", ["Tel: 5551234567"], True), ("phone", "15551234567", ["555-999-0000"], False),
    ("phone", "123", ["123"], False), ("allergies", "penicillin, peanuts", ["Allergies: Penicillin, Sulfa"], False),
    ("allergies", "sulfa; penicillin", ["Allergies: Penicillin,", "and Sulfa"], True), ("allergies", ",;", ["x"], False),
    ("medications", "aspirin 81mg", ["Aspirin 81mg daily"], True), ("full_name", "jane", [], False),
]


def test_evidence_support(spark):
    rows = [(i, f, v, [("d", 1, q, None) for q in quotes], want) for i, (f, v, quotes, want) in enumerate(EVIDENCE_CASES)]
    df = spark.createDataFrame(rows, "i int, field string, v string, ev array<struct<doc_id:string,page:int,quoted_text:string,bbox:array<double>>>, want boolean")
    out = df.select("i", "want", G.supported(F.col("field"), F.col("v"), F.col("ev")).alias("got")).orderBy("i").collect()
    assert [(r.i, r.got) for r in out] == [(r.i, r.want) for r in out]


def test_random_dates_found_in_evidence(spark):
    rng = random.Random(5)
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

    def plain(value, text):
        y, m, d = value.split("-")
        m1, d1 = str(int(m)), str(int(d))
        if any(re.search(p, text) for p in (rf"{y}[-/]{m}[-/]{d}", rf"{y}[-/]{m1}[-/]{d1}", rf"{m}[-/]{d}[-/]{y}", rf"{m1}[-/]{d1}[-/]{y}")):
            return True
        return y in text and d.lstrip("0") in text and 1 <= int(m) <= 12 and names[int(m) - 1] in text.lower()

    bits = ["1990", "01", "1", "5", "05", "12", "-", "/", " ", "Jan", "may ", "December"]
    rows = [(i, f"1990-{rng.choice(['01', '05', '12', '13'])}-{rng.choice(['01', '05', '12', '00'])}",
             "".join(rng.choice(bits) for _ in range(12))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v string, t string")
    ev = F.array(F.struct(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("t").alias("quoted_text")))
    for r in df.select("v", "t", G.supports_date(F.col("v"), ev).alias("got")).collect():
        assert r.got == plain(r.v, r.t), (r.v, r.t)


def test_routing_order_limit_and_readability(spark):
    docs = {("r", d): ["phone here"] for d in ["c", "a", "b", "z"]}
    docs[("r", "n")] = ["nothing at all"]
    index = index_of(spark, docs, {"z": "no_text_layer", "b": "flag_only"})
    fields = fields_of(spark, "r", "phone", "dob")
    rows = R.route(fields, index, pages_of(spark, docs)).collect()
    assert [(r.doc_id, round(r.score, 3)) for r in sorted(rows, key=lambda r: r.doc_rank) if r.field == "phone"] == [
        ("a", 0.333), ("c", 0.333), ("n", 0.0)]
    assert len(R.route(fields, index, pages_of(spark, docs), RunOptions(top_k_docs=1)).collect()) == 2


def test_routing_without_readable_documents_is_an_empty_entry(spark):
    docs = {("r", "d"): ["phone"]}
    index = index_of(spark, docs, {"d": "no_text_layer"})
    fields = fields_of(spark, "r", "phone")
    entry, = R.nest_routing(fields, R.route(fields, index, pages_of(spark, docs))).collect()
    assert (entry.doc_ids, entry.scores) == ([], {})
    runs = spark.createDataFrame([("r",)], "run_id string")
    assert R.readable_status(runs, index).first().status == "warn"


def test_labels_join_the_query_and_missing_layout_scores_zero(spark):
    docs = {("r", "d"): ["home visit"]}
    index = index_of(spark, [("r", "d"), ("r", "no_pages")])
    fields = fields_of(spark, "r", "address", labels={"address": "Home, Street"})
    scores = {r.doc_id: r.score for r in R.score_docs(fields, index, pages_of(spark, docs)).collect()}
    assert scores["d"] == pytest.approx(1 / 3) and scores["no_pages"] == 0.0


def test_document_text_joins_pages_without_separator_and_cuts(spark, monkeypatch):
    monkeypatch.setattr(R, "PAGE_SPAN", 4)
    rng = random.Random(1)
    texts = [rng.choice(["", "ab", "c", "defg"]) for _ in range(150)]
    docs = {("r", "long"): texts, ("r", "short"): ["pho", "ne"], ("r", "blank"): ["", ""]}
    pages = pages_of(spark, docs).orderBy(F.rand(3))
    for limit in (7, 60, 10000):
        got = {r.doc_id: r.text for r in R.doc_text(pages, limit).collect()}
        assert got == {"long": "".join(texts)[:limit], "short": "phone"}


def test_whole_texts_are_scored_over_page_edges(spark, monkeypatch):
    monkeypatch.setattr(R, "PAGE_SPAN", 3)
    rng = random.Random(2)
    piece = lambda: "".join(rng.choice(["pho", "ne", " ", "Phone", "mo", "bile", ". ", "x", "tel"]) for _ in range(rng.randrange(4)))
    docs = {("r", f"d{i}"): [piece() for _ in range(rng.randrange(1, 25))] for i in range(40)}
    docs["r", "end"] = ["word " * 9000 + "pho", "", "ne"]
    fields = fields_of(spark, "r", "phone", labels={"phone": "Tel Mobile"})
    asked = set(fields.select(R.query_tokens(F.col("key"), F.col("label"))).first()[0])
    got = {r.doc_id: r.score for r in R.score_docs(fields, index_of(spark, list(docs)), pages_of(spark, docs).orderBy(F.rand(4))).collect()}
    want = {d: len(asked & set(re.findall("[a-z0-9]{2,}", "".join(t).lower()))) / len(asked) for (_, d), t in docs.items()}
    assert got == pytest.approx(want) and got["end"] > 0


def test_no_page_words_are_shuffled_without_labels(spark):
    docs = {("r", "d"): ["Phone 1 ", "mobile"], ("r", "e"): ["street address"]}
    scores = R.score_docs(fields_of(spark, "r", "phone", "address"), index_of(spark, docs), pages_of(spark, docs))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect(others" not in plan and "bit_or" in plan and "words" not in [c for line in plan.split("\n") if "Exchange" in line for c in line.split()]
    assert {(r.doc_id, r.field): round(r.score, 3) for r in scores.collect()} == {("d", "phone"): 0.667, ("d", "address"): 0.0, ("e", "phone"): 0.0, ("e", "address"): 1.0}
    assert len(R.VOCABULARY) < 63


def test_documents_are_scored_without_a_lambda(spark):
    """Queries of a bundle become rows before they are scored, which Spark compiles."""
    docs = {("r", "d"): ["Phone 1"]}
    for labels in ({}, {"phone": "Visit Nurse"}):
        scores = R.score_docs(fields_of(spark, "r", "phone", labels=labels), index_of(spark, docs), pages_of(spark, docs))
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert "inline(queries" in plan and "inline(transform(" not in plan
        assert [round(r.score, 3) for r in scores.collect()] == [0.2 if labels else 0.333]


def test_odd_month_digits_do_not_end_the_job(spark):
    row = spark.createDataFrame([("2001-0\u0662-03", [("d", 1, "on 2001-02-03")])], "v string, e array<struct<doc_id:string,page:int,quoted_text:string>>")
    assert row.select(G.supports_date(F.col("v"), F.col("e")).alias("s")).first().s is False


def greedy(docs, words, total, per_doc, max_pages):
    """The budgets spent page by page, as the rule is worded."""
    out, left = [], total
    for doc, texts in docs:
        chosen = [i for i, t in enumerate(texts) if any(w in t.lower() for w in words)] or [0]
        doc_left = per_doc
        for i in chosen[:max_pages]:
            cut = texts[i][:min(doc_left, left)]
            if cut:
                out.append((doc, i + 1, cut))
                doc_left -= len(cut)
                left -= len(cut)
    return out


def test_excerpts_equal_a_greedy_loop(spark):
    rng = random.Random(11)
    options = RunOptions(excerpt_total_chars=60, excerpt_doc_chars=30, excerpt_doc_pages=3)
    bundles = {f"r{i:02d}": [(f"d{j}", ["".join(rng.choice(["phone ", "x", "yy ", "MOBILE", "My Line "]) for _ in range(rng.randrange(0, 9)))
                                        for _ in range(rng.randrange(1, 8))]) for j in range(4)] for i in range(40)}
    pages = pages_of(spark, {(run, doc): texts for run, docs in bundles.items() for doc, texts in docs})
    routing = spark.createDataFrame([(run, "phone", j + 1, doc, 0.0) for run, docs in bundles.items() for j, (doc, _) in enumerate(docs)], ROUTING_ROWS)
    fields = spark.createDataFrame([(run, "phone", "My line") for run in bundles], "run_id string, field string, label string")
    got = {}
    for r in X.build_excerpts(fields, routing, pages, options).orderBy("run_id", "excerpt_ord").collect():
        got.setdefault(r.run_id, []).append((r.doc_id, r.page, r.text))
    for run, docs in bundles.items():
        assert got.get(run, []) == greedy(docs, ["phone", "mobile", "telephone", "my line"], 60, 30, 3)


def test_default_budgets(spark):
    pages = pages_of(spark, {("r", "d"): ["Name: Test\n" + "x" * 10000]})
    routing = spark.createDataFrame([("r", "full_name", 1, "d", 1.0)], ROUTING_ROWS)
    fields = spark.createDataFrame([("r", "full_name", None)], "run_id string, field string, label string")
    assert [len(r.text) for r in X.build_excerpts(fields, routing, pages).collect()] == [4000]


def test_gate_stats_and_order(spark):
    docs = {("r", "d1"): ["Name: Zed Moe\nDOB: May 5,\n1980"], ("r", "d2"): ["Patient: Amy Poe", "Name: Zed Moe"]}
    pages = pages_of(spark, docs)
    fields = fields_of(spark, "r", "full_name", "dob", "phone")
    routing = spark.createDataFrame([("r", "full_name", 1, "d2", 1.0), ("r", "full_name", 2, "d1", 0.5), ("r", "dob", 1, "d1", 1.0)], ROUTING_ROWS)
    index = index_of(spark, docs)
    routed = C.routed_fields(fields, routing, index)
    found = G.check_evidence(E.heuristic_candidates(routing, pages))
    gate = C.model_gate(routed, found)
    assert {(r.field, r.best_confidence, r.call_model) for r in gate.collect()} == {("full_name", 0.45, True), ("dob", None, True)}
    low = C.model_gate(routed, found, RunOptions(autofill_threshold=0.4))
    assert {(r.field, r.call_model) for r in low.collect()} == {("full_name", False), ("dob", True)}
    stats = {r.field: (r.heuristic_count, r.llm_used, r.accepted_count, r.rejected_count) for r in C.field_stats(routed, gate, found).collect()}
    assert stats == {"full_name": (3, True, 3, 0), "dob": (1, True, 0, 1), "phone": (0, False, 0, 0)}
    order = [(r.field, r.normalized_value, r.evidence[0].doc_id) for r in sorted(C.sort_candidates(found).collect(), key=lambda r: r.place)]
    assert order == [("dob", "1980-05-05", "d1"), ("full_name", "amy poe", "d2"), ("full_name", "zed moe", "d2"), ("full_name", "zed moe", "d1")]
    assert C.routed_fields(fields, routing, index, RunOptions(max_fields=1)).count() == 1


def test_own_extractor(spark):
    shout = lambda text, lowered: F.transform(F.regexp_extract_all(text, F.lit("[A-Z]{3,}"), F.lit(0)), lambda w, i: F.struct(
        F.lit(0).alias("seq1"), i.alias("seq2"), w.alias("raw"), F.lower(w).alias("norm"), w.alias("quote"), F.lit(1.0).alias("anchor"),
        F.array().cast("array<string>").alias("flags")))
    routing = spark.createDataFrame([("r", "shout", 1, "d", 1.0)], ROUTING_ROWS)
    rows = E.heuristic_candidates(routing, pages_of(spark, {("r", "d"): ["an ABC and DEF"]}), {"shout": shout}).collect()
    assert values(rows) == {"abc", "def"}


def test_a_page_meets_all_its_fields_at_once(spark):
    routing = spark.createDataFrame([("r", f, k, "d") for f, k in [("dob", 1), ("phone", 2), ("dob", 3), ("pet", 1)]] + [("r", "dob", 2, "gone"), (None, "dob", 1, "d")],
                                    "run_id string, field string, doc_rank int, doc_id string")
    pages = pages_of(spark, {("r", "d"): ["DOB: 1990-01-02", "Phone 613-555-0199"], ("r", "other"): ["DOB: 1990-01-02"]})
    rows = E.asked_pages(routing, pages, ["full_name", "dob", "phone"]).orderBy("page").collect()
    assert [(r.page, r.bits, sorted(map(tuple, r.asked))) for r in rows] == [(p, 6, [("dob", 1), ("dob", 3), ("phone", 2)]) for p in (1, 2)]
    found = sorted((r.field, r.seq[0], r.normalized_value) for r in E.heuristic_candidates(routing, pages).collect())
    assert found == [("dob", 1, "1990-01-02"), ("dob", 3, "1990-01-02"), ("phone", 2, "16135550199")]


def test_short_documents_are_glued_in_one_step(spark):
    pages = lambda *numbers: spark.createDataFrame([(n,) for n in numbers], "page int")
    span = R.PAGE_SPAN
    assert R._steps(pages()) == R._steps(pages(1, None)) == R._steps(pages(1, span)) == [None]
    assert R._steps(pages(1, span + 1)) == R._steps(pages(-span - 1)) == [span, None]
    assert R._steps(pages(span**2 + 1)) == [span, span**2, None]
