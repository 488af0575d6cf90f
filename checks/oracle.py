"""The registered queries written as SQL for DuckDB.

Each statement follows the rules of the operator, not the plan of the Spark
query: routing counts matching exploded tokens, evidence tests are spelled out
per field, budgets are recomputed from page lengths.
"""

from __future__ import annotations

import re

from checks.bundles import RENDERINGS

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
KEYS = ["full_name", "dob", "phone", "address", "insurance_member_id", "allergies", "medications"]
TYPES = ["string", "date", "phone", "string", "string", "string_or_list", "string_or_list"]
# Query tokens and aliases per field.
TOKENS = {
    "full_name": "full name patient", "dob": "dob date of birth birthdate", "phone": "phone mobile telephone",
    "address": "address street", "insurance_member_id": "insurance member id policy",
    "allergies": "allergies allergy", "medications": "medications meds",
}
ALIASES = {
    "full_name": "full_name name patient_name", "dob": "dob date_of_birth birthdate",
    "phone": "phone mobile telephone", "address": "address street",
    "insurance_member_id": "insurance_member_id member_id policy insurance_id",
    "allergies": "allergies allergy", "medications": "medications meds",
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]


# ---- scalar rules -------------------------------------------------------

def trimmed(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def norm_text(x: str) -> str:
    spaced = rf"regexp_replace(lower({x}), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')"
    return rf"trim(regexp_replace({spaced}, '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'))"


def norm_digits(x: str) -> str:
    return rf"regexp_replace({x}, '[^0-9]', '', 'g')"


def norm_phone(x: str) -> str:
    d = norm_digits(x)
    return f"CASE WHEN length({d}) = 10 THEN concat('1', {d}) ELSE {d} END"


def _month(x: str) -> str:
    whens = " ".join(f"WHEN '{n}' THEN '{i:02d}'" for i, m in enumerate(MONTHS, 1) for n in dict.fromkeys([m, m[:3]]))
    return f"CASE lower({x}) {whens} END"


def norm_date(x: str) -> str:
    two = lambda p, g: f"lpad(regexp_extract({x}, '{p}', {g}), 2, '0')"
    ymd = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    mdy = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
    named = r"^([a-zA-Z]+)\s*(\d{1,2}),?\s*(\d{4})"
    turned = r"^(\d{1,2})\s+([a-zA-Z]+)\s+(\d{4})"
    g = lambda p, i: f"regexp_extract({x}, '{p}', {i})"
    join = lambda y, m, d: f"{y} || '-' || {m} || '-' || {d}"
    return (f"CASE WHEN regexp_matches({x}, '{ymd}') THEN {join(g(ymd, 1), two(ymd, 2), two(ymd, 3))} "
            f"WHEN regexp_matches({x}, '{mdy}') THEN {join(g(mdy, 3), two(mdy, 1), two(mdy, 2))} "
            f"ELSE coalesce(CASE WHEN regexp_matches({x}, '{named}') THEN {join(g(named, 3), _month(g(named, 1)), two(named, 2))} END, "
            f"CASE WHEN regexp_matches({x}, '{turned}') THEN {join(g(turned, 3), _month(g(turned, 2)), two(turned, 1))} END) END")


def norm_for_field(field: str, x: str) -> str:
    return (f"CASE {field} WHEN 'dob' THEN coalesce({norm_date(x)}, {norm_text(x)}) "
            f"WHEN 'phone' THEN {norm_phone(x)} ELSE {norm_text(x)} END")


def supports(field: str, value: str, quote: str) -> str:
    """Evidence test of one value against one quote."""
    y, m, d = (f"regexp_extract({value}, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})', {i})" for i in (1, 2, 3))
    m1, d1 = f"CAST(TRY_CAST({m} AS INT) AS VARCHAR)", f"CAST(TRY_CAST({d} AS INT) AS VARCHAR)"
    sep = "'[-/]'"
    forms = [f"{a} || {sep} || {b} || {sep} || {c}" for a, b, c in
             [(y, m, d), (y, m1, d1), (m, d, y), (m1, d1, y)]]
    name = f"CASE {m} " + " ".join(f"WHEN '{i:02d}' THEN '{n[:3]}'" for i, n in enumerate(MONTHS, 1)) + " END"
    date = (f"regexp_matches({value}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND (" +
            " OR ".join(f"regexp_matches({quote}, {f})" for f in forms) +
            f" OR coalesce(contains({quote}, {y}) AND contains({quote}, ltrim({d}, '0')) AND contains(lower({quote}), {name}), false))")
    dv, dq = norm_digits(value), norm_digits(quote)
    phone = (f"length({dv}) >= 10 AND (contains({dq}, {dv}) OR (starts_with({dv}, '1') AND contains({dq}, substr({dv}, 2))))")
    text = f"contains({norm_text(quote)}, {norm_text(value)})"
    parts = f"[x for x in string_split_regex({value}, '[,;]') if {trimmed('x')} <> '']"
    listed = (f"CASE WHEN regexp_matches({value}, '[,;]') THEN len({parts}) > 0 AND "
              f"len([x for x in {parts} if NOT contains({norm_text(quote)}, {norm_text('x')})]) = 0 ELSE {text} END")
    return (f"CASE WHEN {field} = 'dob' THEN {date} WHEN {field} = 'phone' THEN {phone} "
            f"WHEN {field} IN ('allergies', 'medications') THEN {listed} ELSE {text} END")


# ---- candidate rules ----------------------------------------------------

DATES = [r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b",
         r"\b([A-Za-z]+\s+\d{1,2},?\s+\d{4})\b", r"\b(\d{1,2}\s+[A-Za-z]+\s+\d{4})\b"]
PHONES = [r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
          r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\b1\d{10}\b", r"\b\d{10}\b"]
COLUMNS = "run_id, field, doc_rank, doc_id, page"


def _placed(src: str, patterns: list[str], norm: str, anchors: str, valid: str, flag: str) -> str:
    """Hits of page-wide patterns with their offset, line and anchor."""
    arms = " UNION ALL ".join(
        f"SELECT {COLUMNS}, full_text, {i} AS s1, regexp_extract_all(full_text, '{p}', 0) AS ms, "
        f"string_split_regex(full_text, '{p}') AS gaps FROM {src}" for i, p in enumerate(patterns))
    return f"""
SELECT * FROM (
 SELECT *, {norm} AS norm, {flag} AS flag FROM (
  SELECT {COLUMNS}, s1, pos AS s2, {trimmed('m')} AS raw,
    {trimmed("regexp_extract(substr(full_text, 1, pos), '[^' || chr(10) || ']*$') || regexp_extract(substr(full_text, pos + 1), '^[^' || chr(10) || ']*')")} AS quote,
    CASE WHEN regexp_matches(substr(lower(full_text), CAST(greatest(pos - 50, 0) + 1 AS BIGINT), CAST(least(pos, 50) AS BIGINT)), '{anchors}') THEN 1.0 ELSE 0.0 END AS anchor
  FROM (
   SELECT *, ms[i] AS m, CAST(list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(g) for g in ms[1:i - 1]]), 0) AS BIGINT) AS pos
   FROM ({arms}) p, unnest(range(1, len(ms) + 1)) AS u(i)))) WHERE quote <> '' AND {valid}"""


def date_hits(src: str) -> str:
    return _placed(src, ["(?i)" + p for p in DATES], norm_date("raw"), "dob|date of birth|birthdate|birth date|born",
                   "norm IS NOT NULL", "''")


def phone_hits(src: str) -> str:
    return _placed(src, PHONES, norm_phone("raw"), "phone|mobile|telephone|tel|cell|contact", "length(norm) >= 10",
                   f"CASE WHEN length({norm_digits('raw')}) = 10 THEN 'default_country_assumed' ELSE '' END")


def _lines(src: str) -> str:
    return (f"SELECT {COLUMNS}, CAST(u.n AS BIGINT) AS s1, string_split(full_text, chr(10))[u.n] AS line "
            f"FROM {src}, unnest(range(1, len(string_split(full_text, chr(10))) + 1)) AS u(n)")


def insurance_hits(src: str) -> str:
    return f"""
SELECT * FROM (
 SELECT {COLUMNS}, s1, CAST(i AS BIGINT) AS s2, toks[i] AS raw, {trimmed('line')} AS quote, 1.0 AS anchor, {norm_text('toks[i]')} AS norm, '' AS flag
 FROM (SELECT *, regexp_extract_all(line, '\\b[A-Za-z0-9]{{4,20}}\\b', 0) AS toks FROM ({_lines(src)}) l
       WHERE regexp_matches(lower(line), 'member|policy|id|insurance|subscriber|group')) t, unnest(range(1, len(toks) + 1)) AS u(i))
WHERE lower(raw) NOT IN ('member', 'policy', 'insurance', 'group', 'subscriber') AND ({norm_date('raw')}) IS NULL AND norm <> ''"""


def labelled_hits(src: str, patterns: list[str], clean: str, valid: str) -> str:
    arms = " UNION ALL ".join(
        f"SELECT {COLUMNS}, s1, {i} AS s2, {trimmed(f'''regexp_extract(line, '(?i){p}', 1)''')} AS v, line FROM ({_lines(src)}) l"
        for i, p in enumerate(patterns))
    return f"""
SELECT * FROM (
 SELECT {COLUMNS}, s1, s2, raw, {trimmed('line')} AS quote, 1.0 AS anchor, {norm_text('raw')} AS norm, '' AS flag
 FROM (SELECT *, {clean} AS raw FROM ({arms}) a) b) WHERE {valid} AND norm <> ''"""


def name_hits(src: str) -> str:
    return labelled_hits(
        src, [r"(?:patient\s+)?name\s*:\s*(.+)", r"full\s+name\s*:\s*(.+)", r"patient\s*:\s*(.+)"],
        trimmed("regexp_replace(v, '[,;:.|]+$', '')"),
        f"length(raw) BETWEEN 2 AND 100 AND length({norm_digits('raw')}) <= 0.5 * length(raw)")


def address_hits(src: str) -> str:
    return labelled_hits(src, [r"address\s*:\s*(.+)", r"street\s*:\s*(.+)", r"mailing\s+address\s*:\s*(.+)",
                               r"home\s+address\s*:\s*(.+)"], "v", "length(raw) >= 5")


def list_hits(src: str, words: str) -> str:
    return labelled_hits(src, [rf"(?:{words})\s*:\s*(.+)"], "v", "length(raw) >= 2")


def allergy_hits(src: str) -> str:
    return list_hits(src, "allergies|allergy|allergic to|known allergies")


def medication_hits(src: str) -> str:
    return list_hits(src, "medications|meds|current medications|prescriptions|rx")


HITS = {"full_name": name_hits, "dob": date_hits, "phone": phone_hits, "address": address_hits,
        "insurance_member_id": insurance_hits, "allergies": allergy_hits, "medications": medication_hits}


def first_per_value(hits: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, field, doc_id, norm ORDER BY page, s1, s2) AS rn "
            f"FROM ({hits}) h) WHERE rn = 1")


def of_field(src: str, key: str) -> str:
    return first_per_value(HITS[key](f"(SELECT * FROM {src} WHERE field = '{key}')"))


# ---- relations ----------------------------------------------------------

def _values(rows: list[tuple], cols: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({cols})"


CANDIDATE_ARMS = " UNION ALL ".join(
    f"SELECT {COLUMNS}, s1, s2, raw, quote, anchor, norm, flag FROM ({of_field('routed', k)}) x" for k in KEYS)

RELATIONS: dict[str, tuple[str, list[str]]] = {
    **{name: (sql, []) for name, sql in RENDERINGS.items()},
    "fields": (_values([(i, k, t) for i, (k, t) in enumerate(zip(KEYS, TYPES))], "ord, key, type"), []),
    "vocab": (_values([(k, t) for k in KEYS for t in TOKENS[k].split()], "key, tok"), []),
    "alias": (_values([(k, t) for k in KEYS for t in ALIASES[k].split()], "key, word"), []),
    "raw_pages": ("SELECT run_id, doc_id, 1 AS page, p1 AS t FROM form_docs UNION ALL SELECT run_id, doc_id, 2, p2 FROM form_docs "
                  "UNION ALL SELECT run_id, doc_id, 1, body FROM note_docs WHERE error IS NULL", ["form_docs", "note_docs"]),
    "page_rows": (f"SELECT run_id, doc_id, page, rtrim(t, {BLANKS}) AS full_text FROM raw_pages", ["raw_pages"]),
    "docs": ("SELECT run_id, doc_id, NULL AS error, 2 AS n FROM form_docs UNION ALL "
             "SELECT run_id, doc_id, error, 1 FROM note_docs", ["form_docs", "note_docs"]),
    "doc_index": ("SELECT d.run_id, d.doc_id, d.error, CASE WHEN d.error IS NULL THEN d.n END AS pages, coalesce(t.has_text, false) AS has_text, "
                  "CASE WHEN d.error IS NOT NULL THEN 'parse_error' WHEN NOT coalesce(t.has_text, false) THEN 'no_text_layer' END AS reason "
                  "FROM docs d LEFT JOIN (SELECT run_id, doc_id, bool_or(full_text <> '') AS has_text FROM page_rows GROUP BY ALL) t "
                  "ON d.run_id = t.run_id AND d.doc_id = t.doc_id", ["docs", "page_rows"]),
    "readable": ("SELECT run_id, doc_id FROM doc_index WHERE reason IS NULL", ["doc_index"]),
    "doc_words": ("SELECT DISTINCT run_id, doc_id, w FROM (SELECT run_id, doc_id, unnest(regexp_extract_all(lower(string_agg(full_text, '' ORDER BY page)), '[a-z0-9]+')) AS w "
                  "FROM page_rows GROUP BY run_id, doc_id) WHERE length(w) >= 2", ["page_rows"]),
    "sizes": ("SELECT key, count(*) AS n FROM vocab GROUP BY key", ["vocab"]),
    "doc_scores": ("SELECT r.run_id, s.key AS field, r.doc_id, coalesce(h.hits, 0) * 1.0 / s.n AS score FROM readable r CROSS JOIN sizes s "
                   "LEFT JOIN (SELECT run_id, doc_id, key, count(*) AS hits FROM doc_words JOIN vocab ON w = tok GROUP BY ALL) h "
                   "ON h.run_id = r.run_id AND h.doc_id = r.doc_id AND h.key = s.key", ["readable", "sizes", "doc_words", "vocab"]),
    "routing": ("SELECT run_id, field, rk AS doc_rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY score DESC, doc_id) AS rk FROM doc_scores) WHERE rk <= 3",
                ["doc_scores"]),
    "routed": ("SELECT r.run_id, r.field, r.doc_rank, r.doc_id, p.page, p.full_text FROM routing r JOIN page_rows p ON r.run_id = p.run_id AND r.doc_id = p.doc_id",
               ["routing", "page_rows"]),
    "every_doc": ("SELECT r.run_id, f.key AS field, 1 AS doc_rank, r.doc_id, p.page, p.full_text FROM readable r CROSS JOIN fields f JOIN page_rows p ON r.run_id = p.run_id AND r.doc_id = p.doc_id",
                  ["readable", "fields", "page_rows"]),
    "corpus": ("SELECT source AS run_id, 'phone' AS field, 1 AS doc_rank, CAST(doc_id AS VARCHAR) AS doc_id, 1 AS page, text AS full_text FROM documents", []),
    "found": (CANDIDATE_ARMS, ["routed"]),
    "checked": (f"SELECT *, coalesce({supports('field', 'norm', 'quote')}, false) AS ok FROM found", ["found"]),
    "asked": ("SELECT r.run_id, r.field, max(CASE WHEN c.ok THEN 0.45 * c.anchor END) AS best FROM (SELECT DISTINCT run_id, field FROM routed) r "
              "LEFT JOIN checked c ON c.run_id = r.run_id AND c.field = r.field GROUP BY ALL", ["routed", "checked"]),
    # Pages chosen for excerpts: those naming the field, else the first one.
    "page_marks": ("SELECT r.*, EXISTS (SELECT 1 FROM alias a WHERE a.key = r.field AND contains(lower(r.full_text), a.word)) AS hit FROM routed r", ["routed", "alias"]),
    "picked": ("SELECT *, row_number() OVER (PARTITION BY run_id, field, doc_id ORDER BY page) AS pn FROM page_marks m WHERE hit OR "
               "(NOT EXISTS (SELECT 1 FROM page_marks o WHERE o.run_id = m.run_id AND o.field = m.field AND o.doc_id = m.doc_id AND o.hit) AND page = 1)", ["page_marks"]),
}


def budgeted(doc_cap: int, total_cap: int, max_pages: int) -> str:
    """Excerpt lengths under the two budgets, from lengths alone."""
    return (f"SELECT *, least(len1, greatest({total_cap} - coalesce(sum(len1) OVER (PARTITION BY run_id, field ORDER BY doc_rank, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS len2 FROM "
            f"(SELECT *, least(length(full_text), greatest({doc_cap} - coalesce(sum(length(full_text)) OVER (PARTITION BY run_id, field, doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS len1 "
            f"FROM picked WHERE pn <= {max_pages})")


def excerpts(doc_cap: int, total_cap: int, max_pages: int) -> str:
    return (f"SELECT run_id, field, CAST(row_number() OVER (PARTITION BY run_id, field ORDER BY doc_rank, page) AS BIGINT) AS excerpt_ord, doc_id, page, "
            f"substr(full_text, 1, CAST(len2 AS BIGINT)) AS text FROM ({budgeted(doc_cap, total_cap, max_pages)}) WHERE len2 > 0")


def statement(final: str, *needs: str) -> str:
    """``final`` with every relation it needs in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in RELATIONS[name][1]:
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({RELATIONS[n][0]})" for n in order) + "\n" + final


# ---- model answers, schemas, files, scores ------------------------------

_BODY = "CASE WHEN starts_with(trim(text), '```') THEN regexp_extract(trim(text), '(?s)^```[^\\n]*\\n(.*?)\\n```', 1) ELSE trim(text) END"
_PAGE = ("CASE json_type(ev, '$.page') WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(ev->>'page', '^[0-9]+$') THEN CAST(ev->>'page' AS BIGINT) END "
         "ELSE CAST(floor(CAST(ev->>'page' AS DOUBLE)) AS BIGINT) END")
_RULES = {
    "full_name": "regexp_matches(norm, '[A-Za-z]') AND length({d}) <= 0.5 * length(norm)",
    "dob": "TRY_CAST(norm AS DATE) IS NOT NULL AND TRY_CAST(norm AS DATE) <= DATE '2025-01-01' AND TRY_CAST(norm AS DATE) > DATE '1905-01-01'",
    "phone": "length({d}) >= 10", "address": "trim(norm) <> ''", "insurance_member_id": "length(norm) BETWEEN 4 AND 32",
    "allergies": "trim(norm) <> ''", "medications": "trim(norm) <> ''",
}
_PASSES = "CASE c.field " + " ".join(
    f"WHEN '{k}' THEN coalesce({v.format(d=norm_digits('norm'))}, false)" for k, v in _RULES.items()) + " END"


def _matched(key: str) -> str:
    return "(" + " OR ".join(f"contains(lower(field_name), '{w}')" for w in ALIASES[key].split()) + ")"


RELATIONS.update({
    "answer_text": (f"SELECT *, CASE WHEN NOT json_valid(body) THEN 'Invalid JSON' WHEN json_type(body) <> 'ARRAY' THEN 'Response must be a JSON array' END AS err "
                    f"FROM (SELECT run_id, field, attempt, text, {_BODY} AS body FROM responses)", ["responses"]),
    "answer_items": ("SELECT run_id, field, attempt, CAST(i AS BIGINT) AS item, json_extract(body, '$[' || (i - 1) || ']') AS it FROM answer_text, unnest(range(1, CAST(json_array_length(body) AS BIGINT) + 1)) AS u(i) "
                     "WHERE err IS NULL", ["answer_text"]),
    "answer_evidence": (f"SELECT run_id, field, attempt, item, it->>'raw_value' AS raw, it->>'normalized_value' AS given, ev->>'doc_id' AS doc_id, {_PAGE} AS page, ev->>'quoted_text' AS quote FROM "
                        "(SELECT *, json_extract(it, '$.evidence[' || (j - 1) || ']') AS ev FROM answer_items, unnest(range(1, CAST(coalesce(json_array_length(it, '$.evidence'), 0) AS BIGINT) + 1)) AS u(j) "
                        "WHERE json_type(it) = 'OBJECT' AND coalesce(it->>'raw_value', '') <> '') WHERE json_type(ev) = 'OBJECT'", ["answer_items"]),
    "answers": ("SELECT * FROM answer_evidence WHERE trim(coalesce(doc_id, '')) <> '' AND trim(coalesce(quote, '')) <> '' AND page >= 1", ["answer_evidence"]),
    "settled": ("SELECT run_id, field, CASE WHEN e1 IS NULL THEN 1 ELSE 2 END AS attempt, CASE WHEN e1 IS NULL THEN 'ok' WHEN e2 IS NULL THEN 'retried' ELSE 'invalid_json' END AS status "
                "FROM (SELECT run_id, field, max(CASE WHEN attempt = 1 THEN err END) AS e1, max(CASE WHEN attempt = 2 THEN err END) AS e2 FROM answer_text GROUP BY ALL)", ["answer_text"]),
    "answered": (f"SELECT a.run_id, a.field, a.item, a.raw, coalesce(nullif(a.given, ''), {norm_for_field('a.field', 'a.raw')}) AS norm, a.doc_id, a.page, a.quote, "
                 f"CASE WHEN a.field = 'phone' AND length({norm_digits('a.raw')}) = 10 THEN 'default_country_assumed' ELSE '' END AS flag "
                 "FROM answers a JOIN settled s ON a.run_id = s.run_id AND a.field = s.field AND a.attempt = s.attempt", ["answers", "settled"]),
    # All candidates: m orders methods, t breaks ties in order of finding.
    "cands": (f"SELECT run_id, field, raw, norm, doc_id, page, quote, anchor, flag, ok, 0 AS m, doc_rank AS t FROM checked UNION ALL "
              f"SELECT run_id, field, raw, norm, doc_id, page, quote, 1.0, flag, coalesce({supports('field', 'norm', 'quote')}, false), 1, item FROM answered", ["checked", "answered"]),
    "based": (f"SELECT c.*, coalesce(r.score, 0) AS relevance, CASE WHEN NOT {_PASSES} THEN 0.0 WHEN flag <> '' THEN 0.6 ELSE 1.0 END AS valid FROM cands c "
              "LEFT JOIN routing r ON r.run_id = c.run_id AND r.field = c.field AND r.doc_id = c.doc_id", ["cands", "routing"]),
    "votes": ("SELECT run_id, field, norm, count(DISTINCT doc_id) AS docs FROM cands WHERE ok GROUP BY ALL", ["cands"]),
    "scored": ("SELECT b.*, 0.45 * anchor + 0.30 * valid + 0.25 * relevance AS base, CASE WHEN b.ok AND v.docs >= 2 THEN 0.1 ELSE 0.0 END AS bonus FROM based b "
               "LEFT JOIN votes v ON v.run_id = b.run_id AND v.field = b.field AND v.norm = b.norm", ["based", "votes"]),
    "clashes": ("SELECT run_id, field FROM scored WHERE ok AND round(base, 9) >= 0.6 GROUP BY ALL HAVING count(DISTINCT norm) >= 2", ["scored"]),
    "winners": ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY least(1, base + bonus) DESC, m, norm, t) AS rn FROM scored WHERE ok) WHERE rn = 1", ["scored"]),
    "runners_up": ("SELECT run_id, field, string_agg(norm, '|' ORDER BY rn) AS alt FROM (SELECT s.*, row_number() OVER (PARTITION BY s.run_id, s.field ORDER BY least(1, s.base + s.bonus) DESC, s.m, s.norm, s.t) AS rn FROM scored s "
                   "LEFT JOIN winners w ON w.run_id = s.run_id AND w.field = s.field AND w.m = s.m AND w.norm = s.norm AND w.t = s.t WHERE w.run_id IS NULL) WHERE rn <= 2 GROUP BY ALL", ["scored", "winners"]),
    "tops": ("SELECT run_id, field, max(score) AS top FROM routing GROUP BY ALL", ["routing"]),
    "final": ("SELECT r.run_id, f.key AS field, CASE WHEN w.run_id IS NULL THEN 'missing' WHEN c.run_id IS NOT NULL OR w.flag <> '' OR round(conf, 9) < 0.75 THEN 'needs_review' ELSE 'filled' END AS status, "
              "w.raw AS value, w.norm AS normalized_value, coalesce(conf, 0) AS confidence, w.quote, w.anchor, w.valid, w.relevance, w.bonus, t.top, s.status AS answer "
              "FROM runs r CROSS JOIN fields f LEFT JOIN clashes c ON c.run_id = r.run_id AND c.field = f.key "
              "LEFT JOIN (SELECT w.*, greatest(0, least(1, base + bonus - CASE WHEN k.run_id IS NULL THEN 0 ELSE 0.3 END)) AS conf FROM winners w LEFT JOIN clashes k ON k.run_id = w.run_id AND k.field = w.field) w "
              "ON w.run_id = r.run_id AND w.field = f.key LEFT JOIN tops t ON t.run_id = r.run_id AND t.field = f.key "
              "LEFT JOIN settled s ON s.run_id = r.run_id AND s.field = f.key", ["runs", "fields", "clashes", "winners", "tops", "settled"]),
    # Schemas.
    "schema_docs": ("SELECT run_id, k, CASE WHEN k % 21 = 4 THEN NULL ELSE schema_text END AS j FROM user_schema_text WHERE schema_text IS NOT NULL", ["user_schema_text"]),
    "schema_checks": ("SELECT run_id, j, CASE WHEN j IS NULL OR NOT json_valid(j) THEN 'Failed to parse schema JSON' "
                      "WHEN json_type(j) <> 'OBJECT' OR json_type(j, '$.fields') IS NULL THEN 'Schema JSON must be an object with a ''fields'' array' "
                      "WHEN json_type(j, '$.fields') <> 'ARRAY' THEN '''fields'' must be an array' END AS message FROM schema_docs", ["schema_docs"]),
    "schema_items": ("SELECT run_id, CAST(i AS BIGINT) AS pos, it->>'key' AS key, CASE WHEN json_type(it, '$.label') = 'VARCHAR' THEN it->>'label' END AS label FROM "
                     "(SELECT run_id, i, json_extract(j, '$.fields[' || (i - 1) || ']') AS it FROM schema_checks, unnest(range(1, CAST(json_array_length(j, '$.fields') AS BIGINT) + 1)) AS u(i) WHERE message IS NULL) "
                     "WHERE json_type(it) = 'OBJECT' AND json_type(it, '$.key') = 'VARCHAR'", ["schema_checks"]),
    "user_fields": ("SELECT s.run_id, f.ord, s.key, s.label, f.type, row_number() OVER (PARTITION BY s.run_id ORDER BY f.ord) AS n FROM "
                    "(SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY pos DESC) AS rn FROM schema_items) s JOIN fields f ON f.key = s.key WHERE rn = 1", ["schema_items", "fields"]),
    "user_lists": ("SELECT run_id, string_agg(key || ':' || coalesce(label, '-') || ':' || type, '|' ORDER BY ord) AS fields FROM user_fields GROUP BY run_id", ["user_fields"]),
    "user_unknown": ("SELECT run_id, string_agg(key, ',' ORDER BY pos) AS unknown FROM schema_items WHERE key NOT IN (SELECT key FROM fields) GROUP BY run_id", ["schema_items", "fields"]),
    "form_hits": ("SELECT *, list_filter([" + ", ".join(f"CASE WHEN {_matched(k)} THEN '{k}' END" for k in KEYS) + "], lambda x: x IS NOT NULL) AS keys FROM form_fields WHERE regexp_matches(file_name, '\\.(pdf|PDF)$')", ["form_fields"]),
    "form_first": ("SELECT run_id, min(lower(file_name)) AS low FROM form_hits WHERE len(keys) = 1 GROUP BY run_id", ["form_hits"]),
    "form_lists": ("SELECT run_id, file_name, string_agg(f.key || ':-:' || f.type, '|' ORDER BY f.ord) AS fields FROM (SELECT DISTINCT h.run_id, h.file_name, h.keys[1] AS key FROM form_hits h JOIN form_first x ON x.run_id = h.run_id AND x.low = lower(h.file_name) WHERE len(h.keys) = 1) d "
                   "JOIN fields f ON f.key = d.key GROUP BY ALL", ["form_hits", "form_first", "fields"]),
    # Files.
    "named": ("SELECT *, CASE WHEN last IN ('', '.', '..') THEN NULL ELSE replace(last, '..', '_') END AS safe FROM (SELECT *, " +
              trimmed("regexp_extract(replace(filename, chr(92), '/'), '[^/]*$')") + " AS last, row_number() OVER (PARTITION BY run_id ORDER BY upload_ord) AS position FROM upload_text)", ["upload_text"]),
    "stored": ("SELECT run_id, safe, arg_min(body, upload_ord) AS body, min(upload_ord) AS stored_ord FROM named WHERE safe IS NOT NULL GROUP BY ALL", ["named"]),
    "indexed": ("SELECT n.run_id, 'doc_' || lpad(CAST(n.position AS VARCHAR), CAST(greatest(3, length(CAST(n.position AS VARCHAR))) AS INT), '0') AS doc_id, n.safe AS filename, s.body, "
                "CASE WHEN n.safe ILIKE '%.pdf' THEN 'application/pdf' WHEN n.safe LIKE '%.txt' THEN 'text/plain' WHEN n.safe LIKE '%.html' THEN 'text/html' WHEN n.safe LIKE '%.tar.gz' THEN 'application/x-tar' "
                "WHEN starts_with(s.body, '%PDF') THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime FROM named n JOIN stored s ON s.run_id = n.run_id AND s.safe = n.safe", ["named", "stored"]),
})

_CAND = "run_id, field, raw AS raw_value, norm AS normalized_value, doc_id, CAST(page AS BIGINT) AS page, quote AS quoted_text, CAST(anchor AS DOUBLE) AS anchor_match"
_FINAL = "run_id, field, status, coalesce(value, '') AS value, coalesce(normalized_value, '') AS normalized_value, round(CAST(confidence AS DOUBLE), 6) AS confidence"


def _routed(scores: str, k: int = 3) -> str:
    return (f"SELECT run_id, field, CAST(rk AS BIGINT) AS doc_rank, doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY score DESC, doc_id) AS rk FROM ({scores}) s) WHERE rk <= {k}")


_CORPUS_SCORES = """
SELECT d.run_id, s.key AS field, d.doc_id, coalesce(h.hits, 0) * 1.0 / s.n AS score FROM corpus d CROSS JOIN sizes s
LEFT JOIN (SELECT doc_id, key, count(*) AS hits FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(full_text), '[a-z0-9]+')) AS w FROM corpus)) JOIN vocab ON w = tok GROUP BY ALL) h
ON h.doc_id = d.doc_id AND h.key = s.key"""

_LABELLED = """
SELECT q.run_id, q.key AS field, r.doc_id, coalesce(h.hits, 0) * 1.0 / q.n AS score
FROM (SELECT run_id, key, count(*) AS n FROM asked_tokens GROUP BY ALL) q JOIN readable r ON r.run_id = q.run_id
LEFT JOIN (SELECT t.run_id, t.key, w.doc_id, count(*) AS hits FROM asked_tokens t JOIN doc_words w ON w.run_id = t.run_id AND w.w = t.tok GROUP BY ALL) h
ON h.run_id = q.run_id AND h.key = q.key AND h.doc_id = r.doc_id"""

RELATIONS.update({
    "asked_keys": ("SELECT u.run_id, u.key, u.label FROM user_fields u UNION ALL SELECT l.run_id, unnest(string_split(regexp_replace(l.fields, ':-:[a-z_]+', '', 'g'), '|')), NULL FROM form_lists l "
                   "WHERE l.run_id NOT IN (SELECT run_id FROM schema_checks WHERE message IS NULL) UNION ALL "
                   "SELECT r.run_id, f.key, NULL FROM runs r CROSS JOIN fields f WHERE r.run_id NOT IN (SELECT run_id FROM schema_checks WHERE message IS NULL) AND r.run_id NOT IN (SELECT run_id FROM form_lists)",
                   ["user_fields", "form_lists", "schema_checks", "runs", "fields"]),
    "asked_tokens": ("SELECT a.run_id, a.key, v.tok FROM asked_keys a JOIN vocab v ON v.key = a.key UNION "
                     "SELECT run_id, key, w FROM (SELECT run_id, key, unnest(regexp_extract_all(lower(label), '[a-z0-9]+')) AS w FROM asked_keys WHERE label IS NOT NULL) WHERE length(w) >= 2", ["asked_keys", "vocab"]),
    "no_forms": ("SELECT * FROM doc_scores WHERE doc_id <> 'doc_000000000'", ["doc_scores"]),
})

# The same chain under the schemas the bundles asked for: names get a suffix,
# routing, fields and the answers that count differ.
_CHAIN = ["routing", "routed", "found", "checked", "asked", "answered", "cands", "based", "votes", "scored", "clashes",
          "winners", "tops", "final"]
_RENAME = re.compile(r"\b(" + "|".join(_CHAIN) + r")\b")
for _name in _CHAIN:
    _sql, _needs = RELATIONS[_name]
    RELATIONS[f"{_name}_s"] = (_RENAME.sub(r"\1_s", _sql), [f"{n}_s" if n in _CHAIN else n for n in _needs])
RELATIONS["routing_s"] = (_routed(_LABELLED), ["asked_tokens", "readable", "doc_words"])
RELATIONS["answered_s"] = (RELATIONS["answered"][0] + " JOIN (SELECT DISTINCT run_id, field FROM routed_s) q ON q.run_id = a.run_id AND q.field = a.field",
                           ["answers", "settled", "routed_s"])
RELATIONS["final_s"] = (
    RELATIONS["final_s"][0].replace("FROM runs r CROSS JOIN fields f ", "FROM asked_keys r JOIN fields f ON f.key = r.key "),
    ["asked_keys", *[n for n in RELATIONS["final_s"][1] if n != "runs"]])

RELATIONS["routed_c"] = (f"SELECT r.run_id, r.field, r.doc_rank, r.doc_id, 1 AS page, c.full_text FROM ({_routed(_CORPUS_SCORES)}) r JOIN corpus c ON c.doc_id = r.doc_id",
                         ["corpus", "sizes", "vocab"])
for _name, _needs in {"page_marks": ["routed_c", "alias"], "picked": ["page_marks_c"]}.items():
    RELATIONS[f"{_name}_c"] = (re.sub(r"\b(routed|page_marks|picked)\b", r"\1_c", RELATIONS[_name][0]), _needs)

# What a prompt says about each type.
HINTS = {"full_name": "Return the value as a string.", "dob": "Return the date in YYYY-MM-DD format.",
         "phone": "Return the phone number with digits only (include country code if present).",
         "address": "Return the value as a string.", "insurance_member_id": "Return the value as a string.",
         "allergies": "Return as a string. If multiple values, separate with commas.",
         "medications": "Return as a string. If multiple values, separate with commas."}


def _prompt() -> str:
    from attesta.operators.inference import PROMPT, RETRY_PROMPT

    quote = lambda s: "'" + s.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'"
    hint = "CASE f.key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HINTS.items()) + " END"

    def fill(template: str, **parts: str) -> str:
        text = quote(template)
        for name, sql in parts.items():
            text = f"replace({text}, '{{{name}}}', {sql})"
        return text

    prompt = fill(PROMPT, key="f.key", type="f.type", label="''", hint=hint, context="e.context")
    retry = fill(RETRY_PROMPT, key="f.key", error="'Invalid JSON'")
    return (f"SELECT e.run_id, e.field, CAST(length({prompt}) AS BIGINT) AS prompt_chars, md5({prompt}) AS prompt_md5, md5({retry}) AS retry_md5 FROM "
            f"(SELECT run_id, field, string_agg('[Document: ' || doc_id || ', Page: ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY excerpt_ord) AS context FROM ({excerpts(90, 150, 2)}) GROUP BY ALL) e "
            f"JOIN fields f ON f.key = e.field JOIN asked a ON a.run_id = e.run_id AND a.field = e.field WHERE coalesce(a.best, -1) < 0.75")


def _one(key: str) -> str:
    return statement(f"SELECT {_CAND}, flag AS validators FROM ({first_per_value(HITS[key](chr(40) + 'SELECT * FROM every_doc WHERE field = ' + repr(key) + chr(41)))})", "every_doc")


_STATS = ("SELECT r.run_id, f.key AS field, coalesce(sum(CASE WHEN c.m = 0 THEN 1 END), 0) AS heuristic_count, "
          "CASE WHEN max(a.run_id) IS NOT NULL AND coalesce(max(a.best), -1) < 0.75 THEN 1 ELSE 0 END AS llm_used, "
          "coalesce(sum(CASE WHEN c.ok THEN 1 END), 0) AS accepted_count, coalesce(sum(CASE WHEN NOT c.ok THEN 1 END), 0) AS rejected_count "
          "FROM runs r CROSS JOIN fields f LEFT JOIN asked a ON a.run_id = r.run_id AND a.field = f.key "
          "LEFT JOIN cands c ON c.run_id = r.run_id AND c.field = f.key GROUP BY ALL")
_STATS_BIG = ("SELECT run_id, field, CAST(heuristic_count AS BIGINT) AS heuristic_count, CAST(llm_used AS BIGINT) AS llm_used, "
              f"CAST(accepted_count AS BIGINT) AS accepted_count, CAST(rejected_count AS BIGINT) AS rejected_count FROM ({_STATS})")
_RATIONALE = ("concat_ws(',', CASE WHEN f.anchor = 1 THEN 'literal_anchor' END, CASE WHEN f.valid = 1 THEN 'validator_passed' END, "
              "CASE WHEN f.relevance > 0 AND f.relevance >= f.top THEN 'best_doc_relevance' END, CASE WHEN f.bonus > 0 THEN 'cross_doc_agreement' END, "
              "CASE WHEN f.status = 'missing' AND f.answer = 'invalid_json' THEN 'llm_invalid_json' END, 'alt=' || coalesce(u.alt, ''))")
_METRICS = ("SELECT {who} AS run_id, round(coalesce(sum(exact) / nullif(sum(checked), 0), -1), 6) AS exact_match, round(coalesce(sum(evidenced) / nullif(sum(valued), 0), -1), 6) AS evidence_coverage, "
            "round(coalesce(sum(review) / nullif(count(*), 0), -1), 6) AS needs_review_rate, round(coalesce(sum(unsupported) / nullif(sum(valued), 0), -1), 6) AS hallucination_rate FROM judged {group}")
RELATIONS["judged"] = (
    "SELECT f.run_id, CASE WHEN f.field IN ('dob', 'phone') AND t.value IS NOT NULL THEN 1.0 ELSE 0 END AS checked, "
    f"CASE WHEN f.field IN ('dob', 'phone') AND f.normalized_value = {norm_for_field('f.field', 't.value')} THEN 1.0 ELSE 0 END AS exact, "
    "CASE WHEN f.status <> 'missing' THEN 1.0 ELSE 0 END AS valued, CASE WHEN f.status <> 'missing' AND f.quote <> '' THEN 1.0 ELSE 0 END AS evidenced, "
    "CASE WHEN f.status = 'needs_review' THEN 1.0 ELSE 0 END AS review, "
    f"CASE WHEN f.status <> 'missing' AND NOT coalesce({supports('f.field', 'f.normalized_value', 'f.quote')}, false) THEN 1.0 ELSE 0 END AS unsupported "
    "FROM final f LEFT JOIN truth t ON t.run_id = f.run_id AND t.field = f.field", ["final", "truth"])

_K = "CAST(substr(run_id, 5, 9) AS INT)"
_VIOLATION_ARMS = " UNION ALL ".join([
    f"SELECT run_id, norm AS row_id, 'field' AS loc, 'Unsupported field key: ssn' AS msg FROM named_cands WHERE {_K} % 3 = 0",
    f"SELECT run_id, norm, 'from_method', 'Input should be ''heuristic'' or ''llm''' FROM named_cands WHERE {_K} % 4 = 0",
    f"SELECT run_id, norm, 'evidence', 'evidence must not be empty' FROM named_cands WHERE {_K} % 11 = 0",
    f"SELECT run_id, norm, 'scores.validator', 'validator must be in [0, 1], got 1.5' FROM named_cands WHERE {_K} % 6 = 0",
    f"SELECT run_id, norm, 'evidence.0.doc_id', 'doc_id must not be empty' FROM named_cands WHERE {_K} % 11 <> 0 AND {_K} % 5 = 0",
    f"SELECT run_id, norm, 'evidence.0.page', 'Page must be >= 1, got 0' FROM named_cands WHERE {_K} % 11 <> 0 AND {_K} % 7 = 0",
])
RELATIONS["named_cands"] = (first_per_value(name_hits("(SELECT * FROM every_doc WHERE field = 'full_name')")), ["every_doc"])
_REQUIRED = {"field": "VARCHAR", "raw_value": "VARCHAR", "normalized_value": "VARCHAR", "evidence": "ARRAY", "from_method": "VARCHAR", "scores": "OBJECT"}
_WANTED = {"VARCHAR": "Input should be a valid string", "ARRAY": "Input should be a valid list", "OBJECT": "Input should be an object"}
RELATIONS["raw_answers"] = ("SELECT run_id, field || '/' || attempt AS row_id, text, CASE WHEN NOT json_valid(text) THEN 'Invalid JSON' WHEN json_type(text) <> 'ARRAY' THEN 'Input should be a valid list' END AS err FROM responses", ["responses"])
RELATIONS["raw_items"] = ("SELECT run_id, row_id, CAST(i AS BIGINT) - 1 AS pos, json_extract(text, '$[' || (i - 1) || ']') AS it FROM raw_answers, unnest(range(1, CAST(json_array_length(text) AS BIGINT) + 1)) AS u(i) WHERE err IS NULL", ["raw_answers"])
_JSON_ARMS = " UNION ALL ".join(
    ["SELECT run_id, row_id, '' AS loc, err AS msg FROM raw_answers WHERE err IS NOT NULL",
     "SELECT run_id, row_id, CAST(pos AS VARCHAR), 'Input should be an object' FROM raw_items WHERE json_type(it) <> 'OBJECT'"]
    + [f"SELECT run_id, row_id, pos || '.{n}', CASE WHEN json_type(it, '$.{n}') IS NULL THEN 'Field required' ELSE '{_WANTED[t]}' END FROM raw_items "
       f"WHERE json_type(it) = 'OBJECT' AND (json_type(it, '$.{n}') IS NULL OR json_type(it, '$.{n}') <> '{t}')" for n, t in _REQUIRED.items()]
    + ["SELECT run_id, row_id, pos || '.evidence', 'evidence must not be empty' FROM raw_items WHERE json_type(it, '$.evidence') = 'ARRAY' AND json_array_length(it, '$.evidence') = 0",
       "SELECT run_id, row_id, place, 'Input should be an object' FROM raw_entries WHERE json_type(e) <> 'OBJECT'",
       "SELECT run_id, row_id, place || '.doc_id', 'doc_id must not be empty' FROM raw_entries WHERE json_type(e) = 'OBJECT' AND trim(e->>'doc_id') = ''",
       "SELECT run_id, row_id, place || '.page', CASE WHEN json_type(e, '$.page') = 'DOUBLE' THEN 'Input should be a valid integer, got a number with a fractional part' "
       "WHEN json_type(e, '$.page') = 'VARCHAR' THEN 'Input should be a valid integer, unable to parse string as an integer' ELSE 'Page must be >= 1, got ' || (e->>'page') END FROM raw_entries "
       "WHERE json_type(e) = 'OBJECT' AND (contains(e->>'page', '.') OR CAST(e->>'page' AS DOUBLE) < 1)"])
# Evidence entries of the answers, which have all three members.
RELATIONS["raw_entries"] = ("SELECT run_id, row_id, pos || '.evidence.' || (i - 1) AS place, json_extract(it, '$.evidence[' || (i - 1) || ']') AS e FROM raw_items, "
                            "unnest(range(1, CAST(coalesce(json_array_length(it, '$.evidence'), 0) AS BIGINT) + 1)) AS u(i) WHERE json_type(it) = 'OBJECT' AND json_type(it, '$.evidence') = 'ARRAY'", ["raw_items"])
# Artifact, every how many customers, location and message of each fault.
_FAULTS = [
    ("schema", 3, "schema_source", "Input should be 'user_schema', 'fillable_pdf' or 'fallback_v1'"), ("schema", 5, "resolved_fields.1.key", "Unsupported field key: ssn"),
    ("schema", 7, "unsupported_fields.1", "Input should be a valid string"),
    ("doc_index", 3, "0.pages", "Input should be a valid integer, got a number with a fractional part"),
    ("doc_index", 5, "0.has_text_layer", "Input should be a valid boolean, unable to interpret input"), ("doc_index", 7, "0.unreadable_reason", "Input should be 'no_text_layer' or 'parse_error'"),
    ("layout", 3, "0.pages.1.page", "Page must be >= 1, got 0"), ("layout", 5, "0.pages.1.spans.0.bbox.1", "Input should be a valid number, unable to parse string as a number"), ("layout", 7, "1", "Input should be an object"),
    ("routing", 3, "0.field", "Unsupported field key: ssn"), ("routing", 5, "0.scores.d", "Input should be a valid number"),
    ("candidates", 3, "0.evidence.0.doc_id", "doc_id must not be empty"), ("candidates", 5, "0.scores.validator", "validator must be in [0, 1], got 1.5"), ("candidates", 7, "0.scores.doc_relevance", "Field required"),
    ("final", 3, "fields.dob.status", "Input should be 'filled', 'needs_review' or 'missing'"), ("final", 5, "fields.dob.confidence", "confidence must be in [0, 1], got -0.5"),
    ("final", 7, "fields.dob.alternatives.0.evidence.0.page", "Page must be >= 1, got 0"),
]
_FAULT_ARMS = " UNION ALL ".join(f"SELECT run_id, '{a}' AS artifact, '{loc}' AS loc, '" + msg.replace("'", "''") + f"' AS msg FROM runs WHERE {_K} % {n} = 0" for a, n, loc, msg in _FAULTS)


def _steps() -> str:
    count = lambda rel: f"(SELECT run_id, count(*) AS n FROM {rel} GROUP BY run_id)"
    sides = {"ingest": ("docs", "doc_index"), "resolve_schema": ("runs", "run_fields"), "extract_text": ("doc_index", "page_rows"),
             "route_docs": ("doc_index", "routing"), "extract_candidates": ("routing", "cands"), "score_select": ("cands", "final"),
             "write_final": ("final", "final")}
    return " UNION ALL ".join(
        f"SELECT r.run_id, '{s}' AS step, " +
        ("CASE WHEN r.run_id IN (SELECT run_id FROM readable) THEN 'ok' ELSE 'warn' END" if s == "route_docs" else "'ok'") +
        f" AS status, coalesce(a.n, 0) AS rows_in, coalesce(b.n, 0) AS rows_out FROM runs r LEFT JOIN {count(i)} a ON a.run_id = r.run_id LEFT JOIN {count(o)} b ON b.run_id = r.run_id"
        for s, (i, o) in sides.items())


RELATIONS["run_fields"] = ("SELECT run_id, key FROM runs CROSS JOIN fields", ["runs", "fields"])

_WARNED = ("SELECT run_id, 'user_schema_invalid' AS kind, message FROM schema_checks WHERE message IS NOT NULL UNION ALL "
           "SELECT h.run_id, 'acroform_ambiguous_field', 'Field ''' || h.field_name || ''' matches multiple keys: [' || list_aggregate([chr(39) || x || chr(39) for x in h.keys], 'string_agg', ', ') || ']' "
           "FROM form_hits h LEFT JOIN form_first x ON x.run_id = h.run_id WHERE len(h.keys) > 1 AND h.run_id NOT IN (SELECT run_id FROM schema_checks WHERE message IS NULL) AND (x.low IS NULL OR lower(h.file_name) <= x.low)")


def _job_reports() -> str:
    bad = "FROM asked_s a JOIN settled s ON s.run_id = a.run_id AND s.field = a.field WHERE s.status = 'invalid_json'"
    said = (f"SELECT run_id, kind FROM ({_WARNED}) UNION ALL SELECT a.run_id, 'llm_invalid_json' {bad} UNION ALL SELECT a.run_id, 'event_error' {bad} UNION ALL "
            "SELECT run_id, 'event_ok' FROM asked_s UNION ALL SELECT run_id, 'event_ok' FROM asked_s a WHERE NOT EXISTS (SELECT 1 FROM settled s WHERE s.run_id = a.run_id AND s.field = a.field AND s.status = 'invalid_json')")
    outs = {"resolve_schema": "asked_keys", "extract_text": "page_rows", "route_docs": "routing_s", "extract_candidates": "cands_s", "score_select": "asked_keys"}
    steps = [f"SELECT r.run_id, '{step}/' || " + ("CASE WHEN r.run_id IN (SELECT run_id FROM readable) THEN 'ok' ELSE 'warn' END" if step == "route_docs" else "'ok'") +
             f" AS kind, (SELECT count(*) FROM {rel} x WHERE x.run_id = r.run_id) AS n FROM runs r" for step, rel in outs.items()]
    return f"SELECT run_id, kind, count(*) AS n FROM ({said}) GROUP BY ALL UNION ALL " + " UNION ALL ".join(steps)


ORACLES = {
    "tokenize_docs": "SELECT doc_id, count(DISTINCT w) AS token_count, md5(coalesce(string_agg(DISTINCT w, ' ' ORDER BY w), '')) AS tokens_md5 FROM "
                     "(SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w FROM (SELECT doc_id, [x for x in regexp_extract_all(lower(text), '[a-z0-9]+') if length(x) >= 2] AS ws FROM documents)) GROUP BY doc_id",
    "normalize_text": f"SELECT doc_id, md5({norm_text('text')}) AS normalized_md5 FROM documents",
    "normalize_date": statement(f"SELECT ok, t, {norm_date('t')} AS normalized FROM date_text", "date_text"),
    "normalize_phone": statement(f"SELECT ok, {norm_phone('t')} AS digits, CAST(CASE WHEN length({norm_digits('t')}) = 10 THEN 1 ELSE 0 END AS BIGINT) AS assumed FROM phone_text", "phone_text"),
    "score_docs": statement("SELECT run_id, field, doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM doc_scores", "doc_scores"),
    "route_topk": statement(_routed("SELECT * FROM doc_scores"), "doc_scores"),
    "route_documents": statement(_routed(_CORPUS_SCORES), "corpus", "sizes", "vocab"),
    "route_nested": statement(
        f"SELECT r.run_id, f.key AS field, coalesce(string_agg(x.doc_id, ',' ORDER BY x.doc_rank), '') AS doc_ids, count(x.doc_id) AS scored, round(CAST(coalesce(sum(x.score), 0) AS DOUBLE), 6) AS score_sum "
        f"FROM runs r CROSS JOIN fields f LEFT JOIN (SELECT run_id, field, rk AS doc_rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY score DESC, doc_id) AS rk FROM no_forms) WHERE rk <= 3) x "
        "ON x.run_id = r.run_id AND x.field = f.key GROUP BY ALL", "runs", "fields", "no_forms"),
    "route_labelled": statement(_routed(_LABELLED), "asked_tokens", "readable", "doc_words"),
    "readable_status": statement("SELECT r.run_id, count(d.doc_id) AS readable_docs, CASE WHEN count(d.doc_id) = 0 THEN 'warn' ELSE 'ok' END AS status FROM runs r "
                                 "LEFT JOIN readable d ON d.run_id = r.run_id AND d.doc_id <> 'doc_000000000' GROUP BY ALL", "runs", "readable"),
    **{f"{k}_candidates": _one(k) for k in KEYS},
    "phone_in_documents": statement(f"SELECT run_id, doc_id, raw AS raw_value, norm AS normalized_value, md5(quote) AS quote_md5, CAST(anchor AS DOUBLE) AS anchor_match, flag AS validators FROM ({first_per_value(phone_hits('corpus'))})", "corpus"),
    "evidence_check": statement(f"SELECT {_CAND}, CASE WHEN ok THEN '' ELSE 'unsupported_by_evidence' END AS rejected FROM checked", "checked"),
    "model_gate": statement("SELECT run_id, field, round(CAST(coalesce(best, -1) AS DOUBLE), 6) AS best_confidence, CAST(CASE WHEN coalesce(best, -1) < 0.75 THEN 1 ELSE 0 END AS BIGINT) AS call_model FROM asked", "asked"),
    "field_stats": statement(_STATS_BIG, "runs", "fields", "asked", "cands"),
    "field_events": statement("SELECT run_id, 'field:' || field || ':heuristic' AS step, 'ok' AS status, '' AS error_kind FROM asked UNION ALL "
                              "SELECT a.run_id, 'field:' || a.field || ':llm', CASE WHEN s.status = 'invalid_json' THEN 'error' ELSE 'ok' END, CASE WHEN s.status = 'invalid_json' THEN 'LLMInvalidJSONError' ELSE '' END "
                              "FROM asked a LEFT JOIN settled s ON s.run_id = a.run_id AND s.field = a.field WHERE coalesce(a.best, -1) < 0.75", "asked", "settled"),
    "sorted_candidates": statement("SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY field, m, norm, t) AS place, field, CASE m WHEN 0 THEN 'heuristic' ELSE 'llm' END AS from_method, norm AS normalized_value, doc_id FROM cands", "cands"),
    "excerpts": statement("SELECT run_id, field, excerpt_ord, doc_id, CAST(page AS BIGINT) AS page, text FROM (" + excerpts(90, 150, 2) + ")", "picked"),
    "document_excerpts": statement("SELECT run_id, field, excerpt_ord, doc_id, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM (" +
                                   excerpts(4000, 8000, 3).replace("picked", "picked_c") + ")", "picked_c"),
    "prompts": statement(_prompt(), "picked", "fields", "asked"),
    "model_job": statement(
        "SELECT run_id, field, CAST(CASE k WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS attempt, CASE k WHEN 0 THEN 'unavailable' WHEN 1 THEN 'retried' ELSE 'ok' END AS status, "
        "CAST(CASE k WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS found, CASE k WHEN 0 THEN 'ConnectionError: down' ELSE '' END AS error "
        f"FROM (SELECT run_id, field, CAST('0x' || substr(prompt_md5, 1, 2) AS INT) % 4 AS k FROM ({_prompt()}))", "picked", "fields", "asked"),
    "parse_responses": statement("SELECT t.run_id, t.field, CAST(t.attempt AS BIGINT) AS attempt, coalesce(t.err, '') AS parse_error, coalesce(a.raw, '') AS raw_value, coalesce(a.given, '') AS given_value, "
                                 "coalesce(a.doc_id, '') AS doc_id, coalesce(a.page, 0) AS page, coalesce(a.quote, '') AS quoted_text FROM answer_text t LEFT JOIN answers a ON a.run_id = t.run_id AND a.field = t.field AND a.attempt = t.attempt", "answer_text", "answers"),
    "retry_responses": statement("SELECT s.run_id, s.field, CAST(s.attempt AS BIGINT) AS attempt, s.status, count(a.item) AS found FROM settled s LEFT JOIN answers a ON a.run_id = s.run_id AND a.field = s.field AND a.attempt = s.attempt GROUP BY ALL", "settled", "answers"),
    "response_candidates": statement("SELECT run_id, field, raw AS raw_value, norm AS normalized_value, doc_id, CAST(page AS BIGINT) AS page, quote AS quoted_text, 1.0::DOUBLE AS anchor_match, flag AS validators FROM answered", "answered"),
    "schema_user": statement("SELECT c.run_id, coalesce(l.fields, '') AS fields, coalesce(u.unknown, '') AS unsupported, coalesce(c.message, '') AS message FROM schema_checks c "
                             "LEFT JOIN (SELECT run_id, string_agg(key || ':' || coalesce(label, '-') || ':' || type, '|' ORDER BY ord) AS fields FROM user_fields WHERE n <= 2 GROUP BY run_id) l ON l.run_id = c.run_id LEFT JOIN user_unknown u ON u.run_id = c.run_id",
                             "schema_checks", "user_fields", "user_unknown"),
    "schema_forms": statement("SELECT run_id, file_name, fields FROM form_lists", "form_lists"),
    "schema_resolved": statement("SELECT r.run_id, CASE WHEN c.run_id IS NOT NULL THEN 'user_schema' WHEN f.run_id IS NOT NULL THEN 'fillable_pdf' ELSE 'fallback_v1' END AS schema_source, "
                                 "CASE WHEN c.run_id IS NOT NULL THEN coalesce(l.fields, '') WHEN f.run_id IS NOT NULL THEN f.fields ELSE (SELECT string_agg(key || ':-:' || type, '|' ORDER BY ord) FROM fields) END AS fields, "
                                 "coalesce(CASE WHEN c.run_id IS NOT NULL THEN u.unknown END, '') AS unsupported FROM runs r LEFT JOIN (SELECT run_id FROM schema_checks WHERE message IS NULL) c ON c.run_id = r.run_id "
                                 "LEFT JOIN user_lists l ON l.run_id = r.run_id LEFT JOIN user_unknown u ON u.run_id = r.run_id LEFT JOIN form_lists f ON f.run_id = r.run_id",
                                 "runs", "fields", "schema_checks", "user_lists", "user_unknown", "form_lists"),
    "schema_warnings": statement(_WARNED, "schema_checks", "form_hits", "form_first"),
    "ingest_index": statement("SELECT run_id, doc_id, filename, mime AS mime_type, sha256(body) AS sha256 FROM indexed", "indexed"),
    "rejected_uploads": statement("SELECT run_id, CAST(upload_ord AS BIGINT) AS upload_ord, 'invalid_filename' AS reason FROM named WHERE safe IS NULL", "named"),
    "stored_files": statement("SELECT run_id, safe AS safe_name, CAST(stored_ord AS BIGINT) AS stored_ord, sha256(body) AS sha256 FROM stored", "stored"),
    "doc_index": statement("SELECT run_id, doc_id, CAST(coalesce(pages, -1) AS BIGINT) AS pages, CAST(CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS BIGINT) AS has_text_layer, coalesce(reason, '') AS reason FROM doc_index", "doc_index"),
    "page_table": statement("SELECT run_id, doc_id, CAST(page AS BIGINT) AS page, md5(full_text) AS text_md5 FROM page_rows", "page_rows"),
    "nested_layout": statement("SELECT d.run_id, d.doc_id, count(p.page) AS pages, md5(coalesce(string_agg(p.full_text, '|' ORDER BY p.page), '')) AS text_md5 FROM docs d LEFT JOIN page_rows p ON p.run_id = d.run_id AND p.doc_id = d.doc_id GROUP BY ALL", "docs", "page_rows"),
    "page_extract_job": statement("SELECT run_id, doc_id, CAST(CASE WHEN mime <> 'application/pdf' OR NOT starts_with(body, '%PDF') OR contains(body, 'damaged') THEN -1 ELSE len(string_split(body, chr(12))) END AS BIGINT) AS pages, "
                                  f"CASE WHEN mime <> 'application/pdf' OR NOT starts_with(body, '%PDF') THEN 'no_text_layer' WHEN contains(body, 'damaged') THEN 'parse_error' WHEN trim(substr(body, 5), {BLANKS}) = '' THEN 'no_text_layer' ELSE '' END AS reason FROM indexed", "indexed"),
    "page_text_hashes": statement("SELECT run_id, doc_id, CAST(i + 1 AS BIGINT) AS page, md5(rtrim(string_split(substr(body, 5), chr(12))[i + 1], " + BLANKS + ")) AS text_md5 FROM indexed, "
                                  "unnest(range(len(string_split(substr(body, 5), chr(12))))) AS u(i) WHERE mime = 'application/pdf' AND starts_with(body, '%PDF') AND NOT contains(body, 'damaged')", "indexed"),
    "new_files": statement("SELECT run_id, safe AS safe_name, CAST(min(upload_ord) AS BIGINT) AS stored_ord, sha256(arg_min(body, upload_ord)) AS sha256 FROM named n WHERE safe IS NOT NULL AND upload_ord % 2 = 1 "
                           "AND NOT EXISTS (SELECT 1 FROM named e WHERE e.run_id = n.run_id AND e.safe = n.safe AND e.upload_ord % 2 = 0) GROUP BY run_id, safe", "named"),
    "stored_listing": statement("SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY safe) AS place, safe AS safe_name, sha256(body) AS sha256 FROM stored", "stored"),
    "file_uploads": "SELECT run_id, 'doc_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS doc_id, filename, 'text/html' AS mime_type, sha256 FROM ("
                    "SELECT 'site_' || lpad(CAST(page_id % 7 AS VARCHAR), 3, '0') AS run_id, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS n, "
                    "'p ' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.html' AS filename, sha256(coalesce(html, '')) AS sha256 FROM pages)",
    "doc_relevance": statement("SELECT run_id, field, norm AS normalized_value, CASE m WHEN 0 THEN 'heuristic' ELSE 'llm' END AS from_method, doc_id, round(CAST(relevance AS DOUBLE), 6) AS relevance FROM based", "based"),
    "validators": statement("SELECT run_id, field, norm AS normalized_value, CASE m WHEN 0 THEN 'heuristic' ELSE 'llm' END AS from_method, round(CAST(valid AS DOUBLE), 6) AS validator FROM based", "based"),
    "confidence": statement("SELECT s.run_id, s.field, s.norm AS normalized_value, CASE s.m WHEN 0 THEN 'heuristic' ELSE 'llm' END AS from_method, s.doc_id, round(CAST(s.base AS DOUBLE), 6) AS base, round(CAST(s.bonus AS DOUBLE), 6) AS agreement, "
                            "CASE WHEN c.run_id IS NULL THEN 0.0 ELSE 0.3 END::DOUBLE AS penalty, round(CAST(least(1, s.base + s.bonus) AS DOUBLE), 6) AS confidence FROM scored s "
                            "LEFT JOIN winners w ON s.ok AND w.run_id = s.run_id AND w.field = s.field AND w.m = s.m AND w.norm = s.norm AND w.t = s.t LEFT JOIN clashes c ON c.run_id = w.run_id AND c.field = w.field", "scored", "winners", "clashes"),
    "final_unavailable": statement(f"SELECT run_id, field, status, CAST(CASE WHEN status = 'missing' AND {_K} % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS unavailable FROM final", "final"),
    "contradictions": statement("SELECT run_id, field FROM clashes", "clashes"),
    "final_fields": statement(f"SELECT {', '.join('f.' + c.strip() if ' ' not in c.strip() else c.strip() for c in ['run_id', 'field', 'status'])}, coalesce(f.value, '') AS value, coalesce(f.normalized_value, '') AS normalized_value, "
                              f"round(CAST(f.confidence AS DOUBLE), 6) AS confidence, {_RATIONALE} AS rationale FROM final f LEFT JOIN runners_up u ON u.run_id = f.run_id AND u.field = f.field", "final", "runners_up"),
    "overrides": statement(
        "SELECT f.run_id, f.field, CASE WHEN o.action = 'missing' THEN 'missing/0/override' WHEN o.action = 'override' THEN 'filled/0/override' "
        "ELSE CASE WHEN o.action = 'confirm' AND f.status <> 'missing' THEN 'filled' ELSE f.status END || CASE WHEN f.status = 'missing' THEN '/0' ELSE '/1' END END AS status, "
        "coalesce(CASE o.action WHEN 'override' THEN o.value WHEN 'missing' THEN '' ELSE f.value END, '') AS value, "
        f"coalesce(CASE o.action WHEN 'override' THEN {norm_for_field('f.field', 'o.value')} WHEN 'missing' THEN '' ELSE f.normalized_value END, '') AS normalized_value, "
        "round(CAST(CASE WHEN o.action IN ('override', 'missing') THEN 0 ELSE f.confidence END AS DOUBLE), 6) AS confidence FROM final f "
        "LEFT JOIN (SELECT * FROM overrides QUALIFY row_number() OVER (PARTITION BY run_id, field ORDER BY ord DESC) = 1) o ON o.run_id = f.run_id AND o.field = f.field", "final", "overrides"),
    "bundle_job": statement(f"SELECT {_FINAL} FROM final_s", "final_s"),
    "job_reports": statement(_job_reports(), "runs", "schema_checks", "form_hits", "form_first", "asked_s", "settled", "asked_keys", "page_rows", "routing_s", "cands_s", "readable"),
    "population_report": statement("SELECT f.run_id, f.field, f.status, coalesce(f.value, '') AS value, CAST(CASE WHEN coalesce(t.fillable, false) THEN 0 ELSE 1 END AS BIGINT) AS population_skipped, "
                                   "CASE WHEN t.fillable IS NULL THEN 'no_target' WHEN NOT t.fillable THEN 'target_not_fillable' ELSE '' END AS reason FROM final f LEFT JOIN targets t ON t.run_id = f.run_id", "final", "targets"),
    "eval_metrics": statement(_METRICS.format(who="run_id", group="GROUP BY run_id") + " UNION ALL " + _METRICS.format(who="'overall'", group=""), "judged"),
    "final_map": statement("SELECT run_id, 'fallback_v1' AS schema_source, count(*) AS fields, max(CASE WHEN field = 'dob' THEN status END) AS dob_status, coalesce(max(CASE WHEN field = 'dob' THEN normalized_value END), '') AS dob FROM final GROUP BY run_id", "final"),
    "violations": statement(_VIOLATION_ARMS, "named_cands"),
    "json_violations": statement(_JSON_ARMS, "raw_answers", "raw_items", "raw_entries"),
    "artifact_faults": statement(_FAULT_ARMS, "runs"),
    "step_status": statement(_steps(), "runs", "docs", "doc_index", "run_fields", "page_rows", "routing", "cands", "final", "readable"),
    "artifact_roundtrip": statement("SELECT d.run_id, d.docs, r.routed, '2025-12-12T11:40:12.123456Z' AS ts, 'ok' AS status FROM (SELECT run_id, count(*) AS docs FROM doc_index GROUP BY run_id) d "
                                    "JOIN (SELECT run_id, count(*) AS routed FROM routing GROUP BY run_id) r ON r.run_id = d.run_id", "doc_index", "routing"),
}
