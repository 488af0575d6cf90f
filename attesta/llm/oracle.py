"""DuckDB SQL of those queries of this subpackage that SQL can express, over the whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Windows as strings, the smallest doc_id of each, and the words that no later window covers.
SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, len(w) AS n FROM d),
win AS (SELECT doc_id, j, n, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM word),
owner AS (SELECT s, min(doc_id) AS least FROM win WHERE j + 49 <= n GROUP BY s),
hit AS (SELECT w.doc_id, w.j FROM win w JOIN owner o ON w.s = o.s WHERE w.j + 49 <= w.n AND o.least < w.doc_id),
gone AS (SELECT DISTINCT doc_id, j + k AS j FROM hit, range(50) AS r(k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# Base32 takes five bits a character: four characters from each five hexadecimal digits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1) for i in range(32)], '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""

# Weights by place, targets filled up to three times a source's words, then the ranks of the
# random odds against the inclusion odds, taken while at least half of their words are due.
MIX = rf"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
    ('0x' || substr(md5('mix-1|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS bits FROM documents),
lean AS (SELECT *, floor(1e6 / (1000 + size)) AS short FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size, sum(short * size) AS lean,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM lean GROUP BY source),
fill AS (SELECT *, 3 * source_size AS top, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS place FROM per),
unit AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS unit FROM fill),
goal AS (SELECT source, source_size, CASE WHEN top <= w * unit THEN top::DOUBLE
    ELSE w * min_by(unit, place) FILTER (WHERE top > w * unit) OVER () END AS target, lean / (1e3 * source_size) AS m FROM unit),
ratio AS (SELECT *, target / source_size AS r, 0.5::DOUBLE * least(target / source_size / m, (3 - target / source_size) / (1 - m)) AS slope FROM goal),
mean AS (SELECT doc_id, l.source, size, bits, source_size, target, CASE WHEN source_size > 0
    THEN greatest(0::DOUBLE, least(3::DOUBLE, r + coalesce(slope, 0) * (short / 1e3 - m))) ELSE 0::DOUBLE END AS e
    FROM lean l JOIN ratio g ON l.source IS NOT DISTINCT FROM g.source),
odds AS (SELECT *, floor(e) AS sure, e - floor(e) AS p, (bits + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM mean),
drawn AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS o FROM odds),
ranked AS (SELECT *, floor(o / (1 + o) * 1099511627776::DOUBLE)::BIGINT AS rank FROM drawn),
due AS (SELECT source, max(target) - sum(sure * size) AS due FROM ranked GROUP BY source),
sums AS (SELECT source, rank, sum(size) AS n FROM ranked WHERE rank IS NOT NULL GROUP BY source, rank),
upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY rank) - n AS start FROM sums),
last AS (SELECT u.source, max(rank) AS last FROM upto u JOIN due d ON u.source IS NOT DISTINCT FROM d.source WHERE start + n / 2 <= due GROUP BY u.source)
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN rank <= last THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked r LEFT JOIN last l ON r.source IS NOT DISTINCT FROM l.source
"""

# A word's crc32 is folded over its bytes with the usual table of 256 remainders, made here from its polynomial.
RESAMPLE = r"""
WITH remainder AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i)),
txt AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 'b', item_id, 0, text FROM benchmark),
word AS (SELECT kind, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM txt),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM word)),
feature AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT for i in range(length(h) // 2)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, remainder),
put AS (SELECT kind, row, bucket FROM word JOIN feature USING (w)),
n AS (SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM put GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM n),
heavy AS (SELECT row, count(*) AS n_features, sum(g)::BIGINT AS weight FROM put JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (SELECT id AS doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
    FROM txt LEFT JOIN heavy USING (row) WHERE kind = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND rank <= 10 * n // 100 THEN rank END AS rank FROM ranked
"""

ORACLES = {"op3_substrings": SUBSTRINGS, "op9_warc": WARC, "op10_mix": MIX, "op13_resample": RESAMPLE}
