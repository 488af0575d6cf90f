"""Bundles of documents rendered from the driver's tables.

A customer is a bundle. Its registration form has two pages and each of its
orders is a one-page note. The SQL below runs unchanged in Spark and in DuckDB,
so both sides of a check start from the same text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUSTOMERS = """
SELECT c_custkey AS k, concat('run_', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')) AS run_id,
       replace(c_name, '#', ' ') AS nm, n_name,
       lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0') AS d4,
       lpad(CAST(c_custkey % 12 + 1 AS VARCHAR(20)), 2, '0') AS mm,
       lpad(CAST(c_custkey % 28 + 1 AS VARCHAR(20)), 2, '0') AS dd,
       CAST(1940 + c_custkey % 70 AS VARCHAR(20)) AS yy
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

FORMS = """
SELECT k, run_id, 'doc_000000000' AS doc_id, concat(
  CASE k % 5 WHEN 0 THEN concat('Patient Name: ', nm) WHEN 1 THEN concat('Full Name: ', nm, ',')
             WHEN 2 THEN concat('Patient: ', nm) WHEN 3 THEN concat('Username: user', d4) ELSE 'Intake form' END, chr(10),
  CASE k % 7 WHEN 0 THEN concat('DOB: ', yy, '-', mm, '-', dd)
             WHEN 1 THEN concat('Date of Birth: ', CAST(k % 12 + 1 AS VARCHAR(20)), '/', CAST(k % 28 + 1 AS VARCHAR(20)), '/', yy)
             WHEN 2 THEN concat('Born January 5, ', yy) WHEN 3 THEN concat('Seen on ', yy, '/', mm, '/', dd)
             WHEN 4 THEN concat('DOB: May 5,', chr(10), yy) WHEN 5 THEN 'DOB: 99/99/2024'
             ELSE concat('Birthdate 5 Sept ', yy) END, chr(10),
  CASE k % 5 WHEN 0 THEN concat('Phone: (613) 555-', d4) WHEN 1 THEN concat('Cell +1 613-555-', d4)
             WHEN 2 THEN concat('Tel: 1613555', d4) WHEN 3 THEN 'no number given' ELSE concat('Fax 613.555.', d4) END, chr(10),
  CASE k % 4 WHEN 0 THEN concat('Address: ', d4, ' Maple Ave, ', n_name) WHEN 1 THEN concat('Home Address: ', d4, ' Oak & Co, ', n_name)
             WHEN 2 THEN concat('Address: x Street: ', d4, ' Elm St') ELSE 'Address: n/a' END) AS p1,
  concat(
  CASE k % 4 WHEN 0 THEN concat('Member ID: ABC', d4, 'X') WHEN 1 THEN concat('Policy XYZ', d4, ' Jan151990 group')
             WHEN 2 THEN 'He said fine today' ELSE 'no cover' END, chr(10),
  CASE k % 3 WHEN 0 THEN 'Allergies: Penicillin, Sulfa' WHEN 1 THEN 'Known allergies: none - see chart' ELSE 'Allergic to: p' END, chr(10),
  CASE k % 3 WHEN 0 THEN concat('Current medications: Aspirin 81mg; Drug', d4) WHEN 1 THEN 'Rx: Lisinopril 10mg' ELSE 'meds denied' END, '  ') AS p2
FROM (@customers) c
"""

NOTES = """
SELECT c.k, c.run_id, o_orderkey AS ok, concat('doc_', lpad(CAST(o_orderkey + 1 AS VARCHAR(20)), 9, '0')) AS doc_id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'parse_error: damaged file' END AS error,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('  ', chr(10), ' ')
       ELSE concat('Visit note ', CAST(o_orderkey AS VARCHAR(20)), chr(10), 'Patient: ', c.nm, chr(10),
                   CASE WHEN o_orderkey % 7 = 0 THEN concat('Date of birth 1901-', c.mm, '-', c.dd)
                        WHEN o_orderkey % 7 = 1 THEN concat('DOB: 1/5/', c.yy, ' and 11/5/', c.yy)
                        ELSE concat('DOB: ', c.yy, '-', c.mm, '-', c.dd) END, chr(10),
                   CASE WHEN o_orderkey % 5 = 0 THEN concat('Contact: 613-555-', c.d4) ELSE 'Follow up by mobile' END,
                   CASE WHEN o_orderkey % 17 = 0 THEN concat(chr(10), 'Policy group ', c.d4, 'Z', chr(10), 'Mailing Address: 9 King St') ELSE '' END)
  END AS body
FROM orders JOIN (@customers) c ON o_custkey = c.k
"""

# Uploads with repeated, unsafe and untyped names. Content is text cast to bytes.
UPLOADS = """
SELECT run_id, 0 AS upload_ord, 'forms/intake.pdf' AS filename, concat('%PDF-1.4', chr(10), nm) AS body
FROM (@customers) c
UNION ALL
SELECT c.run_id, CAST(o_orderkey + 1 AS INT) AS upload_ord,
  CASE o_orderkey % 9 WHEN 0 THEN 'scan.pdf' WHEN 1 THEN concat('C:', chr(92), 'in', chr(92), 'x', CAST(o_orderkey AS VARCHAR(20)), '.txt')
       WHEN 2 THEN '..' WHEN 3 THEN concat('a..b', CAST(o_orderkey AS VARCHAR(20)), '.PDF') WHEN 4 THEN 'blob'
       WHEN 5 THEN concat(' note ', CAST(o_orderkey AS VARCHAR(20)), '.html ') WHEN 6 THEN 'dir/' WHEN 7 THEN concat('t', CAST(o_orderkey AS VARCHAR(20)), '.tar.gz')
       ELSE concat('doc', CAST(o_orderkey AS VARCHAR(20)), '.pdf') END AS filename,
  CASE o_orderkey % 4 WHEN 0 THEN concat('%PDF page one ', c.nm, chr(12), 'page two') WHEN 1 THEN concat('%PDF', chr(12), ' ')
       WHEN 2 THEN concat('plain ', CAST(o_orderkey AS VARCHAR(20))) ELSE concat('%PDF damaged ', CAST(o_orderkey AS VARCHAR(20))) END AS body
FROM orders JOIN (@customers) c ON o_custkey = c.k
"""

USER_SCHEMAS = """
SELECT run_id, k, CASE k % 7
  WHEN 1 THEN concat('{"fields":[{"key":"phone","label":"Contact visit"},{"key":"full_name"},{"key":"shoe_size"},{"key":"dob","label":7},{"key":"phone","label":"Mobile ', d4, '"},{"key":"pet"},{"key":"pet"}]}')
  WHEN 2 THEN '{"fields":[1,"dob",{"key":5},{"key":"medications","type":"date"},null,{"label":"x"},{"key":"address","label":"Home, Street"}]}'
  WHEN 3 THEN '{"fields":{"key":"dob"}}'
  WHEN 4 THEN concat('not json ', d4)
  WHEN 5 THEN '{"fields":[]} trailing'
  WHEN 6 THEN CASE WHEN k % 2 = 0 THEN '["fields"]' ELSE '{"fields":[]}' END
  END AS schema_text
FROM (@customers) c
"""

FORM_FIELDS = """
SELECT run_id, k, file_name, field_name FROM (
  SELECT run_id, k, 'b_form.pdf' AS file_name, CASE k % 3 WHEN 0 THEN 'Patient_Name_DOB' WHEN 1 THEN concat('User_Phone_', d4) ELSE 'Comments' END AS field_name FROM (@customers) c WHERE k % 2 = 0
  UNION ALL SELECT run_id, k, 'b_form.pdf', 'Street 2' FROM (@customers) c WHERE k % 4 = 0
  UNION ALL SELECT run_id, k, 'A_first.PDF', CASE WHEN k % 6 = 0 THEN 'Member_ID policy' ELSE 'name_and_address' END FROM (@customers) c WHERE k % 3 = 0
  UNION ALL SELECT run_id, k, 'A_first.PDF', 'other meds' FROM (@customers) c WHERE k % 12 = 0
  UNION ALL SELECT run_id, k, 'a_image.Pdf', 'dob' FROM (@customers) c
  UNION ALL SELECT run_id, k, 'c_last.pdf', 'dob phone' FROM (@customers) c WHERE k % 5 = 0
) f
"""

# Model answers per field that was asked: fenced, plain, broken and mixed ones.
RESPONSES = """
SELECT run_id, field, attempt, CASE (k + fno + attempt) % 6
  WHEN 0 THEN concat('```json', chr(10), '[{"raw_value":"613-555-', d4, '","evidence":[{"doc_id":"doc_000000000","page":"1","quoted_text":"call 613-555-', d4, '"}]}]', chr(10), '```', chr(10), 'done')
  WHEN 1 THEN concat('[{"raw_value":"January 5, ', yy, '","normalized_value":"","evidence":[{"doc_id":"doc_000000000","page":2.7,"quoted_text":"Born January 5, ', yy, '"},{"doc_id":"","page":1,"quoted_text":"x"}]},5,{"raw_value":""},{"raw_value":"x","evidence":[]}]')
  WHEN 2 THEN 'no json here'
  WHEN 3 THEN '{"raw_value":"x"}'
  WHEN 4 THEN concat('  [{"raw_value":"', nm, '","normalized_value":"', lower(nm), '","evidence":[{"doc_id":"doc_000000000","page":1,"quoted_text":"Patient: ', nm, '"},"y",{"doc_id":"d","page":"2.7","quoted_text":"q"},{"doc_id":"d","page":0,"quoted_text":"q"}]},{"raw_value":12345,"evidence":[{"doc_id":"doc_000000000","page":1,"quoted_text":"No 12345"}]}]  ')
  ELSE '[] extra' END AS text
FROM @asked q
"""

# One stored document of each artifact per customer, with faults put in by rule.
FAULTY = """
SELECT run_id, k, 'schema' AS artifact, concat('{"schema_source":"', CASE WHEN k % 3 = 0 THEN 'other' ELSE 'user_schema' END, '","resolved_fields":[{"key":"dob","type":"date"},{"key":"',
  CASE WHEN k % 5 = 0 THEN 'ssn' ELSE 'phone' END, '","label":null,"type":"phone"}],"unsupported_fields":["a",', CASE WHEN k % 7 = 0 THEN '1' ELSE '"b"' END, ']}') AS doc FROM (@customers) c
UNION ALL SELECT run_id, k, 'doc_index', concat('[{"doc_id":"d","filename":"f","mime_type":"m","pages":', CASE WHEN k % 3 = 0 THEN '2.5' ELSE '"2"' END, ',"has_text_layer":"', CASE WHEN k % 5 = 0 THEN 'maybe' ELSE 'yes' END,
  '","unreadable_reason":', CASE WHEN k % 7 = 0 THEN '"odd"' ELSE 'null' END, ',"sha256":"s"}]') FROM (@customers) c
UNION ALL SELECT run_id, k, 'layout', concat('[{"doc_id":"d","pages":[{"page":1,"full_text":"t"},{"page":', CASE WHEN k % 3 = 0 THEN '0' ELSE '2' END, ',"full_text":"t","spans":[{"text":"x","bbox":[1,',
  CASE WHEN k % 5 = 0 THEN '"n"' ELSE '"1.5"' END, ']}]}]},', CASE WHEN k % 7 = 0 THEN '5' ELSE '{"doc_id":"e","pages":[]}' END, ']') FROM (@customers) c
UNION ALL SELECT run_id, k, 'routing', concat('[{"field":"', CASE WHEN k % 3 = 0 THEN 'ssn' ELSE 'dob' END, '","doc_ids":["d"],"scores":{"d":', CASE WHEN k % 5 = 0 THEN 'null' ELSE '0.5' END, '}}]') FROM (@customers) c
UNION ALL SELECT run_id, k, 'candidates', concat('[{"field":"dob","raw_value":"v","normalized_value":"v","evidence":[{"doc_id":"', CASE WHEN k % 3 = 0 THEN ' ' ELSE 'd' END, '","page":"1","quoted_text":"q"}],"from_method":"llm","scores":{"anchor_match":1,"validator":',
  CASE WHEN k % 5 = 0 THEN '1.5' ELSE '1' END, CASE WHEN k % 7 = 0 THEN '' ELSE ',"doc_relevance":0' END, '}}]') FROM (@customers) c
UNION ALL SELECT run_id, k, 'final', concat('{"run_id":"r","schema_source":"fallback_v1","fields":{"dob":{"field":"dob","status":"', CASE WHEN k % 3 = 0 THEN 'done' ELSE 'filled' END, '","value":null,"confidence":', CASE WHEN k % 5 = 0 THEN '-0.5' ELSE '0.5' END,
  ',"rationale":[],"alternatives":[{"field":"dob","raw_value":"v","normalized_value":"v","evidence":[{"doc_id":"d","page":', CASE WHEN k % 7 = 0 THEN '0' ELSE '1' END, ',"quoted_text":"q"}],"from_method":"llm","scores":{"anchor_match":1,"validator":1,"doc_relevance":0}}]}}}') FROM (@customers) c
"""

# Every customer with the fields and attempts answers are rendered for: a short
# constant list per row, which each engine expands in its own words.
ASKED_DUCK = """(SELECT c.*, f.*, a.* FROM (@customers) c CROSS JOIN (VALUES ('full_name', 0), ('dob', 1), ('phone', 2), ('allergies', 3)) f(field, fno)
CROSS JOIN (VALUES (1), (2)) a(attempt))"""
ASKED_SPARK = """(SELECT * FROM (@customers) c
LATERAL VIEW posexplode(array('full_name', 'dob', 'phone', 'allergies')) f AS fno, field
LATERAL VIEW explode(array(1, 2)) a AS attempt)"""

OVERRIDES = """
SELECT run_id, CASE k % 4 WHEN 0 THEN 'dob' WHEN 1 THEN 'phone' WHEN 2 THEN 'full_name' ELSE 'address' END AS field,
  CASE k % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'override' ELSE 'missing' END AS action,
  CASE WHEN k % 3 = 1 THEN CASE k % 4 WHEN 0 THEN concat('2/3/', yy) WHEN 1 THEN concat('613 555 ', d4) ELSE concat('New, ', nm) END END AS value, 1 AS ord
FROM (@customers) c
UNION ALL SELECT run_id, 'dob', 'missing', CAST(NULL AS VARCHAR(20)), 2 FROM (@customers) c WHERE k % 12 = 0
UNION ALL SELECT run_id, 'phone', 'override', '1 613 555 0000', 0 FROM (@customers) c WHERE k % 8 = 1
"""

TARGETS = "SELECT run_id, k % 2 = 0 AS fillable FROM (@customers) c WHERE k % 3 <> 0"

TRUTH = """
SELECT run_id, 'dob' AS field, concat(yy, '-', mm, '-', dd) AS value FROM (@customers) c
UNION ALL SELECT run_id, 'phone', concat('(613) 555-', d4) FROM (@customers) c
UNION ALL SELECT run_id, 'full_name', nm FROM (@customers) c
"""


# Values in the shapes the normal forms are defined for, and some that are not.
DATE_TEXT = """
SELECT o_orderkey AS ok, CASE o_orderkey % 10
  WHEN 0 THEN concat(yy, '-', mm, '-', dd) WHEN 1 THEN concat(mm, '/', dd, '/', yy) WHEN 2 THEN concat('Jan ', dd, ', ', yy)
  WHEN 3 THEN concat(dd, ' October ', yy) WHEN 4 THEN concat('Sept ', dd, ' ', yy) WHEN 5 THEN concat('99/99/', yy, ' and more')
  WHEN 6 THEN concat('july', dd, ',', yy) WHEN 7 THEN concat('due ', yy, '-', mm, '-', dd) WHEN 8 THEN concat(yy, '/', mm, '-', dd, 'x')
  ELSE concat(dd, ' MAY ', yy) END AS t
FROM (SELECT o_orderkey, CAST(o_orderkey % 12 + 1 AS VARCHAR(20)) AS mm, CAST(o_orderkey % 31 + 1 AS VARCHAR(20)) AS dd,
             CAST(1900 + o_orderkey % 130 AS VARCHAR(20)) AS yy FROM orders) o
"""
PHONE_TEXT = """
SELECT o_orderkey AS ok, CASE o_orderkey % 5
  WHEN 0 THEN concat('(613) 555-', d) WHEN 1 THEN concat('+1 613.555.', d) WHEN 2 THEN concat('613555', d, ' ext 9')
  WHEN 3 THEN d ELSE concat('tel ', d, d, ' 12') END AS t
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 10000 AS VARCHAR(20)), 4, '0') AS d FROM orders) o
"""

TABLES = ("customer", "nation", "orders")
RENDERINGS = {
    name: sql.replace("@asked", ASKED_DUCK).replace("@customers", CUSTOMERS)
    for name, sql in {
        "form_docs": FORMS, "note_docs": NOTES, "upload_text": UPLOADS, "user_schema_text": USER_SCHEMAS,
        "form_fields": FORM_FIELDS, "responses": RESPONSES, "overrides": OVERRIDES, "targets": TARGETS,
        "truth": TRUTH, "faulty": FAULTY, "date_text": DATE_TEXT, "phone_text": PHONE_TEXT,
        "runs": "SELECT run_id, k FROM (@customers) c",
    }.items()
}


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A file with fewer splits than cores is spread over the cores.

    Tables of any size have more splits than the cluster has cores and are read
    as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def rendered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rendering over the parquet tables of ``sf_dir``."""
    for name_of_table in TABLES:
        table(spark, sf_dir, name_of_table).createOrReplaceTempView(name_of_table)
    if name == "responses":
        return spark.sql(RESPONSES.replace("@asked", ASKED_SPARK).replace("@customers", CUSTOMERS))
    return spark.sql(RENDERINGS[name])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, "runs").select("run_id")


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results of the form and the notes of every bundle."""
    form = rendered(spark, sf_dir, "form_docs").select(
        "run_id", "doc_id", F.array("p1", "p2").alias("pages"), F.lit(2).alias("page_count"),
        F.lit(None).cast("string").alias("error"))
    failed = F.col("error").isNotNull()
    notes = rendered(spark, sf_dir, "note_docs").select(
        "run_id", "doc_id", F.when(failed, F.array().cast("array<string>")).otherwise(F.array("body")).alias("pages"),
        F.when(failed, 0).otherwise(1).alias("page_count"), "error")
    return form.unionByName(notes)


def doc_stubs(docs: DataFrame) -> DataFrame:
    """Index rows of documents before extraction."""
    return docs.select(
        "run_id", "doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"),
        F.lit("application/pdf").alias("mime_type"), F.lit(None).cast("int").alias("pages"),
        F.lit(True).alias("has_text_layer"), F.lit(None).cast("string").alias("unreadable_reason"),
        F.sha2("doc_id", 256).alias("sha256"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, "upload_text").select(
        "run_id", "upload_ord", "filename", F.col("body").cast("binary").alias("content"))


def user_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema documents; every 21st one is not UTF-8."""
    return rendered(spark, sf_dir, "user_schema_text").filter("schema_text IS NOT NULL").select(
        "run_id", F.when(F.col("k") % 21 == 4, F.unhex(F.lit("FFFE"))).otherwise(
            F.col("schema_text").cast("binary")).alias("schema_json"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as bundles: a source is a bundle and a document has one page."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"),
        F.lit(0).alias("page_ord"), F.col("text").alias("full_text"))
