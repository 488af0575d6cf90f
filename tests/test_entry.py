import importlib

import pytest

from checks.compare import connect, rows_of

SF = "/root/testdata/sf0.001"
entry_module = importlib.import_module("__spark_entry__")
FAST = ["tokenize_docs", "route_topk", "phone_in_documents", "schema_resolved", "schema_warnings", "ingest_index", "evidence_check", "final_fields"]


def test_every_query_has_its_sql():
    own = {name for name, query in entry_module.queries().items() if query.__module__ == "checks.queries"}
    assert own <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    mine = entry_module.queries()[name](spark, SF).toPandas()
    theirs = connect(SF).sql(entry_module.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows_of(mine) == rows_of(theirs)


def test_skewed_bundle_is_split(spark):
    """A join partition that one document fills is split although an aggregate follows."""
    from attesta.operators import extract as E
    from attesta.schemas import PAGES, ROUTING_ROWS
    from pyspark.sql import functions as F

    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for key, value in zip(keys, ["-1", "20KB", "20KB", "2"]):
            spark.conf.set(key, value)
        hot = spark.range(0, 4000, 1, 8).select(F.lit("r").alias("run_id"), F.lit("hot").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page"),
                                                F.col("id").cast("int").alias("page_ord"), F.concat(F.lit("Name: Person "), F.sha2(F.col("id").cast("string"), 256)).alias("full_text"))
        cold = spark.range(400).select(F.lit("r").alias("run_id"), F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("page_ord"), F.lit("Name: A B").alias("full_text"))
        pages = hot.unionByName(cold)
        routing = pages.select("run_id", F.lit("full_name").alias("field"), F.lit(1).alias("doc_rank"), "doc_id", F.lit(1.0).alias("score")).distinct()
        whole = lambda text, lowered: F.array(F.struct(
            F.lit(0).alias("seq1"), F.lit(0).alias("seq2"), text.alias("raw"), text.alias("norm"), text.alias("quote"),
            F.lit(1.0).alias("anchor"), F.array().cast("array<string>").alias("flags")))
        out = E.heuristic_candidates(routing, pages, {"full_name": whole})
        assert len(out.collect()) == 4400
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
