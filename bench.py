"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the tables and BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from attesta.settings import session
from checks.queries import QUERIES

HEADLINES = [
    "tokenize_docs", "normalize_text", "score_docs", "route_topk", "route_documents", "full_name_candidates",
    "dob_candidates", "phone_candidates", "phone_in_documents", "evidence_check", "model_gate", "field_stats",
    "excerpts", "prompts", "parse_responses", "schema_resolved", "ingest_index", "doc_index", "confidence",
    "final_fields", "eval_metrics",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    spent = {}
    for name in names or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main(sys.argv[1:])
