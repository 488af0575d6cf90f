"""Run options, session settings and the folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. They are runtime SQL settings, so they can be
# applied to a session somebody else built.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A bundle or document may hold a third of all rows. Splitting its join
    # partition is worth the extra exchange the following aggregate then needs.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # The work per row is heavy, so small shuffles still go to all cores. Large
    # ones are cut by the advisory size, which this does not touch.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # With coalesced partitions, a union claiming its inputs' partitioning can
    # meet a join with another number of partitions and fail the job.
    "spark.sql.unionOutputPartitioning": "false",
    # A repeated JSON key keeps its last value instead of voiding the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings a session can only be built with. Recording the Python call site of
# every expression costs more than building the expressions does.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


@dataclass(frozen=True)
class RunOptions:
    """Options of one extraction job; they never become columns."""

    top_k_docs: int = 3
    max_fields: int = 7
    max_model_tokens: int = 1200
    autofill_threshold: float = 0.75
    routing_chars: int | None = None  # whole texts; a number scores that many characters only
    excerpt_total_chars: int = 8000
    excerpt_doc_chars: int = 4000
    excerpt_doc_pages: int = 3


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "attesta", **settings: str) -> SparkSession:
    """Get or build a session with the runtime settings."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**STATIC_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a recomputation would be wrong (a paid model call must not be
    repeated) or costly (a table several later stages read). Unlike a cache,
    the written table survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
