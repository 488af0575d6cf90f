"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six white-space characters between words, as literals and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of anything but the six white-space characters; a null text has none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN, -1)).otherwise(F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of every word, as the Python stages take them: no strings cross over."""
    return F.transform(words(text), lambda w: F.xxhash64(w))
