"""License scan over a positional rare-token index [native].

Templates are short licence phrases of words; the index maps a word to its templates
and positions. How many documents hold each licence word gives its IDF. In a file, the
rarest word of each template is looked up; an occurrence places the template at a start
(occurrence less template position), the other words are intersected at their relative
positions, and the template counts if its mandatory key phrase is whole. The three base
phrases are templates whose key phrase is the phrase, so every place is found.

score is the greatest IDF-weighted share of a template's words found in place.
Defined cases: null text is empty (0 words, no labels, score 0); repeated rows are
scanned each; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table
from attesta.settings import written

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# template words, (first, words) of its key phrase, label
TEMPLATES = [(p, 0, len(p.split()), label) for p, label in BASE.items()] + [
    ("licensed under the apache license version 2 0", 3, 2, "apache-2.0"), ("released under the mit license", 3, 2, "mit"),
    ("licensed under the gnu general public license version 2", 4, 5, "gpl-2"), ("licensed under the gnu general public license version 3", 4, 5, "gpl-3"),
    ("licensed under the gnu lesser general public license", 3, 5, "lgpl"), ("licensed under the gnu affero general public license", 3, 5, "agpl"),
    ("licensed under cc by nc 4 0", 2, 3, "cc-by-nc"), ("licensed under cc by sa 4 0", 2, 3, "cc-by-sa"), ("licensed under cc by nd 4 0", 2, 3, "cc-by-nd"),
    ("licensed under the creative commons attribution license", 3, 3, "cc-by"), ("licensed under the bsd license", 3, 2, "bsd"),
    ("licensed under the mozilla public license version 2 0", 3, 3, "mpl"), ("this is free and unencumbered software released into the public domain", 3, 3, "unlicense"),
    ("permission is hereby granted free of charge to any person obtaining a copy", 0, 7, "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", 0, 8, "bsd"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = max(len(t[0].split()) for t in TEMPLATES)
VOCABULARY = sorted({w for t in TEMPLATES for w in t[0].split()})


def tokens(docs: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), NOT_WORD, " "))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.length(text) > 0, F.split(text, " ", -1)).otherwise(
        F.array().cast("array<string>")).alias("words"))


def word_idf(docs: DataFrame) -> dict[str, float]:
    """IDF of every licence word over all documents: at most as many rows as the templates have words."""
    import math

    held = tokens(docs).select(F.explode(F.array_intersect(F.array(*map(F.lit, VOCABULARY)), "words")).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    top = max([*found.values(), 1])
    return {w: math.log((1 + top) / (1 + found.get(w, 0))) + 1 for w in VOCABULARY}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = word_idf(docs)
    rows = []
    for t, (phrase, first, count, label) in enumerate(TEMPLATES):
        ws = phrase.split()
        # Looked up by the rarest word of the key phrase, which any match must hold.
        at = max(range(first, first + count), key=lambda i: (idf[ws[i]], -i))
        rows.append((ws[at], t, at, ws, [idf[w] for w in ws], first, count, label, phrase in BASE))
    anchors = sorted({r[0] for r in rows})
    index = F.create_map(*[x for a in anchors for x in (F.lit(a), F.array(*[F.struct(
        F.lit(r[2]).alias("at"), F.array(*map(F.lit, r[3])).alias("ws"), F.array(*map(F.lit, r[4])).alias("idf"), F.lit(r[5]).alias("first"),
        F.lit(r[6]).alias("count"), F.lit(r[7]).alias("label"), F.lit(r[8]).alias("base")) for r in rows if r[0] == a]))])
    d = tokens(docs)
    pad = F.array_repeat(F.lit(""), LONGEST)
    where = F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    d = d.withColumn("at", where)
    d = d.withColumn("near", F.when(F.size("at") > 0, F.concat(pad, "words", pad)))
    d = d.withColumn("hits", F.coalesce(F.transform("at", lambda i: F.struct(i.alias("i"), F.slice("near", i + 1, 2 * LONGEST + 1).alias("win"))), F.array()))
    seen = written(d.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "hits"), "license-hits")
    hit = seen.select("row", F.explode("hits").alias("hit")).select("row", "hit.i", "hit.win")
    hit = hit.select("row", "i", "win", F.explode(F.element_at(index, F.element_at("win", LONGEST + 1))).alias("t"))
    # The template's start in the window is LONGEST - at.
    part = F.slice("win", F.lit(LONGEST + 1) - F.col("t.at"), F.size("t.ws"))
    hit = hit.withColumn("eq", F.zip_with(part, "t.ws", lambda a, b: a == b)).withColumn(
        "key", F.forall(F.slice("eq", F.col("t.first") + 1, F.col("t.count")), lambda x: x)).where("key")
    share = F.aggregate(F.zip_with("eq", "t.idf", lambda e, x: F.when(e, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.aggregate("t.idf", F.lit(0.0), lambda a, x: a + x)
    start = F.col("i") - F.col("t.at")
    base = F.col("t.base")
    found = hit.withColumn("share", share).groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, start)).cast("long").alias("first_word"), F.max(F.when(base, start)).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("t.label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("t.label")), ",").alias("labels"), F.max("share").alias("score")).withColumnRenamed("row", "of")
    out = seen.select("row", "doc_id", "n_words").join(found, F.col("row") == F.col("of"), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))).alias("score"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
