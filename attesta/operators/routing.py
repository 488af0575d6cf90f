"""Token-overlap routing of every field to its best documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.fields import QUERY_TOKENS, literal_words, per_field
from attesta.functions.text import tokenize
from attesta.settings import RunOptions

DOC = ["run_id", "doc_id"]
# Pages joined per step of gluing a document; see doc_text.
PAGE_SPAN = 1024


def query_tokens(key: Column, label: Column) -> Column:
    """Tokens of the field key, its aliases and the label if there is one."""
    fixed = per_field(key, lambda k: literal_words(QUERY_TOKENS[k]))
    return F.array_union(fixed, tokenize(F.coalesce(label, F.lit(""))))


def is_readable() -> Column:
    return F.col("has_text_layer") & F.col("unreadable_reason").isNull()


def doc_text(pages: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` characters of every document, pages in order, no separator.

    Pages are joined span by span, each result cut to ``limit``, so a grouping gets a
    bounded number of bounded rows even for a document with a third of all pages.
    """
    glued = F.array_join(F.sort_array(F.collect_list(F.struct("page", "page_ord", "text")))["text"], "")
    parts = (pages.select(*DOC, "page", "page_ord", F.substring("full_text", 1, limit).alias("text"))
             .filter(F.col("text") != ""))
    for span in (PAGE_SPAN, PAGE_SPAN**2, None):
        parts = parts.groupBy(*DOC, _span(span)).agg(
            F.min("page").alias("page"), F.min("page_ord").alias("page_ord"), F.substring(glued, 1, limit).alias("text"))
    return parts.select(*DOC, "text")


def _steps(pages: DataFrame) -> list[int | None]:
    """Spans of pages to glue by: those that some page number goes beyond, then the rest of a document."""
    last = pages.agg(F.max(F.abs("page"))).first()[0] or 0
    return [*(span for span in (PAGE_SPAN, PAGE_SPAN**2) if last > span), None]


def _span(pages: int | None) -> Column:
    return (F.floor((F.col("page") - 1) / pages) if pages else F.lit(0)).alias("span")


# Every word a fixed query has, each with a bit of its own in a page's bitmap.
VOCABULARY = sorted({token for tokens in QUERY_TOKENS.values() for token in tokens})
_KNOWN = rf"(?<![a-z0-9])(?:{'|'.join(VOCABULARY)})(?![a-z0-9])"


def bitmap(words: Column) -> Column:
    """The words of the vocabulary among ``words``, as bits; others have none."""
    powers = F.create_map(*[F.lit(x) for i, w in enumerate(VOCABULARY) for x in (w, 1 << i)])
    bit = lambda w: F.coalesce(powers[w].cast("bigint"), F.lit(0).cast("bigint"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda bits, w: bits.bitwiseOR(bit(w)))


def _bits(text: Column) -> Column:
    return bitmap(F.regexp_extract_all(text, F.lit(_KNOWN), F.lit(0)))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]{2,}"), F.lit(0)))


def _cut(text: Column) -> tuple[Column, Column]:
    """The part of a text whose words surely end in it, and its edges: what may go on in a neighbour."""
    head = F.regexp_extract(text, "^[a-z0-9]+", 0)
    tail = F.reverse(F.regexp_extract(F.reverse(text), "^[a-z0-9]+", 0))
    unbroken = F.length(head) == F.length(text)
    inside = F.substring(text, F.length(head) + 1, F.length(text) - F.length(head) - F.length(tail))
    return F.when(unbroken, "").otherwise(inside), F.when(unbroken, text).otherwise(F.concat(head, F.lit(" "), tail))


_GLUED = ["page", "page_ord", "edge"]


def _glue() -> list[Column]:
    """What a span of pages keeps of their edges, in order."""
    glued = F.array_join(F.sort_array(F.collect_list(F.struct(*_GLUED)))["edge"], "")
    return [F.min("page").alias("page"), F.min("page_ord").alias("page_ord"), glued.alias("text")]


def _vocabulary_in(texts: DataFrame, steps: list[int | None]) -> DataFrame:
    """Documents with a bitmap of the vocabulary words anywhere in their whole text.

    Pages join without a separator, so a word may run over from page to page. A page gives
    one number and its edges; numbers are merged by bitwise or, in each task first, and edges
    are put together span by span, which bounds each group.
    """
    inner, edge = _cut(F.col("text"))
    parts = texts.withColumn("bits", F.lit(0).cast("bigint"))
    for span in steps:
        parts = (parts.select(*DOC, "page", "page_ord", F.col("bits").bitwiseOR(_bits(inner)).alias("bits"), edge.alias("edge"))
                 .groupBy(*DOC, _span(span)).agg(*_glue(), F.bit_or("bits").alias("bits")))
    return parts.select(*DOC, F.col("bits").bitwiseOR(_bits(F.col("text"))).alias("bits"))


def _others_in(texts: DataFrame, asked: DataFrame, steps: list[int | None]) -> DataFrame:
    """Documents with the further words their bundle asks for, found anywhere in their whole text.

    ``asked`` is (run_id, others). Such words come from labels only. Words of a page are cut down to
    those of its bundle as soon as both meet, so later groups gather no others.
    """
    inner, edge = _cut(F.col("text"))
    parts = (texts.select(*DOC, "page", "page_ord", _words(inner).alias("words"), edge.alias("edge")).join(asked, "run_id")
             .withColumn("words", F.array_intersect("others", "words")))
    for i, span in enumerate(steps):
        if i:
            parts = parts.select(*DOC, "others", "page", "page_ord", F.array_intersect("others", F.concat("words", _words(inner))).alias("words"), edge.alias("edge"))
        parts = parts.groupBy(*DOC, _span(span)).agg(*_glue(), F.first("others").alias("others"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    return parts.select(*DOC, F.array_intersect("others", F.concat("words", _words(F.col("text")))).alias("words"))


def score_docs(schema_fields: DataFrame, doc_index: DataFrame, pages: DataFrame,
               options: RunOptions = RunOptions()) -> DataFrame:
    """Score of every (field, readable document) pair inside a bundle.

    The fields of a bundle travel as one short array and meet the document index.
    Whole texts are scored unless ``routing_chars`` asks for a prefix.
    """
    tokens = query_tokens(F.col("key"), F.col("label"))
    others = lambda t: F.array_except(t, literal_words(VOCABULARY))
    queries = schema_fields.select("run_id", "key", tokens.alias("tokens")).groupBy("run_id").agg(F.collect_list(F.struct(
        "key", F.size("tokens").alias("size"), bitmap(F.col("tokens")).alias("bits"), others(F.col("tokens")).alias("others"))).alias("queries"))
    asked = F.array_distinct(F.flatten(F.col("queries")["others"]))
    wanted = doc_index.filter(is_readable()).select(*DOC).join(queries, "run_id")
    if options.routing_chars is None:
        texts = pages.select(*DOC, "page", "page_ord", F.lower(F.coalesce("full_text", F.lit(""))).alias("text"))
    else:
        texts = doc_text(pages, options.routing_chars).select(*DOC, F.lit(1).alias("page"), F.lit(0).alias("page_ord"), F.lower("text").alias("text"))
    steps = _steps(texts)
    found = wanted.join(_vocabulary_in(texts, steps), DOC, "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("bigint")))
    # Only labels bring words beyond the vocabulary; without one, no page word is asked for or moved.
    said = F.lit(0)
    if not schema_fields.filter("label <> ''").isEmpty():
        said = F.size(F.array_intersect("others", "words"))
        labelled = queries.select("run_id", asked.alias("others")).filter(F.size("others") > 0)
        found = found.join(_others_in(texts, labelled, steps), DOC, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))

    # One row a field first: what Spark compiles for rows costs far less than a lambda over the queries.
    asks = found.withColumnRenamed("bits", "has").select("*", F.inline("queries"))
    hits = F.bit_count(F.col("bits").bitwiseAND(F.col("has"))) + said
    return asks.select(*DOC, F.col("key").alias("field"), F.when(F.col("size") == 0, F.lit(0.0)).otherwise(hits / F.col("size")).alias("score"))


def route(schema_fields: DataFrame, doc_index: DataFrame, pages: DataFrame,
          options: RunOptions = RunOptions()) -> DataFrame:
    """The best ``top_k_docs`` readable documents of every field.

    The rank limit is applied before the shuffle as well as after it, so a
    bundle with very many documents sends only a few rows per task.
    """
    best = Window.partitionBy("run_id", "field").orderBy(F.desc("score"), "doc_id")
    return (score_docs(schema_fields, doc_index, pages, options)
            .withColumn("doc_rank", F.row_number().over(best))
            .filter(F.col("doc_rank") <= options.top_k_docs)
            .select("run_id", "field", "doc_rank", "doc_id", "score"))


def nest_routing(schema_fields: DataFrame, routing: DataFrame) -> DataFrame:
    """One row per field: document ids best first and a score map, both maybe empty."""
    entry = F.sort_array(F.collect_list(F.struct("doc_rank", "doc_id", "score")))
    nested = routing.groupBy("run_id", "field").agg(entry.alias("e")).select(
        "run_id", "field", F.col("e")["doc_id"].alias("doc_ids"),
        F.map_from_arrays(F.col("e")["doc_id"], F.col("e")["score"]).alias("scores"))
    return (schema_fields.select("run_id", F.col("key").alias("field"))
            .join(nested, ["run_id", "field"], "left")
            .select("run_id", "field",
                    F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"),
                    F.coalesce("scores", F.create_map().cast("map<string,double>")).alias("scores")))


def readable_status(runs: DataFrame, doc_index: DataFrame) -> DataFrame:
    """Readable documents per bundle; a bundle without any gets status ``warn``."""
    counts = doc_index.groupBy("run_id").agg(F.count_if(is_readable()).alias("readable"))
    readable = F.coalesce("readable", F.lit(0).cast("long"))
    return (runs.select("run_id").join(counts, "run_id", "left")
            .select("run_id", readable.alias("readable_docs"),
                    F.when(readable == 0, "warn").otherwise("ok").alias("status")))
