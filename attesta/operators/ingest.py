"""Uploaded files to document index and page text."""

from __future__ import annotations

import mimetypes
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import is_blank, let, lookup, rstrip, strip
from attesta.operators.numbering import with_position
from attesta.schemas import PAGE, PAGE_TEXTS
from attesta.settings import written
from attesta.sources.store import keep_contents, open_files

PDF = "application/pdf"
PDF_MAGIC = "%PDF"
# Extension tables of the standard library, without system files.
_MIME = mimetypes.MimeTypes()


def safe_filename(name: Column) -> Column:
    """Last path segment without surrounding whitespace; NULL if none is left."""
    last = strip(F.substring_index(F.translate(name, "\\", "/"), "/", -1))
    return F.when(~last.isin("", ".", ".."), F.replace(last, F.lit(".."), F.lit("_")))


def _extension(name: Column) -> Column:
    """The last dot and what follows, if anything but dots comes before it."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1)


def mime_type(name: Column, is_pdf: Column) -> Column:
    """Type by extension, else by the PDF signature, else generic bytes."""
    def stem(n: Column) -> Column:
        return F.substring(n, F.lit(1), F.length(n) - F.length(_extension(n)))

    longer = lookup(_MIME.suffix_map)
    spelled = F.coalesce(F.concat(stem(name), longer[F.lower(_extension(name))]), name)
    plain = let(spelled, lambda n: F.when(_extension(n).isin(sorted(_MIME.encodings_map)), stem(n)).otherwise(n))
    by_name = let(F.lower(let(plain, _extension)), lambda e: lookup(_MIME.types_map[True])[e])
    return F.coalesce(by_name, F.when(is_pdf, PDF), F.lit("application/octet-stream"))


def is_pdf(content: Column) -> Column:
    return F.startswith(content, F.lit(PDF_MAGIC.encode()))


def describe(uploads: DataFrame, root: str | None = None) -> DataFrame:
    """Uploads without their bytes: name, hash and signature of each, known from its own row.

    Uploads that name a ``path`` are opened for it here, in the task that holds the row. With
    ``root``, contents are kept below it (see ``keep_contents``), and ``path`` leads there. Write
    the result before using it twice, or the files are read twice.
    """
    opened = uploads if "content" in uploads.columns else open_files(uploads)
    rows = opened.withColumn("sha256", F.sha2("content", 256)).withColumn("is_pdf", is_pdf(F.col("content")))
    return keep_contents(rows, root) if root else rows.drop("content")


def _described(uploads: DataFrame) -> DataFrame:
    return (uploads if "sha256" in uploads.columns else describe(uploads)).withColumn("safe_name", safe_filename(F.col("filename")))


def rejected_uploads(uploads: DataFrame) -> DataFrame:
    return uploads.filter(safe_filename(F.col("filename")).isNull()).select(
        "run_id", "upload_ord", "filename", F.lit("invalid_filename").alias("reason"))


def stored_files(uploads: DataFrame) -> DataFrame:
    """The first upload under each (bundle, safe name); later ones do not replace it.

    Only hashes and flags are shuffled, never file bytes.
    """
    rows = _described(uploads)
    path = ["path"] if "path" in rows.columns else []
    first = F.min(F.struct("upload_ord", "sha256", "is_pdf", *path)).alias("s")
    return (rows.filter(F.col("safe_name").isNotNull()).groupBy("run_id", "safe_name").agg(first)
            .select("run_id", "safe_name", F.col("s.upload_ord").alias("stored_ord"), "s.sha256", "s.is_pdf", *[f"s.{c}" for c in path]))


def new_files(uploads: DataFrame, already: DataFrame) -> DataFrame:
    """Stored files of this batch that no earlier batch holds, ready to append."""
    return stored_files(uploads).join(already.select("run_id", "safe_name"), ["run_id", "safe_name"], "left_anti")


def ingest(uploads: DataFrame) -> DataFrame:
    """One index row per upload, numbered in upload order inside its bundle.

    A repeated file name gets its own document id but describes the file stored
    first under that name. ``stored_ord`` names that upload and ``is_pdf`` tells
    its signature.
    """
    numbered = with_position(
        uploads.select("run_id", "upload_ord", safe_filename(F.col("filename")).alias("safe_name")),
        "run_id", "upload_ord", "position")
    joined = numbered.join(stored_files(uploads), ["run_id", "safe_name"])
    return joined.select(
        "run_id", F.concat(F.lit("doc_"), F.lpad(F.col("position").cast("string"), F.greatest(
            F.length(F.col("position").cast("string")), F.lit(3)), F.lit("0"))).alias("doc_id"),
        F.col("safe_name").alias("filename"), mime_type(F.col("safe_name"), F.col("is_pdf")).alias("mime_type"),
        F.lit(None).cast("int").alias("pages"), F.lit(True).alias("has_text_layer"),
        F.lit(None).cast("string").alias("unreadable_reason"), "sha256", "stored_ord", "is_pdf")


def extract_pages(files: DataFrame, read_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """Run a caller's ``bytes -> page texts`` function over (sha256, content) rows.

    A failure becomes the row's error, so one damaged file never fails the job.
    """
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sha256, content in zip(batch["sha256"], batch["content"]):
                try:
                    pages = [page or "" for page in read_pages(bytes(content))]
                    rows.append((sha256, pages, len(pages), None))
                except Exception as problem:  # noqa: BLE001 - any parser failure is data here
                    rows.append((sha256, [], 0, f"parse_error: {problem}"))
            yield pd.DataFrame(rows, columns=["sha256", "pages", "page_count", "error"])

    return files.select("sha256", "content").mapInPandas(extract, PAGE_TEXTS)


def page_texts(stored: DataFrame, read_pages: Callable[[bytes], list[str]], known: DataFrame | None = None) -> DataFrame:
    """Page texts of stored files by content hash, each content parsed once.

    ``stored`` names a ``path`` for each file. Hashes that ``known`` (an earlier page text table)
    holds are left out before anything is opened, and so are repeated contents, files that
    another of the same name kept out, and files that are no PDF: only paths are grouped and joined.
    They are opened in the order of their paths, as contents that share a file lie in it.
    """
    wanted = stored.filter(F.col("is_pdf") & (mime_type(F.col("safe_name"), F.col("is_pdf")) == PDF))
    once = wanted.groupBy("sha256").agg(F.min("path").alias("path"))
    if known is not None:
        once = once.join(known.select("sha256"), "sha256", "left_anti")
    return extract_pages(open_files(once.orderBy("path")), read_pages)


def extractions_by_content(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Extraction results by document id, each document reading the text of its stored content."""
    readable = index.filter(F.col("is_pdf") & (F.col("mime_type") == PDF))
    return readable.select("run_id", "doc_id", "sha256").join(texts, "sha256").select(
        "run_id", "doc_id", "pages", "page_count", "error")


def update_doc_index(index: DataFrame, extractions: DataFrame) -> DataFrame:
    """Readability of every document; one without an extraction has no text layer."""
    outcome = extractions.select(
        "run_id", "doc_id", "page_count", F.lit(True).alias("tried"),
        F.coalesce(F.col("error") != "", F.lit(False)).alias("failed"),
        F.exists("pages", lambda p: ~is_blank(p)).alias("has_text"))
    good = F.coalesce(F.col("tried") & ~F.col("failed") & F.col("has_text"), F.lit(False))
    return index.drop("pages", "has_text_layer", "unreadable_reason").join(
        outcome, ["run_id", "doc_id"], "left").select(
        "run_id", "doc_id", "filename", "mime_type",
        F.when(~F.col("failed"), F.col("page_count")).alias("pages"), good.alias("has_text_layer"),
        F.when(F.col("failed"), "parse_error").when(~good, "no_text_layer").alias("unreadable_reason"),
        "sha256")


def page_table(extractions: DataFrame) -> DataFrame:
    """One row per page, numbered from 1, trailing whitespace removed."""
    return extractions.select("run_id", "doc_id", F.posexplode("pages").alias("page_ord", "t")).select(
        "run_id", "doc_id", (F.col("page_ord") + 1).alias("page"), "page_ord", rstrip(F.col("t")).alias("full_text"))


def layout(extractions: DataFrame) -> DataFrame:
    """One nested row per document, built inside the row the pages came in."""
    pages = F.transform("pages", lambda t, i: F.struct(
        (i + 1).alias("page"), rstrip(t).alias("full_text"),
        F.array().cast("array<struct<text:string,bbox:array<double>>>").alias("spans")))
    return extractions.select("run_id", "doc_id", pages.cast(f"array<{PAGE}>").alias("pages"))


def stored_listing(uploads: DataFrame) -> DataFrame:
    """Stored files by name inside each bundle, with their place in that order.

    Names of a bundle are ranked behind one sort of all names, so a hot bundle is ranked by many tasks.
    """
    ordered = stored_files(uploads).orderBy("run_id", "safe_name").withColumn("_row", F.monotonically_increasing_id())
    return with_position(written(ordered, "listing"), "run_id", "_row", "place").drop("_row")
