"""The optional model pass as tables of prompts and responses."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.fields import field_type
from attesta.functions import json as J
from attesta.functions.text import is_blank, let, strip
from attesta.functions.values import normalize_for_field, normalize_phone
from attesta.schemas import ANSWERS, EVIDENCE, SCORES
from attesta.settings import RunOptions, shared_folder, written
from attesta.sources.store import located, read_if_there, write_once

# The wording of prompts, so that equal input gives equal prompts.
TYPE_HINTS = {
    "date": "Return the date in YYYY-MM-DD format.",
    "phone": "Return the phone number with digits only (include country code if present).",
    "string": "Return the value as a string.",
    "string_or_list": "Return as a string. If multiple values, separate with commas.",
}
PROMPT = '''Extract the value for field "{key}" from the following document excerpts.

Field: {key}
Type: {type}
{label}

{hint}

IMPORTANT:
- You MUST include evidence showing where you found the value.
- The quoted_text must be an EXACT quote from the document.
- If you cannot find the field, return an empty array [].

Return ONLY valid JSON in this exact format:
[
  {{
    "raw_value": "the value as found in the document",
    "normalized_value": "the normalized/cleaned value",
    "evidence": [
      {{
        "doc_id": "document id where found",
        "page": page_number,
        "quoted_text": "exact quote from document containing the value"
      }}
    ]
  }}
]

Document excerpts:
{context}

Return ONLY the JSON array, no other text.'''
RETRY_PROMPT = '''Your previous response was not valid JSON. Error: {error}

Return ONLY a valid JSON array matching this schema for field "{key}":

[
  {{
    "raw_value": "string",
    "normalized_value": "string",
    "evidence": [
      {{
        "doc_id": "string",
        "page": number,
        "quoted_text": "string"
      }}
    ]
  }}
]

If no value found, return: []

Return ONLY the JSON array, nothing else.'''

# Error texts, which also go into retry prompts.
INVALID_JSON = "Invalid JSON"
NOT_AN_ARRAY = "Response must be a JSON array"
# Answers a task holds before it writes them: what a lost task has to ask again at most.
ANSWERS_HELD = 16
# Folder in a ledger for the files of batches that are not answered whole; once they are, one file takes their place.
PARTS = "parts"


def _fill(template: str, **values: Column) -> Column:
    """The template with its named places taken by columns."""
    marked = template.format(**{name: f"\x00{name}\x00" for name in values})
    return F.concat(*[values[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(marked.split("\x00"))])


def build_prompts(gate: DataFrame, excerpts: DataFrame) -> DataFrame:
    """One prompt per field to ask about; a field without excerpts gets none."""
    block = F.concat(F.lit("[Document: "), "doc_id", F.lit(", Page: "), F.col("page").cast("string"),
                     F.lit("]\n"), "text")
    context = excerpts.groupBy("run_id", "field").agg(F.array_join(F.sort_array(F.collect_list(
        F.struct("excerpt_ord", block.alias("block"))))["block"], "\n\n").alias("context"))
    kind = field_type(F.col("field"))
    hint = F.create_map(*[F.lit(x) for pair in TYPE_HINTS.items() for x in pair])[kind]
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit("Label: "), "label")).otherwise("")
    return gate.filter("call_model").select("run_id", "field", "label").join(context, ["run_id", "field"]).select(
        "run_id", "field",
        _fill(PROMPT, key=F.col("field"), type=kind, label=label, hint=hint, context=F.col("context")).alias("prompt"))


def retry_prompt(field: Column, error: Column) -> Column:
    return _fill(RETRY_PROMPT, key=field, error=error)


def _unfenced(text: Column) -> Column:
    """Stripped text; of a fenced block, the lines up to the closing fence."""
    def body(lines: Column) -> Column:
        close = F.array_position(F.transform(lines, strip), F.lit("```")).cast("int")
        return F.array_join(F.when(close > 0, F.slice(lines, F.lit(1), close - 1)).otherwise(lines), "\n")

    def inner(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        return F.when(F.startswith(t, F.lit("```")),
                      let(F.slice(lines, F.lit(2), F.size(lines)), body)).otherwise(t)

    return let(strip(text), inner)


def _evidence(entries: Column) -> Column:
    """Valid ones of the evidence entries of an item; incomplete or malformed ones are skipped. A page number of 1 or more is a given one."""
    def read(m: Column) -> Column:
        return F.struct(m["page"].alias("page"), J.told(m["doc_id"]).alias("doc_id"), J.told(m["quoted_text"]).alias("quoted_text"))

    def usable(m: Column) -> Column:
        return (J.told_given(m["doc_id"]) & J.told_given(m["quoted_text"])
                & ~let(J.told_text(m["doc_id"]), is_blank) & ~let(J.told_text(m["quoted_text"]), is_blank))

    objects = F.filter(J.objects(entries, doc_id="variant", page="int", quoted_text="variant"), lambda m: m["page"] >= 1)
    found = F.transform(F.filter(F.transform(objects, read), usable), lambda m: F.struct(
        J.told_text(m["doc_id"]).alias("doc_id"), m["page"].alias("page"), J.told_text(m["quoted_text"]).alias("quoted_text"),
        F.lit(None).cast("array<double>").alias("bbox")))
    return F.coalesce(found, F.array()).cast(f"array<{EVIDENCE}>")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``parse_error`` and the ``found`` items of each response text.

    A failed call (``call_error``, absent in stored answers) has that error and no items.
    """
    if "call_error" not in responses.columns:
        responses = responses.withColumn("call_error", F.lit(None).cast("string"))
    objects = J.objects(F.col("_doc"), raw_value="variant", normalized_value="variant", evidence="variant")
    doc = responses.withColumn("_doc", J.parse(_unfenced(F.col("text")))).withColumn("_objects", objects)
    error = F.when(F.col("call_error").isNotNull(), F.col("call_error")).when(F.col("_doc").isNull(), INVALID_JSON).when(F.col("_objects").isNull(), NOT_AN_ARRAY)
    members = lambda v: F.struct(J.told(v["raw_value"]).alias("raw"), J.told(v["normalized_value"]).alias("given"), v["evidence"].alias("evidence"))
    read = F.transform(
        F.filter(F.transform("_objects", members), lambda v: J.told_given(v["raw"])),
        lambda v, i: F.struct(
            i.alias("item"), J.told_text(v["raw"]).alias("raw_value"),
            F.when(J.told_given(v["given"]), J.told_text(v["given"])).alias("normalized_value"), _evidence(v["evidence"]).alias("evidence")))
    return (doc.withColumn("parse_error", error)
            .withColumn("found", F.filter(read, lambda s: F.size(s["evidence"]) > 0)).drop("_doc", "_objects"))


def response_candidates(parsed: DataFrame) -> DataFrame:
    """Model candidates, in the column layout of the heuristic ones."""
    rows = parsed.select("run_id", "field", F.explode("found").alias("f"))
    assumed = (field_type(F.col("field")) == "phone") & normalize_phone(F.col("f.raw_value"))["assumed"]
    none = F.array().cast("array<string>")
    zero = F.lit(0.0)
    return rows.select(
        "run_id", "field", F.col("f.raw_value").alias("raw_value"),
        F.coalesce("f.normalized_value", normalize_for_field(F.col("field"), F.col("f.raw_value")))
        .alias("normalized_value"),
        F.col("f.evidence").alias("evidence"), F.lit("llm").alias("from_method"),
        F.when(assumed, F.array(F.lit("default_country_assumed"))).otherwise(none).alias("validators"),
        none.alias("rejected_reasons"),
        F.struct(F.lit(1.0), zero, zero, zero, zero).cast(SCORES).alias("scores"),
        F.array("f.item").alias("seq"))


def settle_attempts(parsed: DataFrame) -> DataFrame:
    """The attempt that counts per field: the first valid one of the first two.

    ``status`` is ok, retried, invalid_json when both attempts fail, or unavailable
    when the last call itself failed.
    """
    rank = F.struct(F.col("parse_error").isNotNull().alias("bad"),
                    F.when(F.col("parse_error").isNull(), F.col("attempt")).otherwise(-F.col("attempt")).alias("a"))
    best = (parsed.filter(F.col("attempt") <= 2).groupBy("run_id", "field")
            .agg(F.min_by(F.struct("attempt", "parse_error", "found", "call_error"), rank).alias("s")))
    return best.select("run_id", "field", "s.attempt", "s.parse_error", "s.found",
                       F.when(F.col("s.call_error").isNotNull(), "unavailable")
                       .when(F.col("s.parse_error").isNotNull(), "invalid_json")
                       .when(F.col("s.attempt") > 1, "retried").otherwise("ok").alias("status"))


def model_errors(settled: DataFrame) -> DataFrame:
    """Fields without a usable answer, and why; other fields go on."""
    down = F.col("status") == "unavailable"
    said = F.when(down, "LLM unavailable for field ").otherwise("Invalid JSON from LLM for field ")
    return settled.filter("status IN ('invalid_json', 'unavailable')").select(
        "run_id", "field", F.concat(said, "field", F.lit(": "), "parse_error").alias("message"),
        F.when(down, "llm_unavailable").otherwise("llm_invalid_json").alias("kind"))


def replay(prompts: DataFrame, responses: DataFrame, attempt: int) -> DataFrame:
    """Stored answers in place of model calls, one per prompt and attempt."""
    stored = responses.filter(F.col("attempt") == attempt).select("run_id", "field", "attempt", "text")
    return prompts.select("run_id", "field").join(stored, ["run_id", "field"])


KEY = ["run_id", "field", "attempt", "prompt_hash"]


def read_answers(spark: SparkSession, ledger: str) -> DataFrame:
    """The answers of a ledger, one a key: a text before a failed call, then the first one written."""
    # A job that runs at the same time may just have put the parts of a batch together.
    rows = read_if_there(spark, ledger, ANSWERS, recursiveFileLookup="true", ignoreMissingFiles="true")
    order = F.struct(F.col("call_error").isNotNull().alias("failed"), "at")
    return rows.groupBy(*KEY).agg(F.min_by(F.struct("text", "call_error"), order).alias("a")).select(*KEY, "a.text", "a.call_error")


def call_model(requests: DataFrame, model: Callable[[list[dict], int], str], attempt: int,
               options: RunOptions = RunOptions(), ledger: str | None = None) -> DataFrame:
    """Run a caller's ``(messages, max_tokens) -> text`` function over request rows.

    ``requests`` has (run_id, field, messages) with messages an array of
    struct(role, content). A call that raises leaves its row with ``call_error`` and no
    text; the others go on.

    Answers are appended to the table in ``ledger``, by bundle, field, attempt and hash of the
    messages. Only requests without an answer there are asked, so a job that is run again with
    its ledger pays for what it did not get; a failed call counts as not answered then. Tasks
    write as they go, ``ANSWERS_HELD`` answers a file, named by the keys in it: a task that runs
    again finds the files of its earlier run, and of two that run at once the first file stays.
    A batch that is answered whole becomes one file, and then its parts go: a ledger read again
    and again has a file for thousands of answers.
    """
    spark = requests.sparkSession
    ledger = ledger or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    limit = options.max_model_tokens
    keyed = requests.select("run_id", "field", F.lit(attempt).alias("attempt"), F.sha2(F.to_json("messages"), 256).alias("prompt_hash"), "messages")
    had = read_answers(spark, ledger).filter((F.col("attempt") == attempt) & F.col("call_error").isNull()).select(*KEY, F.lit(True).alias("had"))
    # Written with all keys, so that requests are hashed once; messages stand only with those to be asked.
    marked = written(keyed.join(had, KEY, "left").select(*KEY, F.col("had").isNull().alias("todo"), F.when(F.col("had").isNull(), F.col("messages")).alias("messages")), "requests")
    todo = marked.filter("todo").select(*KEY, "messages")

    def one(messages) -> tuple[str | None, str | None]:
        try:
            return model([{"role": m["role"], "content": m["content"]} for m in messages], limit), None
        except Exception as problem:  # whatever a caller's function raises
            return None, f"{type(problem).__name__}: {problem}"

    # The requests of a job have a name of their own, so that a failed call of an earlier job is asked again.
    job = uuid.uuid4().hex

    def answer(batches):
        for batch in batches:
            keys = batch.select(KEY)
            name = hashlib.sha256(repr((job, keys.to_pydict())).encode()).hexdigest()
            system, target = located(f"{ledger}/{name}.parquet")
            there = lambda: system.get_file_info(target).type != fs.FileType.NotFound
            # The parts of a batch have a folder of their own: tasks that write into one folder wait for each other.
            _, folder = located(f"{ledger}/{PARTS}/{name}")
            tables = []
            for at in range(0, len(batch), ANSWERS_HELD):
                if there():  # this task, or another run of it, has answered the batch
                    break
                try:
                    tables.append(answered(system, f"{folder}/{at:09d}.parquet", keys.slice(at, ANSWERS_HELD), batch.column("messages").slice(at, ANSWERS_HELD)))
                except FileNotFoundError:  # the other run has just put the batch together
                    if not there():
                        raise
            if not there():
                write_once(system, target, lambda stream: pq.write_table(pa.concat_tables(tables), stream))
                dropped(system, folder)
            yield pa.RecordBatch.from_pydict({"file": [f"{ledger}/{name}.parquet"], "answers": pa.array([len(batch)], pa.int64())})

    def answered(system, place, keys, messages):
        """The answers of a part as they stand in the ledger: written now, or by an earlier run of the task."""
        made = []

        def fill(stream):
            texts, errors = zip(*map(one, messages.to_pylist()))
            made.append(pa.table([*keys.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array([time.time()] * len(keys))],
                                 names=[*KEY, "text", "call_error", "at"]))
            # Put together in memory: a part is far smaller than the calls that many small writes of it would cost.
            held = pa.BufferOutputStream()
            pq.write_table(made[0], held, use_dictionary=False, write_statistics=False)
            stream.write(held.getvalue())

        if write_once(system, place, fill):
            return made[0]
        with system.open_input_file(place) as stream:
            return pq.read_table(stream)

    def dropped(system, folder):
        try:
            system.delete_dir(folder)
        except FileNotFoundError:  # the other run was faster
            pass

    written(todo.mapInArrow(answer, "file string, answers long"), "answered")
    return marked.select(*KEY).join(read_answers(spark, ledger).filter(F.col("attempt") == attempt), KEY).select("run_id", "field", "attempt", "text", "call_error")


def ask(prompts: DataFrame, model: Callable[[list[dict], int], str], options: RunOptions = RunOptions(),
        ledger: str | None = None) -> DataFrame:
    """Ask once, ask again where the answer was invalid, and settle; answers are read back from the ledger."""
    ledger = ledger or f"{shared_folder(prompts.sparkSession)}/answers-{uuid.uuid4().hex}"
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    first = call_model(prompts.withColumn("messages", F.array(message("user", F.col("prompt")))), model, 1, options, ledger)
    parsed = parse_responses(first)
    failed = prompts.join(parsed.filter("parse_error IS NOT NULL AND call_error IS NULL"), ["run_id", "field"]).withColumn(
        "messages", F.array(message("user", F.col("prompt")), message("assistant", F.col("text")),
                            message("user", retry_prompt(F.col("field"), F.col("parse_error")))))
    second = call_model(failed, model, 2, options, ledger)
    return settle_attempts(parsed.unionByName(parse_responses(second)))
