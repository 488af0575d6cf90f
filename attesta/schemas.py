"""Spark types of every table and the registry of stored artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

EVIDENCE = "struct<doc_id:string,page:int,quoted_text:string,bbox:array<double>>"
SCORES = ("struct<anchor_match:double,validator:double,doc_relevance:double,"
          "cross_doc_agreement:double,contradiction_penalty:double>")
FIELD_SPEC = "struct<key:string,label:string,type:string>"
PAGE = "struct<page:int,full_text:string,spans:array<struct<text:string,bbox:array<double>>>>"


def _struct(columns: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in columns.items()) + ">"


def _table(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


_CANDIDATE = {
    "field": "string", "raw_value": "string", "normalized_value": "string", "evidence": f"array<{EVIDENCE}>",
    "from_method": "string", "validators": "array<string>", "rejected_reasons": "array<string>", "scores": SCORES,
}
CANDIDATE = _struct(_CANDIDATE)
FINAL_FIELD = _struct({
    "field": "string", "status": "string", "value": "string", "normalized_value": "string", "confidence": "double",
    "rationale": "array<string>", "evidence": f"array<{EVIDENCE}>", "alternatives": f"array<{CANDIDATE}>",
})

UPLOADS = "run_id string, upload_ord bigint, filename string, content binary"
EXTRACTIONS = "run_id string, doc_id string, pages array<string>, page_count int, error string"
PAGE_TEXTS = "sha256 string, pages array<string>, page_count int, error string"
DOC_INDEX = ("run_id string, doc_id string, filename string, mime_type string, pages int, "
             "has_text_layer boolean, unreadable_reason string, sha256 string")
PAGES = "run_id string, doc_id string, page int, page_ord int, full_text string"
SCHEMA_FIELDS = "run_id string, ord int, key string, label string, type string"
USER_SCHEMAS = "run_id string, schema_json binary"
FORM_FIELDS = "run_id string, file_name string, field_name string"
ROUTING_ROWS = "run_id string, field string, doc_rank int, doc_id string, score double"
RESPONSES = "run_id string, field string, attempt int, text string"
ANSWERS = "run_id string, field string, attempt int, prompt_hash string, text string, call_error string, at double"
TRACE = ("ts string, run_id string, step string, status string, duration_ms long, "
         "inputs_ref array<string>, outputs_ref array<string>, error struct<kind:string,message:string>")
OVERRIDES = "run_id string, field string, action string, value string, ord bigint"
TRUTH = "run_id string, field string, value string"


@dataclass(frozen=True)
class Artifact:
    """A stored artifact: its row type and whether a bundle holds many rows of it."""

    name: str
    ddl: str
    is_list: bool

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


ARTIFACTS = {
    a.name: a
    for a in [
        Artifact("schema", f"run_id string, schema_source string, resolved_fields array<{FIELD_SPEC}>, "
                           "unsupported_fields array<string>", False),
        Artifact("doc_index", DOC_INDEX, True),
        Artifact("layout", f"run_id string, doc_id string, pages array<{PAGE}>", True),
        Artifact("routing", "run_id string, field string, doc_ids array<string>, "
                            "scores map<string,double>", True),
        Artifact("candidates", f"run_id string, {_table(_CANDIDATE)}", True),
        Artifact("final", f"run_id string, schema_source string, fields map<string,{FINAL_FIELD}>", False),
    ]
}
