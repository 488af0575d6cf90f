"""Token ids in binary files: frequency-ranked, byte-aligned, control bytes apart.

A file holds a run of documents in ascending doc_id order. Its ids are replaced by
their rank among the file's own ids (most frequent first), so a file explains itself:

    magic "AVB2", then little-endian u32: distinct ids k, documents d, tokens n, data bytes b
    k x u32   ids by rank
    d x u32   tokens of each document
    d x i64   doc_id of each document, 0 where it is null
    d x u8    1 where the doc_id is null
    ceil(n/4) control bytes: two bits a token, its number of data bytes less one
    b         data bytes, little-endian, one to four a token

Decoding looks the four lengths of each control byte up in a 256-row table.
Documents are range-partitioned by doc_id; a task encodes block by block in bounded
memory. File names are unique, and only files named in the written manifest count,
so lost or repeated tasks leave no trace in the result.

Defined cases: an added token's content in a text, such as "<|endoftext|>", is that
token, as the tokenizer has it by default; null text is empty and has the end id alone; repeated doc_ids keep
their rows next to each other; a null doc_id sorts first; an empty table has no rows.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import table
from attesta.settings import shared_folder, written

MAGIC, HEAD, END_ID, BLOCK = b"AVB2", 20, 2, 4_000_000
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode(ids: np.ndarray, counts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """One file: all ids of its documents, how many each document has, and its doc_id."""
    often = np.bincount(ids)
    found = np.flatnonzero(often)
    order = np.argsort(-often[found], kind="stable")
    rank = np.zeros(len(often), np.uint32)
    rank[found[order]] = np.arange(len(found), dtype=np.uint32)
    values = rank[ids]
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-len(values) % 4 + len(values), np.uint8)
    codes[: len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    head = np.array([len(found), len(counts), len(values), len(data)], "<u4")
    named = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return MAGIC + head.tobytes() + found[order].astype("<u4").tobytes() + counts.astype("<u4").tobytes() + named + control.tobytes() + data.tobytes()


def lengths(blob: bytes) -> list[int]:
    """Distinct ids, documents, tokens and data bytes, from the first HEAD bytes of a file."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token file")
    return np.frombuffer(blob, "<u4", 4, 4).tolist()


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ids, the documents' counts and their doc_ids of one file."""
    k, d, n, b = lengths(blob)
    ids, at = np.frombuffer(blob, "<u4", k, HEAD), HEAD + 4 * k
    counts, at = np.frombuffer(blob, "<u4", d, at), at + 4 * d
    named, at = np.frombuffer(blob, "<i8", d, at), at + 8 * d
    doc_ids, at = pa.array(named, pa.int64(), mask=np.frombuffer(blob, np.bool_, d, at)), at + d
    control, at = np.frombuffer(blob, np.uint8, (n + 3) // 4, at), at + (n + 3) // 4
    data = np.frombuffer(blob, np.uint8, b, at)
    size = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    values = np.zeros(n, np.uint32)
    values |= data[start]
    for byte in range(1, int(size.max(initial=0))):
        has = np.flatnonzero(size > byte)
        values[has] |= data[start[has] + byte].astype(np.uint32) << (8 * byte)
    return ids[values] if n else np.zeros(0, np.uint32), counts, doc_ids


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pieces:
    """Encodes texts, keeping the ids of pieces seen before.

    The pre-tokeniser never joins what a single space or line end between two other
    characters parts, so a text may be cut before each such space and around each such
    line end. A text with two white-space characters in a row, or white space at an end,
    has a piece that shows it: an empty one, a lone space, or one with white space of
    another kind that matches ``ODD``. Such texts are given to the tokenizer whole, and so
    are those that hold the content of an added token, such as the end of text, which
    the tokenizer takes as that token.

    A new piece that is one word of letters, after a space or not, is one pre-token, and
    goes to the tokenizer's model at once, its bytes as the vocabulary writes them. Letters
    are those below ``LETTERS``, on which all versions of Unicode agree.
    """

    LETTERS = "\u0530"

    OTHER, ODD = r"[^\S \n]", r"\s{2}|^[^\S ]|\s$"
    NONE = {"": None, " ": None}
    # It also parts a letter from these, so a new piece that ends in them is a known stem and a known tail more often than not.
    TAIL = ".,;:!?%&#*$|<>()\""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        plain = t.normalizer is None and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and not t.pre_tokenizer.add_prefix_space
        self.model = t.model if plain and isinstance(t.model, models.BPE) else None
        self.letters = byte_letters()
        self.known: dict[str, bytes | None] = dict(self.NONE)
        self.most, self.other, self.odd = most, re.compile(self.OTHER), re.compile(self.ODD)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, new: list[str]) -> None:
        """Ids of new pieces, as bytes; None for those that show that their text must stay whole."""
        if self.other.search("\x00".join(new)):
            odd = {p for p in new if p != "\n" and self.odd.search(p)}
            self.known.update(dict.fromkeys(odd))
            new = [p for p in new if p not in odd]
        ends = {}
        for p in new:
            stem = p.rstrip(self.TAIL)
            if len(stem) < len(p) and stem[-1:].isalpha() and stem[-1] < self.LETTERS:
                ends[p] = stem, p[len(stem):]
        if ends:
            new = list({p for p in new if p not in ends}.union(*ends.values()).difference(self.known))
        if self.model:
            words = {p for p in new if p[p[0] == " ":].isalpha() and (p.isascii() or max(p) < self.LETTERS)}
            self.known.update([(p, self.word(p)) for p in words])
            new = [p for p in new if p not in words]
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            self.known.update(zip(part, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        of = self.known.__getitem__
        self.known.update([(p, of(stem) + of(tail)) for p, (stem, tail) in ends.items()])

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end id. The many short-lived lists hold no cycles, so the collector rests."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known = dict(self.NONE)
        whole = [i for i, t in enumerate(texts) if "\x00" in t or any(a in t for a in self.added)]
        split = [t.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") for t in texts]
        for i in whole:
            split[i] = [""]
        self.learn(list(set().union(*split).difference(self.known)))
        end, of, out = array("I", [END_ID]).tobytes(), self.known.__getitem__, []
        for t, s in zip(texts, split):
            s.append("")
            ids = [*map(of, s)]
            ids[-1] = end
            try:
                joined = b"".join(ids)
            except TypeError:  # a piece without ids
                joined = array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() + end
            out.append(np.frombuffer(joined, np.uint32))
        return out


_OPEN: dict[str, Pieces] = {}


def opened(path: str) -> Pieces:
    """The encoder of this worker process, which serves one task after another."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def write_files(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes the files and returns the manifest: part, block, path."""
    cols = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = cols.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def task(batches):
        from pyspark import TaskContext

        pieces, part, block = opened(tokenizer), TaskContext.get().partitionId(), 0
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        held, docs_held, n = [], [], 0

        def flush():
            name = f"{part:06d}-{block:06d}-{uuid.uuid4().hex}.avb"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(encode(np.concatenate(held), np.array([len(x) for x in held], np.uint32), docs_held))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "path": [f"{folder}/{name}"]})

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for i, e in zip(ids[at:at + 256], pieces.encode(texts[at:at + 256])):
                    held.append(e), docs_held.append(i)
                    n += len(e)
                    if n >= BLOCK:
                        yield flush()
                        held, docs_held, n, block = [], [], 0, block + 1
        if held:
            yield flush()

    rows = ranged.mapInArrow(task, "part int, block int, path string")
    return written(rows, "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files the manifest names."""
    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _fs(row["path"])
                with fs.open_input_stream(path) as f:
                    ids, counts, doc_ids = decode(f.read())
                stop = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(counts), pa.int32()), "block": pa.array([row["block"]] * len(counts), pa.int32()),
                    "doc_id": doc_ids, "inner": pa.array(stop - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[b - c:b].tobytes()) for b, c in zip(stop.tolist(), counts.tolist())], pa.int64())})

    def heads(batches):
        for batch in batches:
            tokens = []
            for at in batch.column(2).to_pylist():
                fs, path = _fs(at)
                with fs.open_input_stream(path) as f:
                    tokens.append(lengths(f.read(HEAD))[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["p", "b", "tokens"])

    spread = manifest.select("part", "block", "path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    rows = spread.mapInArrow(task, "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # One row a file of millions of tokens, in one task: what stands before each file.
    before = spread.mapInArrow(heads, "p int, b int, tokens long").select("p", "b", (F.sum("tokens").over(Window.orderBy("p", "b")) - F.col("tokens")).alias("base"))
    return rows.join(before, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_files(write_files(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), folder))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
