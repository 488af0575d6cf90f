"""Token counts by rank-synchronous array merging.

A text is cut at ASCII white space. The tokenizer's own normaliser and pre-tokeniser
never join what such white space parts, so a piece's count is a function of the piece
alone. The distinct pieces of a block of text are turned into pre-tokens together, and
all their symbols lie in one flat array, sequence after sequence (a ragged array). Each
round finds the lowest rank among every sequence's adjacent pairs and applies that pair
at all its places in the sequence, in all sequences at once; a sequence without a pair
that has a rank leaves the array, and what is left of it is its count.

A round may take all places of a pair because no rank that a merge brings up is lower
than its own: every token is made by one merge, after those that make its parts.
``Merges`` checks this when it reads the vocabulary and refuses one that breaks it.

Plan: one pass over the table, no shuffle. A task holds one block of text and at most
``KNOWN`` counts of pieces seen before; a long text is taken block by block.

Defined cases: a null text is empty; empty text has 0 bytes and 0 tokens; the content of
a special token in a text is that token, as the tokenizer has it by default; repeated
rows and null ids keep a row each; an empty table has no rows; columns other than those
named are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import table

LIMIT = 2048
BLOCK, KNOWN = 1 << 20, 1_000_000
NONE = np.iinfo(np.int64).max


class Merges:
    """Merge ranks of a byte-level BPE vocabulary, and merging by rounds.

    ``ranks`` is kept as two aligned arrays: sorted pair keys and their ranks. The
    symbol a merge of rank r makes is ``made[r]``.
    """

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["byte_fallback"]:
            raise ValueError("counts are for plain byte-level BPE only")
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, self.made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        born = np.full(self.width, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merge that makes one of its parts, or makes a token again")
        keys = left * self.width + right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        # Symbols by byte character, inside a pre-token and at its end.
        self.inner, self.last = np.zeros((2, 512), np.int64)
        for c in byte_characters():
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; ``NONE`` where there is no such merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token, given in byte characters."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)
        symbols, ends = self.inner[codes], np.cumsum(sizes) - 1
        symbols[ends[sizes > 0]] = self.last[codes[ends[sizes > 0]]]
        out = np.zeros(len(pieces), np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(owner)))
            done = lowest == NONE
            out[owner[first[done]]] = width[done]
            stay = np.repeat(~done, width)
            if not stay.any():
                break
            if done.any():
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                lowest, width = lowest[~done], width[~done]
            hit = np.flatnonzero(rank == np.repeat(lowest, width))
            # Of places that overlap, as in "aaa", every other one is taken from the left.
            run = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # Only the pairs that hold a new symbol have another rank now.
            for at in (new, new[new > 0] - 1):
                inside = at[at + 1 < len(symbols)]
                rank[at] = NONE
                rank[inside] = np.where(owner[inside] == owner[inside + 1], self.rank(symbols[inside], symbols[inside + 1]), NONE)
        return out


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


def blocks(text: bytes, most: int = BLOCK) -> Iterator[bytes]:
    """The text in parts of about ``most`` bytes, cut only at a space or line end."""
    at = 0
    while len(text) - at > most:
        # From at + 1: a part begins with the white space that ended the one before.
        stop = max(text.rfind(c, at + 1, at + most) for c in (b" ", b"\n"))
        if stop < 0:
            stop = min((x for x in (text.find(c, at + most) for c in (b" ", b"\n")) if x >= 0), default=len(text))
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


class Counter:
    """Token counts of texts, with the counts of pieces seen before."""

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.normal, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that look beyond their own characters are not supported")
        # White space beyond ASCII, as the normaliser takes it, parts a piece as well.
        wide = [c for c in map(chr, range(128, 0x3001)) if c.isspace() and self.normal.normalize_str(f"a{c}b") == "a b"]
        self.white = re.compile(f"[{''.join(wide)}]")
        self.known: dict[bytes, int] = {}
        self.most = known

    def parts(self, piece: str) -> tuple[list[str], int]:
        """What lies between the special tokens and the wide white space of a piece, and how many special tokens it has."""
        out, n = [], 0
        while True:
            at, token = min(((piece.find(s), s) for s in self.special if s in piece), default=(len(piece), ""))
            out += self.white.split(piece[:at])
            if not token:
                return [p for p in out if p], n
            piece, n = piece[at + len(token):], n + 1

    def learn(self, new: list[bytes]) -> None:
        """Counts of new pieces: normalised and parted together, with a space between them, then merged together."""
        line = b" ".join(new).decode("utf-8", "replace")
        total, owner = np.zeros(len(new), np.int64), np.arange(len(new))
        if self.white.search(line) or any(s in line for s in self.special):
            parts, total[:] = zip(*map(self.parts, line.split(" ")))
            owner = np.repeat(owner, [len(p) for p in parts])
            line = " ".join(p for row in parts for p in row)
        line = self.normal.normalize_str(line)
        pre, spans = zip(*self.split.pre_tokenize_str(line)) if line else ((), ())
        cut = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        if len(cut) != max(len(owner) - 1, 0):
            raise ValueError("the normaliser made or lost white space inside a piece")
        row = np.searchsorted(cut, np.array([s for s, _ in spans], np.int64), side="right")
        kinds: dict[str, int] = {}
        kind = np.array([kinds.setdefault(p, len(kinds)) for p in pre], np.int64)
        if len(kind):
            total += np.bincount(owner[row], self.merges.counts(list(kinds))[kind], len(new)).astype(np.int64)
        self.known.update(zip(new, total.tolist()))

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        of = self.known.__getitem__
        return [sum(map(of, s)) for s in split]

    def counted(self, texts: Iterator[bytes], most: int = BLOCK) -> list[int]:
        """Tokens of each text, with no more than a few blocks split at once."""
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            out.append(0)
            for part in blocks(text, most):
                held.append((i, part))
                size += len(part)
                if size >= most:
                    self.add(held, out)
                    held, size = [], 0
        self.add(held, out)
        return out

    def add(self, held: list[tuple[int, bytes]], out: list[int]) -> None:
        for (i, _), n in zip(held, self.count([part for _, part in held])):
            out[i] += n


_OPEN: dict[str, Counter] = {}


def opened(path: str) -> Counter:
    """The counter of this worker process, which serves one task after another."""
    if path not in _OPEN:
        _OPEN[path] = Counter(path)
    return _OPEN[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def task(batches):
        counter = opened(path)
        for batch in batches:
            tokens = counter.counted(t.as_py() for t in batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long"), text.cast("binary"))
    return rows.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
