"""Whitening, token counts and resampling against plain Python on the smallest tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from test_operators import SF, docs, listed, odd, rows, texts  # noqa: F401

from attesta.llm import resampling, token_counts, whitening

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts(rows, tokenizer):  # noqa: F811
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts(rows)]
    assert listed(token_counts.count_tokens(rows), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_token_counts_of_made_texts(counter, tokenizer):
    signs = [*" \t\n\x1c\x85 　 abXYZ'stΣσςİıß́éﬁ①Ⅷ٣१한글가क़𝒳😀-=<|>_\x00​﻿", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'ll", "'RE", "Å", "é", "hello", "2024"]
    rng = random.Random(5)
    made = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(4000)]
    want = [len(e.ids) for e in tokenizer.encode_batch(made, add_special_tokens=False)]
    assert counter.counted(t.encode() for t in made) == want
    # The same with blocks cut in every text and a memory of few pieces.
    small = token_counts.Counter.__new__(token_counts.Counter)
    small.__dict__.update(counter.__dict__, known={}, most=50)
    assert small.counted((t.encode() for t in made), most=16) == want


@pytest.mark.parametrize("text", ["a" * 100_001, "=" * 77_777, "ab" * 30_000 + "a", "x " * 50_000, "".join(random.Random(3).choices("abcdefgh", k=20_000)), " ", "　", ""])
def test_token_counts_of_long_pieces(counter, tokenizer, text):
    assert counter.counted([text.encode()], most=1000) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]


def test_vocabulary_out_of_order_is_refused():
    bytes_ = token_counts.byte_characters()
    vocab = {c: i for i, c in enumerate([*bytes_, *(c + "." for c in bytes_), "ab", "abc"])}
    model = {"type": "BPE", "vocab": vocab, "end_of_word_suffix": ".", "dropout": None, "continuing_subword_prefix": None, "ignore_merges": False, "byte_fallback": False}
    assert token_counts.Merges({**model, "merges": [["a", "b"], ["ab", "c"]]}).counts(["abcd", "", "b"]).tolist() == [2, 0, 1]
    with pytest.raises(ValueError):
        token_counts.Merges({**model, "merges": [["ab", "c"], ["a", "b"]]})


def features(text, longest):
    w = FEATURE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(" ".join(w[k:k + n]).encode()) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def drawn(corpus, target, longest=1, buckets=10_000):
    s, t = (Counter(f % buckets for x in part for f in features(x, longest)[1]) for part in ([x for _, x in corpus], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out, may = [], []
    for i, x in corpus:
        w, f = features(x, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in f)
        row = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        may += [row] if len(w) >= 20 else []
    may.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, *r[1:3]))
    for rank, row in enumerate(may[: 10 * len(may) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(rows, spark, longest):  # noqa: F811
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = listed(resampling.resample(rows, bench, longest=longest), "doc_id", "n_features", "weight", "score", "rank")
    assert got == drawn(texts(rows), [r["text"] for r in bench.collect()], longest)


def test_resampling_of_ties_and_empty_targets(spark):
    made = [(i % 40, "tie " * 20) for i in range(200)] + [(i, "tie " * (15 + i)) for i in range(200, 230)] + [(None, "tie " * 21), (7, None)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    for target in ([], [None, ""], ["tie tie other"]):
        bench = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
        assert listed(resampling.resample(df, bench), "doc_id", "n_features", "weight", "score", "rank") == drawn(made, target)


def test_features_do_not_depend_on_blocks():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("aB0é-. 　\n", k=rng.randint(0, 80)))
        for longest in (1, 2, 4):
            want = Counter(features(text, longest)[1])
            assert Counter(h for part in resampling.feature_hashes(text.encode(), longest, most=rng.randint(1, 9)) for h in part) == want


def test_ranks_of_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "id * 37 % 101 as v")
    got = sorted((r["rank"], r["v"], r["id"]) for r in resampling.with_rank(df, ["v", "id"]).collect())
    assert got == [(n + 1, *k) for n, k in enumerate(sorted((i * 37 % 101, i) for i in range(5000)))]


def plain(vectors):
    """Integer vectors, exact deviations, and the whitened rows of a float64 solve."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    y = n * x - s
    cov = np.array([[float(Fraction(int(v), n ** 3)) for v in row] for row in y.T @ y])
    value, axes = np.linalg.eigh(cov)
    value, axes = value[::-1], axes[:, ::-1]
    return (y * y).sum(1).tolist(), value, (y / n).astype(float) @ axes / np.sqrt(np.abs(value))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_whitening(spark, name):
    df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    deviation, value, white = plain(vectors.values())
    place = {i: k for k, i in enumerate(vectors)}
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * len(vectors) and {r["n"] for r in got} == {len(vectors)}
    sign = {}
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == deviation[k] and r["explained"] == pytest.approx(value[c] / value.sum(), rel=1e-12) and 0 <= r["identity_error"] < 1e-12
        sign.setdefault(c, np.sign(r["whitened"] * white[k, c]))
        assert r["whitened"] == pytest.approx(sign[c] * white[k, c], abs=1e-9)


def test_whitening_of_odd_rows(spark):
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    good = [(i, [float(c) for c in rng.normal(size=5).astype(np.float32)]) for i in range(30)] + [(None, [0.5] * 5), (3, [0.25] * 5), (3, [0.25] * 5)]
    bad = [(100, None), (101, []), (102, [None] * 5), (103, [1.0, None, 0.0, 0.0, 0.0]), (104, [nan] * 5), (105, [inf, 0.0, 0.0, 0.0, 0.0]), (106, [0.0, -inf, 0.0, 0.0, 0.0]),
           (107, [1.0] * 4), (108, [1.0] * 6), (109, [1e30] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in good + bad], "vec_id long, embedding array<float>, n int, deviation string, w int").repartition(3)
    got = whitening.whiten(df).collect()
    deviation, value, white = plain([v for _, v in good])
    assert Counter(r["vec_id"] for r in got) == {i: 5 * n for i, n in Counter(i for i, _ in good).items()}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    for c in range(5):
        mine = np.sort(np.abs([r["whitened"] for r in got if r["component"] == c + 1]))
        assert np.allclose(mine, np.sort(np.abs(white[:, c])), atol=1e-9)
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id between 100 and 106")).count() == 0


def test_whitening_without_variance_and_with_wide_values(spark):
    schema = "vec_id long, embedding array<double>"
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], schema)).collect()
    assert len(flat) == 8 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in flat)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(4)], schema)).collect()
    assert [r["whitened"] is None for r in line if r["component"] == 2] == [True] * 4 and all(r["whitened"] is not None for r in line if r["component"] == 1)
    wide = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 2.0]), (4, [1e9, 1e9])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(wide, schema)).collect()}
    assert got[1, 1]["deviation"] is None and abs(abs(got[1, 1]["whitened"]) - 2 ** 0.5) < 1e-6 and got[1, 1]["identity_error"] < 1e-9


@pytest.mark.parametrize("gap", [1e-2, 1e-6, 1e-9, 1e-12, 0.0])
def test_clustered_eigenvalues(gap):
    """The eigenvectors of a matrix whose first eigenvalues lie ``gap`` apart, to far below float32."""
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(40) - q.T @ q / 2)
    value = np.concatenate([10 + gap * np.arange(5)[::-1], [4.0 + gap, 4.0], np.linspace(1, 0.1, 33)]).astype(np.longdouble)
    a = (q * value) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert np.abs(a @ x - x * found).max() < 1e-16 and np.abs(x.T @ x - np.eye(40)).max() < 1e-16 and np.abs(found - value).max() < 1e-15
    if gap:
        off = np.abs(np.abs(q.T @ x) - np.eye(40)).max()
        assert off < 1e-16 / gap + 1e-15
