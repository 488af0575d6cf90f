"""The operators against brute force on the smallest tables and on odd rows."""

import base64
import hashlib
import html as entities
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import decontaminate, html_text, licenses, mixing, neardup, pseudo_likelihood, quality, substrings, token_files, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, LONG, "en", None), (4, LONG + " tail", "en", "a"), (5, "All rights reserved. CC BY, cc-by GPL", None, "a"), (None, "no id here at all", "en", "a"),
       (7, "x " + PASSAGE + " y", "en", "b"), (8, PASSAGE + " z", "en", "b"), (8, PASSAGE + " z", "en", "b"), (9, " \t\n ", "en", "b"), (10, PASSAGE + "  z q", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumn("key", F.lit(0)).withColumn("size", F.lit("x")).withColumn("h", F.lit(1)).withColumn("pool", F.lit(2))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["docs", "odd", "empty"])
def rows(request, docs, odd):
    return {"docs": docs, "odd": odd, "empty": odd.limit(0)}[request.param]


def listed(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_licenses(rows):
    want = []
    for i, t in texts(rows):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    out = licenses.scan(rows)
    assert listed(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    for r in out.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_substrings(rows):
    first, all_ = {}, texts(rows)
    split = [(i, WORD.findall(t or "")) for i, t in all_]
    for i, w in split:
        for k in range(len(w) - 49):
            key = " ".join(w[k:k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[" ".join(w[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert listed(substrings.dedup(rows), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)


def test_substrings_in_hot_buckets(docs, monkeypatch):
    plain = listed(substrings.dedup(docs), "doc_id", "n_removed")
    monkeypatch.setattr(substrings, "HOT", 0)
    assert listed(substrings.dedup(docs), "doc_id", "n_removed") == plain


def test_quality(rows):
    want = []
    for i, t in texts(rows):
        t, w = t or "", WORD.findall(t or "")
        five = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if five[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    out = quality.judge(rows)
    assert listed(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not [r for r in out.collect() if r["kept"] and r["base_failed"]]
    assert quality.filter_quality(rows).columns == rows.columns


def test_quality_verdicts(docs, spark):
    least, floor, k = 30, np.array(quality.FLOOR) * quality.SCALE, len(quality.STATS)
    lang, source = docs.groupBy("lang", "source").count().orderBy(F.desc("count"), "lang", "source").first()[:2]
    made = [(9001, " ".join(f"{i:x<60}" for i in range(80))), (9002, " ".join(chr(97 + i % 26) if i % 3 else chr(0x4E00 + i) for i in range(80))), (9003, " ".join(f"#{i:*<5}" for i in range(80)))]
    rows = docs.select("doc_id", "lang", "source", "text").unionByName(spark.createDataFrame([(i, lang, source, t) for i, t in made], "doc_id long, lang string, source string, text string"))
    got = quality.judge(rows, least=least).collect()
    by, rest = Counter((r["lang"], r["source"]) for r in got), Counter()
    for (a, _), n in by.items():
        rest[a] += n * (n < least)
    pools = defaultdict(list)
    for r in got:
        n = by[r["lang"], r["source"]]
        pools[(r["lang"], r["source"]) if n >= least else (r["lang"],) if rest[r["lang"]] >= least else ()].append(r)
    for pool in pools.values():
        x = np.array([[r[f"x{i}"] for i in range(k)] for r in pool], float)
        core = full = x[[r["n_words"] > 0 for r in pool]]
        for step in range(quality.STEPS + 1):
            m, inverse = core.mean(0), np.linalg.inv(np.cov(core.T, bias=True) + np.diag(floor ** 2))
            if step < quality.STEPS:
                bins = np.floor(np.sqrt(np.einsum("ni,ij,nj->n", full - m, inverse, full - m)) * quality.GRID)
                core = full[bins <= np.sort(bins)[int(np.ceil(quality.CORE * len(bins))) - 1]]
        scatter = np.linalg.inv(inverse)
        for r, v in zip(pool, x - m):
            part = v * (inverse @ v)
            bad = part.sum() > quality.LIMIT ** 2 and (abs(v[0]) > quality.LIMIT * scatter[0, 0] ** 0.5 or 2 * (part[0] + part[1:][v[1:] > 0].sum()) >= part.sum())
            bad &= len(core) >= least * quality.CORE / 2
            assert r["kept"] == (not r["base_failed"] and not bad), (r, part)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[9001] and not kept[9003] and any(kept.values())


def test_token_files(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in sorted(texts(rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert listed(token_files.token_table(rows), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_added_tokens_in_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\ny z", "a <|endoftext| > b", "\x00 <|endoftext|>", "plain words"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [2] for t in rows]
    assert 50256 in want[0] and [x.tolist() for x in token_files.Pieces(path).encode(rows)] == want


def test_token_file_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        ids = np.minimum(rng.zipf(1.2, n), 2 ** 31).astype(np.uint32)
        counts = np.array([n // 2, n - n // 2], np.uint32)
        got, c, d = token_files.decode(token_files.encode(ids, counts, [None, -2 ** 63]))
        assert (got == ids).all() and (c == counts).all() and d.to_pylist() == [None, -2 ** 63]


def test_stems_and_marks_encode_as_whole_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(2)
    parts = ["a", "Onedshes", "it's", "é", "中文", "'", ".", "...", "!!", "(", ")", " ", " ", "\n", "&&&", "9", "½", "ª", "²", "ǅ", "\u0301", "\"", "'s", "\u00a0", "?!", "<|"]
    rows = ["".join(rng.choice(parts, 12)) for _ in range(3000)]
    tok = Tokenizer.from_file(path)
    assert [x.tolist() for x in token_files.Pieces(path).encode(rows)] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in rows]


def test_starts_come_from_the_files(spark, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "BLOCK", 5)
    rows = spark.createDataFrame([(i, "some words here, " * (i % 4)) for i in range(40)] + [(None, None), (7, "again")], "doc_id long, text string")
    manifest = token_files.write_files(rows, public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/t")
    got = sorted((r["start"], r["n_tokens"]) for r in token_files.read_files(manifest).collect())
    assert manifest.columns == ["part", "block", "path"] and manifest.count() > 5 and len(got) == 42
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and got[0][0] == 0


def test_warc_records_are_gzip_members(spark, tmp_path):
    html = [f"<p>{i}</p>" * 3000 for i in range(20)] + ["", None, "<p>0</p>" * 3000]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    manifest = warc.write_warcs(pages, f"{tmp_path}/w")
    assert sum(r.bytes for r in manifest.collect()) * 3 < sum(len(h or "") for h in html)
    starts = []
    for r in manifest.collect():
        left = open(r.path, "rb").read()
        assert len(left) == r.bytes
        while left:
            member = zlib.decompressobj(31)
            starts.append(member.decompress(left)[:8])
            left = member.unused_data
    assert starts == [b"WARC/1.1"] * len(html)
    got = {r.page_id: r for r in warc.read_warcs(manifest).collect()}
    assert {i: (r.payload or b"").decode() for i, r in got.items() if r.record_type == "response"} == {i: h or "" for i, h in enumerate(html) if i not in (0, 20)}
    assert got[0].refers_to == 22 and got[20].refers_to == 21


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", None, "", "é" * 70_000, "<p>a</p>", "<p>a</p>"]
    data = [(i, f"http://x/{i} é", h) for i, h in enumerate(html)] + [(None, None, "z"), (5, "u", "<p>a</p>")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    out = warc.read_warcs(warc.write_warcs(pages, f"{tmp_path}/w"))
    top = defaultdict(lambda: None)
    for i, _, h in data:
        top[h or ""] = max([x for x in (top[h or ""], i) if x is not None], default=None)
    want = [(i, u or "", len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if top[h or ""] == i else "revisit",
             None if top[h or ""] == i else top[h or ""], (h or "").encode() if top[h or ""] == i else None) for i, u, h in data]
    got = listed(out, "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert got == sorted(((*w[:6], None if w[6] is None else bytearray(w[6])) for w in want), key=repr)
    assert out.where("record_type = 'revisit'").count() == sum(w[4] == "revisit" for w in want)
    assert warc.read_warcs(warc.write_warcs(pages.limit(0), f"{tmp_path}/e")).count() == 0


def test_html_on_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r["html"])
        body = re.sub(r"<[^>]*\Z", "", body[1] if body else "")
        want = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " " if x else "", b))).strip() for x, b in enumerate(re.split(r"</?(?:p|h1)>", body))]
        assert r["text"] == "\n".join(x for x in want if x), r["page_id"]
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p", ""), ("<script>if (a<b) '<p>x</p>'</script>", ""),
    ("<body><header>Site</header><nav><a>x</a></nav><main><article><header><h1>T</h1></header><p>One &amp; two&nbsp;three <b>four</b></p><p>k</p><aside>side words here</aside>"
     "<form>mail <input></form><div class='comments'><p>nice one indeed, really</p></div></article></main><footer>c</footer></body>", "T\nOne & two three four\nk"),
    ("<article><p>a<p>b<div class='cookie-notice'>We use cookies to make this better</div><ul><li>c</li><li>d</li></ul></article><section id='comments'><p>First one here to say so</p></section>", "a\nb\nc\nd")])
def test_html_cases(page, text):
    assert html_text.main_text(page, html_text.grow(*html_text.labelled())) == text


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<style>a<b{}</style >", "<svg viewBox='0 0 1 1'/>", "<iframe src=http://x/>no frames</iframe>", "<svg><path d='M0'/></svg>", "<button>",
    "<datalist><option>x<option value='y'></datalist>", "<template/>"])
@pytest.mark.parametrize("end", ["", "<select><option>z</option></select>"])
def test_html_after_raw_elements(raw, end):
    page = f"<body>{raw}<article><h1>T</h1><p>One two</p></article>{end}</body>"
    assert html_text.main_text(page, html_text.grow(*html_text.labelled())) == "T\nOne two"


def test_mixing(rows):
    out = mixing.mix(rows).collect()
    by = defaultdict(int)
    for r in rows.collect():
        by[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, goal, open_ = float(sum(by.values())), {}, set(names)
    while True:
        unit = left / max(sum(weight[s] for s in open_), 1)
        full = {s for s in open_ if 3 * by[s] <= weight[s] * unit}
        if not full:
            break
        for s in full:
            goal[s] = 3.0 * by[s]
            left -= goal[s]
        open_ -= full
    goal.update({s: weight[s] * unit for s in open_})
    took, most = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["copies"] <= 3
        took[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert len(out) == rows.count() and all(abs(took[s] - goal[s]) <= most[s] for s in names)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(rows.repartition(3)).collect()))
    assert mixing.take(rows).count() == sum(r["copies"] for r in out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment():
    rng, pairs = np.random.default_rng(5), []
    for _ in range(150):
        a = rng.integers(0, 30, rng.integers(1, 200)).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 2 + len(a) // 3))):
            k = int(rng.integers(0, len(b) + 1))
            b[k:k + int(rng.integers(0, 2))] = rng.integers(0, 30, rng.integers(0, 2)).tolist()
        pairs.append((np.array(a, np.int64), np.array(b or [1], np.int64)))
    want = [edit_distance(a.tolist(), b.tolist()) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert neardup.similar(pairs).tolist() == want and any(want) and not all(want)


def test_bounds_are_below_the_distance():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (rng.integers(0, int(rng.integers(2, 40)), rng.integers(0, 60)).astype(np.uint64) for _ in "ab")
        x, y = (set(np.flatnonzero(np.unpackbits(neardup.bitmap(t).view(np.uint8))).tolist()) for t in (a, b))
        bag = max(len(a), len(b)) - sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        assert max(len(x - y), len(y - x)) <= neardup.bag_distance(a, b) == bag <= edit_distance(a.tolist(), b.tolist())


def test_new_links_join_earlier_components(spark):
    rng, edges = np.random.default_rng(8), []
    label = spark.createDataFrame([], "key binary, label binary")
    for _ in range(4):
        new = [(int(i), int(j)) for i, j in rng.integers(0, 60, (12, 2)) if i < j]
        edges += new
        label = neardup.hooked(label, spark.createDataFrame([(bytes([i]), bytes([j])) for i, j in new], "a binary, b binary"))
        root = list(range(60))
        for _ in root:
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        linked = {k for e in edges for k in e}
        assert {r["key"][0]: r["label"][0] for r in label.collect()} == {k: root[k] for k in linked}


def shingles(t):
    w = WORD.findall(t)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_duplicates_find_what_shingles_find(spark, docs):
    rows = neardup.classes(docs)[0].join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).collect()
    sets = [(bytes(r["label"]), shingles(r["text"])) for r in rows]
    missed = [1 for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and len(x & y) >= 0.8 * len(x | y)]
    assert not missed
    groups = defaultdict(list)
    for label, x in sets:
        groups[label].append(x)
    assert all(any(len(x & y) > 0.2 * len(x | y) for y in g if y is not x) for g in groups.values() if len(g) > 1 for x in g)


def changed(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k, new = int(rng.integers(0, len(words))), [f"n{rng.integers(10 ** 9)}"]
        kind = int(rng.integers(0, 3))
        words[k:k + (kind > 0)] = new if kind < 2 else []
    return words


def test_chains_in_one_bucket(spark):
    rng, made = np.random.default_rng(7), []
    for chain in range(8):
        w = [f"c{chain}x{i}" for i in range(40)]
        for _ in range(6):
            made.append(w)
            w = changed(rng, w, 5 + chain % 4)
    made = [list(w) for w in {" ".join(w): w for w in made}.values()]
    near = [[edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for y in made] for x in made]
    label = list(range(len(made)))
    for _ in made:
        label = [min(label[j] for j in range(len(made)) if near[i][j]) for i in range(len(made))]
    want = sorted(sorted(" ".join(made[i]) for i in range(len(made)) if label[i] == c) for c in set(label))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    sketched = neardup.sketches(docs).withColumn("buckets", F.array(F.lit(1).cast("long")))
    at, groups = {r["key"]: r["label"] for r in neardup.joined(docs, sketched).collect()}, defaultdict(list)
    for w in made:
        key = bytearray(hashlib.md5(" ".join(w).encode()).digest())
        groups[bytes(at.get(bytes(key), key))].append(" ".join(w))
    assert sorted(sorted(g) for g in groups.values()) == want


def test_buckets_of_the_same_texts_stand_once(spark):
    # a and b share three buckets with nobody else, one with c; the three of b, c and d are two buckets.
    held = {1: "ab", 2: "ab", 3: "abc", 4: "bcd", 5: "ab", 6: "bcd", 7: "acd"}
    rows = [(k.encode(), 9, b) for b, keys in held.items() for k in keys]
    got = neardup.once(spark.createDataFrame(rows, "key binary, n int, bucket long")).collect()
    assert sorted((r["bucket"], bytes(r["key"]).decode(), r["n"], r["times"]) for r in got) == sorted(
        (b, k, 9, times) for b, times in {1: 3, 3: 1, 4: 2, 7: 1}.items() for k in held[b])


def test_two_near_copies_stand_in_one_bucket(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"]))], "doc_id long, text string")
    seen, kept = {}, neardup.written

    def noted(df, label):
        out = kept(df, label)
        seen.setdefault(label, out.count())
        return out

    monkeypatch.setattr(neardup, "written", noted)
    assert neardup.classes(docs)[1].count() == 1
    assert seen["near-buckets"] > 10 and seen["near-left"] == 2


def test_near_copies_cost_few_comparisons(spark, monkeypatch):
    """Copies that share many buckets are first compared with one text each, and long ones too far apart need no text."""
    rng, met, kept = np.random.default_rng(12), [], neardup.written
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join([f"n{i}x{rng.integers(10 ** 6)}" if j in set(rng.choice(300, 12).tolist()) else w for j, w in enumerate(base)]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def counted(df, label, *more):
        out = kept(df, label, *more)
        met.extend([out.count()] if label == "near-met" else [])
        return out

    monkeypatch.setattr(neardup, "written", counted)
    assert neardup.classes(docs)[1].count() == 1
    assert met[0] <= 60 and sum(met) <= 120

    words = rng.integers(1, 2 ** 62, 1000).astype(np.uint64)
    other = words.copy()
    other[:300] = rng.integers(1, 2 ** 62, 300).astype(np.uint64)
    rows = spark.createDataFrame([(b"a", words.tobytes()), (b"b", other.tobytes())], "key binary, h binary")
    bits = neardup.bitmaps(rows)
    a, b = (bits.where(F.col("of") == k).select(F.col("bits").alias(n)) for k, n in ((b"a", "x"), (b"b", "y")))
    assert 200 < a.crossJoin(b).select(neardup.lacking("x", "y")).first()[0] <= 300


def test_links_of_least_similarity_meet():
    rng = np.random.default_rng(9)
    for n in [*range(5, 60), 100, 240, 600]:
        for _ in range(3):
            a = rng.integers(1, 2 ** 62, n).astype(np.uint64)
            most = int(0.2 * n)
            b, c = a.copy(), np.append(a, np.uint64(5))
            b[rng.choice(n, most, replace=False)] = rng.integers(1, 2 ** 62, most).astype(np.uint64)
            assert set(neardup.sketch(a)) & set(neardup.sketch(b)) and set(neardup.sketch(a)) & set(neardup.sketch(c)), n


def test_one_of_each_class_stays(rows):
    kept = neardup.keep_one(rows)
    assert kept.columns == rows.columns
    n = len({t for _, t in texts(rows) if t is not None})
    assert kept.where("text is not null").count() <= n and kept.where("text is null").count() == rows.where("text is null").count()


def test_decontamination(docs, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], WORD.findall(r["text"])) for r in bench.collect()]
    want = set()
    for i, t in texts(docs):
        joined = " " + " ".join(WORD.findall(t)) + " "
        want |= {(i, k) for k, w in items if " " + " ".join(w) + " " in joined}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert want and want <= found
    clean = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {i for i, _ in texts(docs)} - {i for i, _ in found}


def test_decontamination_of_odd_rows(odd, spark):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "p1 p2"), (1, PASSAGE)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()}
    assert {(7, 1), (8, 1), (10, 1), (8, 4)} <= found and all(i in (7, 8, 10) for i, _ in found)
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0 and decontaminate.leaks(odd.limit(0), bench).count() == 0


def test_decontamination_of_shortened_items(spark):
    item = [f"s{i}" for i in range(39)]
    docs = spark.createDataFrame([(1, " ".join(item[:-1])), (2, " ".join(item[2:])), (3, " ".join(item[:20])), (4, "s1 s2")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, PASSAGE)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(1, 1): pytest.approx(34 / 35), (2, 1): pytest.approx(33 / 35)}


def test_decontamination_does_not_depend_on_blocks(docs, spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(30)
    rows = bench.selectExpr("item_id as doc_id", "text").unionByName(bench.selectExpr("item_id + 1000 as doc_id", "regexp_replace(text, '[^ ]+$', 'zz') as text")).unionByName(docs.select("doc_id", "text").limit(100))
    names = "doc_id", "item_id", "similarity", "first_word"
    want = listed(decontaminate.leaks(rows, bench), *names)
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert want and listed(decontaminate.leaks(rows, bench), *names) == want


def test_pseudo_likelihood(rows):
    out = pseudo_likelihood.score(rows).collect()
    assert len(out) == rows.count() and all((r["n_words"] == 0) == (r["per_word"] is None) and r["log_prob"] <= 0 for r in out)


def test_log_prob_against_plain_counts(docs):
    counts = Counter(w for _, t in texts(docs) for w in (t or "").lower().split())
    v = pseudo_likelihood.vocabulary(docs)
    log = pseudo_likelihood.train(pseudo_likelihood.context_counts(docs, v))
    total = Counter()
    for w, n in counts.items():
        total[v[w][0]] += n
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(docs).collect()}
    for i, t in texts(docs):
        w = (t or "").lower().split()
        c = [pseudo_likelihood.EDGE, *(v[x][0] for x in w), pseudo_likelihood.EDGE]
        want = sum(log[c[k], c[k + 2], c[k + 1]] + np.log(counts[x] / (total[c[k + 1]] + 1)) for k, x in enumerate(w))
        assert got[i]["n_words"] == len(w) and got[i]["log_prob"] == pytest.approx(want, rel=1e-5)


def test_rare_words_have_their_own_share(docs, monkeypatch):
    want = listed(pseudo_likelihood.score(docs), "doc_id", "n_words", "log_prob")
    monkeypatch.setattr(pseudo_likelihood, "WORDS", 50)
    got = listed(pseudo_likelihood.score(docs), "doc_id", "n_words", "log_prob")
    assert [w[:2] for w in want] == [g[:2] for g in got] and [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)


def test_only_distinct_words_are_looked_up(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pseudo_likelihood, "HELD", 6)
    texts = [["a", "b", "a"], [], ["b", "c"], ["a"] * 7, ["c", "c", "a", "c"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([["x"], None, ["y"], *texts], pa.list_(pa.string()))], ["doc_id", "w"]).slice(3)
    made = list(pseudo_likelihood.pieces([batch], 1))
    assert [p.sizes.tolist() for p in made] == [[3, 0, 2], [7], [4, 0]] and [len(p.words) for p in made] == [3, 1, 2]
    first, E = made[0], pseudo_likelihood.EDGE
    assert [list(map(int, c)) for c in first.contexts(np.array([1, 2, 3]))] == [[E, 1, 2, E, 2], [1, 2, 1, 2, 3], [2, 1, E, 3, E]]
    assert first.sums(np.arange(5.0)).tolist() == [3, 0, 7] and first.rows.column(0).to_pylist() == [3, 4, 5]
    words, times = first.counted(np.array([True, False, True]))
    assert words.to_pylist() == [["a"], [], ["c"]] and times.to_pylist() == [[2], [], [1]]
    v = pseudo_likelihood.Vocabulary([("the", 9), ("a", 5), *((f"w{i}", 2) for i in range(50))], {41: 3})
    some = ["a", "x", "w49", "zebra", "é", "日本語", "\U0001f600", "w7", "the"]
    got = v.looked_up(pa.array(some))
    assert [(int(c), float(p), bool(r)) for c, p, r in zip(*got)] == [v[w] for w in some] and [len(x) for x in v.looked_up(pa.array([], pa.string()))] == [0, 0, 0]


def test_shuffled_words_score_lower(docs):
    v = pseudo_likelihood.vocabulary(docs)
    log = pseudo_likelihood.train(pseudo_likelihood.context_counts(docs, v))
    assert np.allclose(np.exp(log).sum(2), 1)
    flat = np.log(np.full(pseudo_likelihood.CLASSES, 1 / pseudo_likelihood.CLASSES))
    counts = pseudo_likelihood.context_counts(docs, v)
    assert (counts * log.transpose(0, 2, 1)).sum() > counts.sum() * flat[0]


def test_pipeline_stage_by_stage(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng, data = np.random.default_rng(4), []
    item = [f"s{i}" for i in range(39)]
    for i in range(12):
        w = [f"d{i}x{k}" for k in range(40)]
        data += [(10 * i + 1, " ".join(w), "ab"[i % 2]), (10 * i + 2, " ".join(changed(rng, w, 3)), "a"), (10 * i + 3, " ".join(w), None)]
    data += [(501, "few words", "a"), (502, None, "a"), (503, "", None), (504, "r s t u v " * 9, "b"), (601, " ".join(item[:-1]), "a"), (602, "x y " + " ".join(item) + " " + " ".join(f"z{i}" for i in range(30)), "b"),
             (701, "a <|endoftext|> b " + " ".join(f"e{i}" for i in range(20)), "a")]
    spark.createDataFrame([(i, t, "en", c) for i, t, c in data], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    note = lambda stage: lambda s, d, f: seen.append(sorted(texts(d))) or stage(s, d, f)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, note(stage)) for n, stage in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path))
    # Quality: the groups are too small for the estimate, so the base rule only.
    want = [(i, t) for i, t, _ in data if t and len(t.split()) >= 10 and i != 504]
    assert seen[1] == sorted(want)
    left = []
    for i, t in sorted(want):
        w = t.split()
        if not any(edit_distance(w, x.split()) <= int(0.2 * max(len(w), len(x.split())) + 1e-9) for _, x in left):
            left.append((i, t))
    assert seen[2] == left and len(left) < len(want)
    left = [x for x in left if x[0] not in (601, 602)]
    assert seen[3] == left
    assert set(seen[4]) <= set(left) and max(Counter(seen[4]).values()) <= 3
    tok, ids, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i, t in seen[4]:
        x = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        ids.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert listed(out, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(ids, key=repr)


@pytest.mark.parametrize("name", ["op3_substrings", "op9_warc", "op10_mix", "op13_resample"])
def test_against_sql(spark, name):
    from attesta.llm.queries import ORACLES, QUERIES
    from checks.compare import connect, rows_of

    mine, theirs = QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows_of(mine) == rows_of(theirs)
