"""Token counts, centroid clustering and importance resampling against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from cairn.llm import html_extraction, importance, line_dedup, mixing, prefix_crc, shallot, token_counts, url_filters

BIG = (1 << 60) + 1
CLASHES = "doc_id long, text string, n_bytes string, row string, n string, weight string, score string, key string, at string, vector string, tail string, `odd name` map<string,int>"


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßあ漢,.<") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 19, 20, 21, 400, 9000)]
    odd = [None, "", " ", "  ", "\n", "\n ", " \n\n  x", "a\nb", "a  b   c", "<s>x</s> <unk> ▁y ▁▁z", "\x00\x01\x7f", " é 　 x\ty\r\nz", "😀😀 😀", "Ab1 AB1 ab1"]
    long = ["".join(rng.choice("abcあ漢字ñ") for _ in range(30_000)), "x" * 50_000, "=" * 3000, " " * 999, "na " * 20_000]
    return [*odd, *prose, *prose[:3], *long]


def docs_of(spark, found, first=0):
    rows = [(first + i, t, "c", "c", "c", "c", "c", "c", "c", "c", "c", {"k": i}) for i, t in enumerate(found)]
    return spark.createDataFrame([*rows, (None, "null id", *["c"] * 9, None), (BIG, "large id", *["c"] * 9, {})], CLASHES).repartition(3)


ALL = [*((i, t) for i, t in enumerate(texts())), (None, "null id"), (BIG, "large id")]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, texts()).cache()


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path(token_counts.MODEL), "rb") as file:
        return file.read()


# 11


def test_pretokens_are_cut_as_in_whole_texts(model):
    library, cutter = sentencepiece.SentencePieceProcessor(model_proto=model), token_counts.PreTokens(model)
    rng = random.Random(3)
    signs = ["a", "e", "in", " ", "  ", "\n", "▁", "é", "漢", ",", "<s>", "\t", "\x00", "the", "😀", "==", "0x0A"]
    for n in [*range(1, 40)] * 40:
        text = "".join(rng.choice(signs) for _ in range(n))
        found = cutter.cut(text)
        assert "".join(found) == " " + text
        assert sum(cutter.sizes(found)) == len(library.encode(text)), text
        fine = [y for x in found for y in cutter.fine(x)]
        assert sum(cutter.sizes(fine)) == len(library.encode(text)), text


@pytest.mark.parametrize("head", [1 << 18, 200, 0])
def test_token_counts(docs, model, head):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = token_counts.count_tokens(docs, model, limit=100, head=head)
    assert found.columns == ["doc_id", "row", "n", "weight", "score", "key", "at", "vector", "tail", "odd name", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((repr(i), len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in ALL)
    rows = found.collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == want
    assert all(r["row"] == "c" and (r["doc_id"] in (None, BIG) or r["odd name"] == {"k": r["doc_id"]}) for r in rows)


def test_token_counts_of_an_empty_table(spark, model):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_held_pretokens_are_bounded(docs, model, monkeypatch):
    want = {r["pretoken"]: (r["n"], r["pieces"]) for r in token_counts.vocabulary(docs, model).collect()}
    monkeypatch.setattr(token_counts, "HELD", 10)
    parts = docs.select("text").repartition(1).mapInArrow(token_counts._distinct(docs.sparkSession.sparkContext.broadcast(model)), "pretoken string, n long").collect()
    total = Counter()
    for r in parts:
        total[r["pretoken"]] += r["n"]
    assert dict(total) == {k: n for k, (n, _) in want.items()}


# 12


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * float(np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], dtype="<i4").tobytes()))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    at = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in at:
        sums[j] += d
    return sorted((repr(i), j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in at)


def vector_rows(rng, n, dims, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(40)]  # repeated vectors, so that centroids can be equal
    rows += [(5, rows[0][1]), (5, rows[1][1]), (None, rows[7][1]), (None, rows[8][1]), (BIG, rows[9][1])]
    return [*rows, (n + 50, None), (n + 51, []), (n + 52, [1.0] * (dims - 1)), (n + 53, [None] + [1.0] * (dims - 1)), (n + 54, [math.nan] + [1.0] * (dims - 1)), (n + 55, [math.inf] * dims), (n + 56, [-30000.0] * dims)]


@pytest.mark.parametrize(("k", "rounds", "dims", "spread"), [(16, 3, 8, 0.05), (16, 6, 8, 0.4), (5, 4, 2, 0.3), (1, 2, 4, 0.2), (40, 5, 3, 0.3), (16, 0, 6, 0.3)])
def test_clusters(spark, k, rounds, dims, spread):
    rows = vector_rows(random.Random(k), 400, dims, spread)
    vectors = spark.createDataFrame([(i, v, "c", "c") for i, v in rows], "vec_id long, embedding array<double>, near string, cluster string").repartition(3)
    found = shallot.cluster(vectors, clusters=k, rounds=rounds, dims=dims)
    assert found.columns == ["vec_id", "near", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((repr(r["vec_id"]), *r[2:]) for r in found.collect()) == brute_clusters(rows, k, rounds, dims)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5, 0.25]), (2, [0.1, -0.1]), (3, [0.1, -0.1])]
    found = shallot.cluster(spark.createDataFrame(rows, schema), dims=2)
    assert sorted((repr(r["vec_id"]), *r[1:]) for r in found.collect()) == brute_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 16, 3, 2)
    none = shallot.cluster(spark.createDataFrame([(1, None)], schema), dims=2)
    assert none.collect() == [] and none.columns == found.columns


def test_a_component_beyond_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        shallot.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    middles = rng.integers(-2000, 2000, (64, 8))
    v = middles[rng.integers(0, 64, 5000)] + rng.integers(-50, 50, (5000, 8))
    near, other, upper, lower = np.zeros(5000, np.int32), np.zeros(5000, np.int32), np.zeros(5000), np.zeros(5000)
    before, centroids = None, v[:64].copy()
    for t in range(6):
        taken = shallot.Search(centroids, before).assign(v, near, other, upper, lower)
        whole = np.stack([shallot.squared(v, c) for c in centroids], axis=1)
        assert (near == whole.argmin(axis=1)).all()  # the first of equals
        assert taken < (64 if t == 0 else 20) * 5000
        before, centroids = centroids, np.stack([v[near == j].sum(axis=0) // max(1, (near == j).sum()) if (near == j).any() else centroids[j] for j in range(64)])


# 13


def test_crc_of_spans():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000, 70_000):
        data = rng.integers(0, 256, size).astype(np.uint8)
        running = prefix_crc.PrefixCrc(data)
        first = rng.integers(0, size + 1, 300)
        last = np.array([rng.integers(a, size + 1) for a in first])
        assert running.spans(first, last).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(first, last, strict=True)]


def brute_resample(rows, target, ngram, buckets, percent, least):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    of = [(i, *grams(t)) for i, t in rows]
    source, wanted = Counter(b for _, _, f in of for b in f), Counter(b for t in target for b in grams(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (t * 0 + s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for i, n, f in of:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    ahead = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, [(r[0], r[4]) for r in ahead[: percent * len(ahead) // 100]]


@pytest.mark.parametrize(("ngram", "percent", "least"), [(1, 10, 20), (1, 50, 1), (3, 100, 2), (2, 0, 20)])
def test_resample(spark, docs, ngram, percent, least):
    target = spark.createDataFrame([(t,) for t in [texts()[15], texts()[18], None, ""]], "text string")
    found = importance.resample(docs, target, ngram=ngram, buckets=1000, percent=percent, least_words=least)
    assert found.columns == [c for c in docs.columns if c not in ("text", "weight", "score")] + ["n_features", "weight", "score", "rank"]
    rows = found.collect()
    out, drawn = brute_resample(ALL, [texts()[15], texts()[18], None, ""], ngram, 1000, percent, least)
    assert sorted((repr(r["doc_id"]), r["n_features"], r["weight"], r["score"]) for r in rows) == sorted((repr(i), n, w, s) for i, _, n, w, s in out)
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in rows if r["rank"]) == [*range(1, len(drawn) + 1)]


def test_repeated_rows_have_ranks_of_their_own(spark):
    same = spark.createDataFrame([(7, "one two three")] * 40 + [(None, "one two three")] * 40, "doc_id long, text string").repartition(4)
    rows = importance.resample(same, same.limit(1).select("text"), percent=75, least_words=3).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [*range(1, 61)]


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["weight"], r["rank"]) for r in importance.resample(some, none, percent=100, least_words=1).collect()}.keys() == {1, 2}


# Columns that operators carry, beside nulls and names of their own


def test_large_ids_stay_beside_nulls(spark):
    pages = spark.createDataFrame([(BIG, "http://a.b/", "<p>some text here</p>"), (None, "http://a.b/x", None)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html_extraction.extract_pages(pages).collect()} == {BIG, None}
    rows = [(BIG, "good words here", BIG + 2), (None, "bad words there", None), (3, None, BIG + 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1)
    labels = spark.createDataFrame([(BIG, "clean"), (3, "low")], "doc_id long, domain string")
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in mixing.mix(docs, labels).collect()} == set(rows)


def test_one_id_with_two_texts_in_the_join_stage(spark):
    rng = random.Random(4)
    a, b = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(2))
    docs = spark.createDataFrame([(1, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, "").collect()) == [(1, a), (5, b)]


def test_clashing_columns(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, line, "a", "b", "c", "d", {"k": 1}), (2, "x\n" + line, "a", "b", "c", "d", None)], "doc_id long, text string, __hash string, __pos string, __text string, __doc_id string, m map<string,int>")
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "removed_lines"]
    assert sorted((r["text"], r["__hash"], r["__pos"], r["removed_lines"]) for r in found.collect()) == [(line, "a", "b", 0), ("x", "a", "b", 1)]
    deep = ".".join(["l"] * 20_000)
    pages = spark.createDataFrame([("http://x.com/en/1", "k", "h", {"m": 1}), (None, "k", "h", None), (f"http://{deep}.example.net/de/8", "k", "h", {})], "url string, __key string, __host string, tags map<string,int>")
    found = url_filters.filter_urls(pages, url_filters.rules_table(spark))
    assert found.columns == ["url", "__key", "__host", "tags", "host", "path", "rule", "verdict"]
    assert sorted((r["rule"] or "", r["verdict"], r["__key"], r["__host"], r["tags"] is None) for r in found.collect()) == [("", "allow", "k", "h", True), ("com/en/", "block", "k", "h", False), ("example.net/de/8", "block", "k", "h", False)]


@pytest.mark.parametrize("part", ["h2 id='discussion'", "h3 id='comments'", "section id='navigation'", "section id='menu'", "section id='discussion'"])
def test_sections_and_headings_with_ids_stay(part):
    tag = part.split()[0]
    page = f"<body><nav>n</nav><article><p>First part of the text.</p><{part}>What it is about</{tag}><section id='comments'><p>reader</p></section><div id='comments'><p>reader</p></div></article><footer>f</footer></body>"
    assert html_extraction.extract(page) == "First part of the text.\nWhat it is about"


def test_a_story_beside_teasers():
    page = "<body><article><p>Teaser one.</p></article><div class='story'><p>A long story that is told here.</p><p>And goes on for a while.</p></div><article><p>Teaser two.</p></article></body>"
    assert html_extraction.extract(page) == "A long story that is told here.\nAnd goes on for a while."
    page = "<body><article><p>The article itself has most of the text of the page.</p></article><div class='content'><p>Short.</p></div></body>"
    assert html_extraction.extract(page) == "The article itself has most of the text of the page."
