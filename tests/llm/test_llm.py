"""Operators of the subpackage against brute force, with awkward rows: nulls, blanks, long texts, repeats, empty tables."""

import hashlib
import html
import itertools
import json
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import (
    chunks,
    components,
    html_extraction,
    kneser_ney,
    line_dedup,
    lm_scoring,
    media,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fail_bits string, p string, bucket string"


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


VOCABULARY = vocabulary(400)


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward_texts():
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + [f"edit{i}"] + words[i + 1 :]) for i in (3, 30, 60, 90)]
    passage = prose(rng, 60)
    texts = [None, "", "  \n\t ", "one", "one", "four words only here", "Four Words ONLY here", "a b c d e", base, base, *near, base.upper()]
    texts += ["\n".join([prose(rng, 12), passage, prose(rng, 9)]) for _ in range(4)]
    texts += ["\n".join([prose(rng, 5), prose(rng, 20)]), "x " * 3000, prose(rng, 4000), "!! ### " * 40, "É\u00a0è\u2003\x1c\x85 ü " * 9, "dup dup dup dup dup dup dup dup dup dup dup"]
    texts += ["\n".join(["same line of text here"] * 9 + [prose(rng, 30)]), "\n\n" + passage + "\n\n", passage[: len(passage) // 2]]
    return texts


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", 0, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, awkward_texts()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ws(text):
    return (text or "").encode().translate(None, b"").split()


# 1


def brute_rules(text):
    w = ws(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if ws(x)]
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    for i, t in enumerate(awkward_texts()):
        r, want = got[i], brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (r["fail_bits"] == 0)
    assert quality_rules.ledger(empty).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_ablation_matches_direct_counts(docs):
    ledger = quality_rules.ledger(docs)
    bits = [r["fail_bits"] for r in ledger.collect()]
    for r in quality_rules.ablation(ledger).collect():
        bit = quality_rules.BIT[r["rule"]]
        assert (r["n_failed"], r["n_only"], r["n_kept"], r["n_kept_without"]) == (sum(b & bit > 0 for b in bits), bits.count(bit), bits.count(0), sum(b & ~bit == 0 for b in bits))
    soft = quality_rules.Policy("soft", 0, quality_rules.BIT["symbols"] | quality_rules.BIT["shouting"], 2)
    assert quality_rules.apply_policy(ledger, soft).where("not kept and not base_failed").count() == sum(b & 12 == 12 and not b & 3 for b in bits)


# 2


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_ngram_join(docs, empty, spark):
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    assert got == brute_components(awkward_texts())
    assert ngram_join.jaccard_components(empty).count() == 0
    repeated = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[2] or 0) for r in ngram_join.jaccard_components(repeated).collect()) == [(0, 0), (2, 2), (5, 2), (5, 2)]


def test_ngram_join_near_group(spark):
    """A group in which not all pairs link, only chains of them."""
    rng, texts = random.Random(3), []
    words = [rng.choice(VOCABULARY) for _ in range(150)]
    for _ in range(60):
        w = list(words)
        for i in rng.sample(range(150), rng.randint(0, 7)):
            w[i] = f"new{rng.random()}"
        texts.append(" ".join(w))
    texts += [prose(rng, 60) for _ in range(20)]
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs_of(spark, texts)).collect())
    assert got == brute_components(texts)


def test_ngram_join_in_slices(spark, monkeypatch):
    """Texts that share columns but mostly don't link: star rounds don't help, so the product is made in slices."""
    monkeypatch.setattr(ngram_join, "WORK_PER_ROW", 0.2)
    monkeypatch.setattr(ngram_join, "HELP", 0)
    product, made = ngram_join.product_pairs, []
    monkeypatch.setattr(ngram_join, "product_pairs", lambda *a: made.append(a[3:]) or product(*a))
    rng = random.Random(5)
    blocks = [" ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 99)) for _ in range(25)) for _ in range(9)]
    texts = [" ".join(blocks[b] for b in sorted(rng.sample(range(9), rng.choice([6, 7, 8])))) + f" own{i % 20}" for i in range(40)]
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs_of(spark, texts)).collect())
    assert got == brute_components(texts)
    assert len({c for _, _, c in got}) > 1 and len(made) > 1 and made == [(len(made), i) for i in range(len(made))]


def test_slices_of_a_small_index():
    """185,029 rows and 9,401,794 pairs, as check_h has them, were seven slices; a large index has no more pairs a slice than before."""
    assert ngram_join.slices_of(9_401_794, 185_029) == 1
    assert ngram_join.slices_of(80_000_000, 1000) == 1250
    assert ngram_join.slices_of(800_000_000, 10_000_000) == 10 and ngram_join.slices_of(0, 0) == 1


def test_small_tables_have_few_files(spark):
    """However many partitions a shuffle has, and AQE does not merge them, components are in as many files as their rows ask for."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components.components(spark.range(300).selectExpr("id - id % 3 as a", "id as b"))
        assert len(found.inputFiles()) <= 4
        assert sorted(map(tuple, found.select("node", "component").collect())) == [(i, i - i % 3) for i in range(300)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_product_slices(spark):
    """All slices together give the pairs of the whole product."""
    rows = spark.createDataFrame([(t, k, 10, 1 + k % 3, k % 4) for t in range(3) for k in range(12) if (k + t) % 3], "token long, key long, n long, at long, component long")
    columns = ngram_join.split_columns(rows)
    whole = {tuple(r) for r in ngram_join.product_pairs(rows, columns, 75).collect()}
    parts = [{tuple(r) for r in ngram_join.product_pairs(rows, columns, 75, 3, i).collect()} for i in range(3)]
    assert whole and set().union(*parts) == whole and max(map(len, parts)) < len(whole)


def test_shared_columns(spark):
    """A column of one class, though in two tasks, goes; one that two classes have stays, with its known rows."""
    rows = [(1, 5, 9, 1, 0, False), (1, 5, 9, 1, 0, False), (2, 5, 9, 2, 0, False), (2, 6, 9, 1, 0, False), (3, 5, 9, 3, 0, True), (3, 7, 9, 1, 8, True), (3, 8, 9, 1, 0, False), (4, 8, 9, 2, 0, False)]
    found = ngram_join.shared_columns(spark.createDataFrame(rows, "token long, key long, n long, at long, salt int, shared boolean"))
    assert sorted((r["token"], r["key"]) for r in found.collect()) == [(2, 5), (2, 6), (3, 5), (3, 7), (3, 8)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


# 3

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><header>Site head</header><div class="cookie-notice">We use cookies</div>
<div class=sidebar>Side</div><article><header><h1>Ti&amp;tle</h1></header><p><b>First &lt;block&gt;<br>goes
 on.<p>Second&nbsp;one.<div class="ad">Buy</div><form><input value=x>Name</form><ul><li>i1<li>i2</ul><!-- note --><blockquote>Quote</blockquote>
<section class="comments"><p>Nice post</p></section></article><aside>More</aside><footer>&copy; site</footer>"""


def test_html_extraction(spark):
    assert html_extraction.extract(PAGE) == "Ti&tle\nFirst <block> goes on.\nSecond one.\ni1\ni2\nQuote"
    for odd in (None, "", "<", "<p", "plain text", "<div>" * 3000 + "deep", "<a href='x", "</p></div>", "<article></article>", "&#xZZ; &amp"):
        assert isinstance(html_extraction.extract(odd), str)
    assert html_extraction.extract("<div>" * 3000 + "deep") == "deep" and html_extraction.extract("plain text") == "plain text"
    rng = random.Random(5)
    body = lambda: (prose(rng, 40), prose(rng, 30))
    rows, want = [], {}
    for i in range(40):
        a, b = body()
        rows.append((i, f"http://h.example.com/{i}", f"<html><body><div><p>{a}</p><div><em>Read more on our site</em></div><p>{b}</p></div><nav>n</nav></body></html>"))
        want[i] = f"{a}\n{b}"
    rows += [(100, None, None), (101, "http://other.example/", "<article><p>Alone</p></article>"), (102, "x", "")]
    want |= {100: "", 101: "Alone", 102: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extraction.extract_pages(df.withColumn("text", F.lit("clash"))).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extraction.extract_pages(df.limit(0)).count() == 0


def test_article_is_whole():
    rng = random.Random(6)
    for _ in range(30):
        parts = [prose(rng, rng.randint(1, 30)) + " & <x> " for _ in range(rng.randint(1, 9))]
        page = "<html><body><nav><a>x</a></nav><article>" + "".join(f"<p>{html.escape(p)}</p>" for p in parts) + "</article><footer>f</footer></body></html>"
        assert html_extraction.extract(page) == "\n".join(" ".join(p.split()) for p in parts)


@pytest.mark.parametrize(
    "wrapper",
    ["div class='page has-sidebar'", "div class='with-header'", "div id='nav-layout'", "section class='related-work'", "section class='discussion'", "div class='page sidebar'", "form action='/'", "form><div class='widget'"],
)
def test_wrapper_is_not_boilerplate(wrapper):
    end = "".join(f"</{w.split()[0].split('>')[0]}>" for w in reversed(wrapper.replace("><", ">|<").split("|<")))
    inside = f"<html><body><nav>n</nav><{wrapper}><{{0}}><p>Some text of its own.</p></{{0}}><aside>a</aside>{end}<div class='site-header'>h</div><div class='cookie-banner'>c</div></body></html>"
    for tag in ("article", "main"):
        assert html_extraction.extract(inside.format(tag)) == "Some text of its own."
    if "form" not in wrapper:
        assert html_extraction.extract(inside.format("div")) == "Some text of its own."


def test_sections_of_an_article_and_boilerplate_beside_it():
    page = "<article><p>One.</p><section class='related-work'><p>Two.</p></section><section class='discussion'><p>Three.</p></section><div class='comment-list'><p>c</p></div></article>"
    assert html_extraction.extract(page + "<div class='sidebar'><article>teaser</article></div>") == "One.\nTwo.\nThree."


def test_simple_tree_matching():
    leaf = lambda n, *c: [n, list(c), [], False, False, []]
    a = leaf("r", leaf("x", leaf("p")), leaf("y"), leaf("z"))
    b = leaf("r", leaf("y"), leaf("x", leaf("p"), leaf("q")), leaf("z"))
    assert html_extraction.simple_tree_matching(a, b) == 4 and html_extraction.simple_tree_matching(a, leaf("s")) == 0


def brute_matching(a, b):
    """Simple tree matching by its definition: a quadratic programme over the children."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + brute_matching(x, y))
    return 1 + best[-1][-1]


def test_simple_tree_matching_is_the_definition():
    rng = random.Random(4)

    def tree(depth):
        return [rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []]

    def contains(pairs, a, b):
        return all(x[0] == y[0] for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)

    for _ in range(200):
        a, b = ["r", [tree(3) for _ in range(3)]], ["r", [tree(3) for _ in range(3)]]
        pairs: list = []
        assert html_extraction.simple_tree_matching(a, b, pairs) == brute_matching(a, b) == len(pairs) and contains(pairs, a, b)


def host_pages(spark, page, n=40, seed=15):
    rng = random.Random(seed)
    texts = [(prose(rng, 40), prose(rng, 30)) for _ in range(n)]
    df = spark.createDataFrame([(i, f"http://w.example.com/{i}", page(i, *t)) for i, t in enumerate(texts)], "page_id long, url string, html string")
    return texts, {r["page_id"]: r["text"] for r in html_extraction.extract_pages(df).collect()}


def test_wrapper_without_names(spark):
    """Nothing in the markup says what is what: alignment alone takes the menu, the box, the notice beside the text and the end away."""
    page = lambda i, a, b: (
        "<div class=k1><div class=q><a>Home</a> <a>News</a></div><div class=r>Today only: buy two</div></div>"
        f"<div class=k2><p>{a}</p><p>Sign up for our letter</p><p>{b}</p></div><div class=k3><p>All rights of the site</p></div>"
    )
    texts, got = host_pages(spark, page)
    assert got == {i: f"{a}\n{b}" for i, (a, b) in enumerate(texts)}
    assert html_extraction.extract(page(0, *texts[0])) != got[0]  # one page alone can't tell


def test_second_layout_and_varying_boxes(spark):
    """The region is where most varying text is over the host; pages that lack it are read by their own."""
    page = lambda i, a, b: (
        f"<div class=z1><div>Visitor {i}</div><div>of today</div></div><div class=z2><h2>{a[:20]}</h2><div><p>{a}</p><p>{b}</p></div></div>" if i % 4 else f"<main><p>{a}</p></main><div class=z1><div>Visitor {i}</div></div>"
    )
    texts, got = host_pages(spark, page)
    assert all(got[i] == (f"{a}\n{b}" if i % 4 else a) for i, (a, b) in enumerate(texts))


def test_articles_that_the_reference_lacks(spark):
    """A part of a page that no slot of the reference matches is read, once, and template beside it still goes."""
    extra = lambda i, b: f"<article class='part-{i}'><p>{b}</p></article>" if i % 5 == 0 else ""
    page = lambda i, a, b: f"<body><article><p>{a}</p><p>Copyright of the house</p></article>{extra(i, b)}<div>end</div></body>"
    texts, got = host_pages(spark, page)
    assert got == {i: f"{a}\n{b}" if i % 5 == 0 else a for i, (a, b) in enumerate(texts)}


@pytest.mark.parametrize("part", ["section class='social-policy'", "p id='notice-period'", "div class='ad-hoc-methods'"])
def test_content_with_listed_words_stays(spark, part):
    tag = part.split()[0]
    page = lambda i, a, b: f"<body><nav>n {i}</nav><article><p>{a}</p><{part}>{b}</{tag}></article><footer>f {i}</footer></body>"
    texts, got = host_pages(spark, page, 12)
    assert got == {i: f"{a}\n{b}" for i, (a, b) in enumerate(texts)}


def test_long_pages_take_seconds():
    rng = random.Random(17)
    parts = [prose(rng, 12) for _ in range(36_000)]
    mixed_page = "<html><body><nav><a>m</a></nav><article>" + "".join(f"<h2>{p}</h2><p>{p}</p><div class='c{i}'><p>{p}</p></div>" if i % 9 == 0 else f"<p>{p}</p>" for i, p in enumerate(parts)) + "</article></body></html>"
    assert len(mixed_page) > 2_500_000
    began = time.perf_counter()
    root = html_extraction.page_tree(mixed_page)
    slots = html_extraction.slots_of(root)
    wrapper = html_extraction.Wrapper(json.dumps(html_extraction.outline(slots)), {}, set())
    assert len(wrapper.blocks(root)) > 36_000 and len(html_extraction.extract(mixed_page).split("\n")) > 36_000
    assert time.perf_counter() - began < 60


def test_pages_without_id_or_html(spark):
    df = spark.createDataFrame([(None, "http://a.b/", "<p>x</p>"), (None, None, None), (3, "http://a.b/", None)], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_extraction.extract_pages(df).collect()) == [(0, ""), (0, "x"), (3, "")]


# 4


def check_scores(spark, texts, got):
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens, r = [*(t or "").encode().lower().split(), "end"], got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), rel=1e-9)
        assert r["score"] < 0


def test_lm_scoring(spark, docs, empty, monkeypatch):
    texts = awkward_texts()
    check_scores(spark, texts, {r["doc_id"]: r for r in lm_scoring.score_held_out(docs).collect()})
    monkeypatch.setattr(lm_scoring, "HEAD", 30)  # most words go through the join
    monkeypatch.setattr(lm_scoring, "TOKENS_PER_SHARD", 500)
    check_scores(spark, texts, {r["doc_id"]: r for r in lm_scoring.score_held_out(docs).collect()})
    monkeypatch.setattr(lm_scoring, "MAX_BITS", 1 << 13)  # far too small for these texts: the lowest levels stay out
    check_scores(spark, texts, {r["doc_id"]: r for r in lm_scoring.score_held_out(docs).collect()})
    assert lm_scoring.score_held_out(empty).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in lm_scoring.score_held_out(none).collect()) == [1, 3]


def quantised(c):
    """Lower and upper end of a count's level."""
    level = int(lm_scoring.level_of(np.array([c]))[0]) if c else 0
    return (math.ceil(1.5 ** (level - 1) - 1e-9), math.ceil(1.5**level - 1e-9) - 1) if c else (0, 0)


def test_lm_scoring_is_the_same_at_any_size_of_filter_and_head(spark, monkeypatch):
    """Brute force with exact counts, for a filter so sparse that it has no false positives; whatever its size, no level stays out."""
    monkeypatch.setattr(lm_scoring, "SLICE_FILL", 1e-3)
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 60)) + f" once{i} once{i}b" for i in range(250)]
    texts += texts[:20] + [None, "", "one"]
    words, pairs, triples = Counter(), Counter(), Counter()
    split = lambda t: ["start", *(t or "").split(), "end"]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = split(t)
            words.update(w[1:])
            pairs.update(itertools.pairwise(w))
            triples.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(words.values()), len(words)
    want = []
    for t in texts:
        total, w = 0.0, split(t)
        above = lambda x: words["end"] if x == "start" else words[x]
        for i in range(1, len(w)):
            low = lambda a, b: min(quantised(pairs[a, b])[0], above(a), words[b])
            p = (low(w[i - 1], w[i]) + 100 * (words[w[i]] + 1) / (n + v + 1)) / (above(w[i - 1]) + 100)
            if i > 1:
                context = min(quantised(pairs[w[i - 2], w[i - 1]])[1], above(w[i - 2]), words[w[i - 1]])
                count = min(quantised(triples[w[i - 2], w[i - 1], w[i]])[0], low(w[i - 2], w[i - 1]), low(w[i - 1], w[i]))
                p = (count + 10 * p) / (context + 10)
            total += math.log10(p)
        want.append(total)
    for head, shards, chunk in ((1 << 20, 1 << 20, 12 << 20), (0, 300, 2000), (30, 2000, 1)):
        for name, value in (("HEAD", head), ("TOKENS_PER_SHARD", shards), ("CHUNK_BYTES", chunk)):
            monkeypatch.setattr(lm_scoring, name, value)
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score_held_out(docs_of(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_lm_scores_tell_repeated_texts(spark):
    """Texts that occur twice score higher for each token than those that occur once."""
    rng = random.Random(13)
    texts = [prose(rng, 80) for _ in range(300)]
    texts += texts[:100]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.score_held_out(docs_of(spark, texts)).collect() if not r["held_out"]}
    once = sorted(got[i] for i in range(100, 300) if i in got)
    twice = [got[i] for i in range(100) if i in got and i + 300 in got]
    assert np.mean([x > once[int(0.9 * len(once))] for x in twice]) > 0.9


def test_packed_keys():
    rng = np.random.default_rng(5)
    for top, n in ((1 << 28, 20_000), (1 << 28, 3), (1 << 28, 1), (300, 200), (1 << 32, 50), (1 << 17, 2), (65536, 2), (65535 * 3 + 1, 1)):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        for these in (keys, np.append(keys[keys < top - 1], np.uint64(top - 1)), np.array([0, 65535, 131070, 131071], dtype=np.uint64)):
            assert (chunks.unpacked(chunks.packed(these)) == these).all()
    for top in (3, 40, 5000, 1 << 20):
        keys = np.unique(rng.integers(0, 1 << 40, 3000, dtype=np.uint64))
        shards = keys % np.uint64(1) if top == 3 else keys >> np.uint64(40 - top.bit_length())
        found = np.append(np.unique(shards), np.uint64(1 << 41))  # the last one has no keys
        ends = chunks.edges_of(shards, found)
        parts = [keys[a:b] & np.uint64((1 << 28) - 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        parts = [np.sort(p) for p in parts]
        packed = chunks.packed_parts(np.concatenate(parts), ends).to_pylist()
        assert len(packed) == len(found) and all((chunks.unpacked(x) == p).all() for x, p in zip(packed, parts, strict=True))
        assert chunks.cut(keys, ends).to_pylist() == [keys[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert chunks.cut(np.arange(5), np.array([1, 3, 3, 4])).to_pylist() == [np.arange(1, 3).tobytes(), b"", np.arange(3, 4).tobytes()]


def test_filter_counts():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    counts = np.arange(1, 5001)
    flags = np.zeros(1 << 18, dtype=bool)
    lm_scoring.Filter(flags, 0, 1 << 18).add(flags, keys[:2500], lm_scoring.level_of(counts[:2500]))
    read = lm_scoring.Filter(np.packbits(flags), 0, 1 << 18).counts(keys)
    assert (read[:2500] * lm_scoring.LEVEL_BASE + 1 >= counts[:2500]).all()  # never below its own level
    assert (read[2500:] > 0).mean() < 0.2


@pytest.mark.parametrize("bits", [1 << 12, 1 << 14, 1 << 20])
def test_full_filter(bits):
    rng = np.random.default_rng(2)
    keys, levels = rng.integers(0, 2**63, 20_000, dtype=np.uint64), np.minimum(rng.geometric(0.3, 20_000), 12)
    first = lm_scoring.first_level(levels, bits)
    size = lambda f: lm_scoring.PROBES * int((levels - f + 1)[levels >= f].sum())
    assert size(first) <= lm_scoring.FILL * bits and (first == 1 or size(first - 1) > lm_scoring.FILL * bits)
    flags = np.zeros(bits, dtype=bool)
    lm_scoring.Filter(flags, 0, bits).add(flags, keys, levels, first)
    assert flags.mean() <= 0.63
    read = lm_scoring.Filter(np.packbits(flags), 0, bits, firsts=np.array([first])).counts(keys)
    assert (read[levels >= first] >= np.ceil(lm_scoring.LEVEL_BASE ** (levels[levels >= first] - 1.0) - 1e-9)).all()
    assert lm_scoring.first_level(np.zeros(0, dtype=np.int64), bits) == 1


# 5


def test_mixing(spark, empty):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(prose(rng, 40) + (" scum idiot trash moron" * 3 if bad else ""))
        labels.append((i, "toxic" if bad else "clean"))
    texts += [None, "", "   "]
    df, lab = docs_of(spark, texts), spark.createDataFrame(labels[:300], "doc_id long, domain string")
    got = {r["doc_id"]: r for r in mixing.mix(df, lab, {"clean": 0.95, "toxic": 0.05}).collect()}
    assert len(got) == 403 and all(0 <= r["rate"] <= mixing.MAX_RATE and abs(sum(r["p"].values()) - 1) < 1e-9 for r in got.values())
    truth = dict(labels)
    assert np.mean([(got[i]["p"]["toxic"] > 0.5) == (truth[i] == "toxic") for i in range(300, 400)]) > 0.95
    total = {d: sum(r["rate"] * r["n_tokens"] * r["p"][d] for r in got.values()) for d in ("clean", "toxic")}
    assert total["toxic"] / (total["clean"] + total["toxic"]) == pytest.approx(0.05, abs=0.02)
    assert {r["copies"] - math.floor(r["rate"]) for r in got.values()} <= {0, 1}
    no_labels = mixing.mix(df, lab.limit(0)).select("rate", "copies").distinct().collect()
    assert [tuple(r) for r in no_labels] == [(1.0, 1)]
    assert mixing.mix(empty, lab).count() == 0


def test_mixing_is_the_least_squares(spark, monkeypatch):
    """Rates against the same steps in numpy, and sums against plain projected gradient descent that runs long; overlapping domains."""
    monkeypatch.setattr(mixing, "TOLERANCE", 0.0)
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.6, 0.4, 0.3], 300)
    n = rng.integers(0, 200, 300)
    members = spark.createDataFrame([(int(i), int(n[i]), p[i].tolist()) for i in range(300)], "id long, n_tokens long, p array<double>")
    for shares, most in (([0.9, 0.08, 0.02], 4.0), ([0.5, 0.3, 0.2], 1.0), ([0.1, 0.1, 5.0], 1.5)):
        history, goal, reached = mixing.fit_rates(members, None, shares, 0, most)
        got = np.array([r["rate"] for r in members.select("id", mixing.rate_of(history, most).alias("rate")).orderBy("id").collect()])
        at_one = (n[:, None] * p).sum(axis=0)
        assert goal == pytest.approx((np.array(shares) / shares[0] * at_one[0]).tolist())
        pull = np.minimum(goal, most * at_one)
        total = lambda r: (n[:, None] * p * r[:, None]).sum(axis=0)
        r = y = np.ones(300)
        for t in range(mixing.ITERATIONS):
            new = np.clip(y - p @ ((total(y) - pull) / at_one), 0, most)
            y, r = new + t / (t + 3) * (new - r), new
        assert got == pytest.approx(r, abs=1e-9) and reached == pytest.approx(total(r).tolist())
        plain = np.ones(300)
        for _ in range(5000):
            plain = np.clip(plain - p @ ((total(plain) - pull) / at_one), 0, most)
        loss = lambda r: (((total(r) - pull) ** 2) / at_one).sum()
        assert loss(got) <= loss(plain) * 1.02 + 1e-3 * at_one.sum()


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b c"), (1, "a b c"), (2, "x y"), (3, "z " * 30_000)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, "clean"), (2, "toxic"), (None, "clean"), (3, None)], "doc_id long, domain string")
    got = mixing.mix(df, lab).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 2, 2, 3, 3, 30_000] and len({r["rate"] for r in got if r["doc_id"] == 1}) == 1
    assert all(set(r["target_tokens"]) == set(r["reached_tokens"]) == {"clean", "toxic"} for r in got)


# 6


def test_media_round_trip(docs, empty, spark):
    got = {r["doc_id"]: r for r in media.digests(media.to_media(docs)).collect()}
    full = {r["doc_id"]: r for r in media.from_media(media.to_media(docs)).collect()}
    for i, t in enumerate(awkward_texts()):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert bytes(full[i]["payload"]) == payload and len(full[i]["rgb"]) == full[i]["height"] * full[i]["width"] * 3
    assert got[3]["feature"] == got[4]["feature"] and got[3]["media_sha256"] == got[4]["media_sha256"]
    assert media.digests(media.to_media(empty)).count() == 0


def test_media_tables(spark, tmp_path):
    """Files and tensors written, read back and compared with the definition of the inverse transform; null ids, equal texts, a long one."""
    texts = ["equal text", "equal text", None, "long " * 40_000, ""]
    df = spark.createDataFrame([(None if i == 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    media.to_media(df).write.parquet(f"{tmp_path}/media")
    media.from_media(spark.read.parquet(f"{tmp_path}/media")).write.parquet(f"{tmp_path}/rgb")
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/rgb").collect()}
    assert set(got) == {0, 1, None, 3, 4} and got[0]["rgb"] == got[1]["rgb"] and bytes(got[None]["payload"]) == bytes(64)
    assert bytes(got[3]["payload"]).rstrip(b"\0") == texts[3].encode()
    found = {r["doc_id"]: r["feature"] for r in media.digests(spark.read.parquet(f"{tmp_path}/media")).collect()}
    for i, r in got.items():
        rgb = np.frombuffer(r["rgb"], dtype=np.uint8).reshape(r["height"], r["width"], 3)
        sums = ",".join(str(int(rgb[..., c].astype(int).sum())) for c in range(3))
        assert found[i] == f"{r['height']}x{r['width']}:{sums}:{zlib.crc32(r['rgb']):08x}"


def test_slow_and_fast_decoding_agree():
    data = random.Random(2).randbytes(64 * 37)
    stored = media.store(data)
    fast, slow = media.Image(stored), media.Image(stored, fast=False)
    assert all((a["coefs"] == b["coefs"]).all() for a, b in zip(fast.parts, slow.parts, strict=True)) and slow.payload() == data


def test_inverse_transform_is_the_definition():
    image = media.Image(media.store(random.Random(3).randbytes(64 * 6)))
    c = np.zeros((8, 8))
    c.reshape(-1)[media.ZIGZAG] = image.parts[0]["coefs"][1]
    at = lambda k: math.sqrt(1 / 8) if k == 0 else 0.5
    want = [[sum(at(u) * at(v) * c[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.abs(np.array(want) - image.plane(image.parts[0])[:8, 8:16]).max() < 1e-3


def test_zero_runs_and_end_of_band_runs():
    """A hand-made grey image of two blocks: runs of zeros, an end of band run over both, and a refinement that adds one."""
    table = media._segment(0xC4, media._huffman(0, 0, [(2, 0), (2, 3)]) + media._huffman(1, 0, [(2, 0x21), (2, 0x10), (2, 0x01)]))
    bits = lambda s: np.packbits([int(b) for b in s + "1" * (-len(s) % 8)]).tobytes()
    frame = media._segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    out = b"\xff\xd8" + media.QUANTISERS + frame + table
    out += media._scan(1, 0, 0, 0, 0, 0x00, bits("01" + "101" + "00"))  # 5, then no change
    out += media._scan(1, 1, 63, 0, 1, 0x00, bits("00" + "1" + "01" + "1"))  # two zeros and +1 (times 2), then the end for two blocks (run bit 1: three)
    out += media._scan(1, 1, 63, 1, 0, 0x00, bits("10" + "0" + "01" + "0" + "1"))
    image = media.Image(out + b"\xff\xd9")
    first = image.parts[0]["coefs"][0]
    assert list(image.parts[0]["coefs"][:, 0]) == [5, 5] and first[3] == 3 and first[1] == -1
    assert image.rgb().shape == (8, 16, 3)


# 7


def brute_padding(lengths, k):
    values, best = sorted(set(lengths)), None
    for r in range(1, min(k, len(values)) + 1):
        for ends in itertools.combinations(values[:-1], r - 1):
            every = [*ends, values[-1]]
            padding = sum(min(e for e in every if e >= n) - n for n in lengths)
            best = padding if best is None else min(best, padding)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(8)
    for _ in range(20):
        lengths = [rng.randint(0, 40) for _ in range(rng.randint(1, 12))]
        values, counts = np.unique(lengths, return_counts=True)
        ends = packing.boundaries(values, counts, 3)
        assert sum(min(e for e in ends if e >= n) - n for n in lengths) == brute_padding(lengths, 3)


def test_long_lengths_are_exact(spark):
    got = packing.pack(spark.createDataFrame([(i, "w " * 1001) for i in range(5)], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["padded_length"], r["padding"]) for r in got} == {(1001, 1001, 0)}
    rng = random.Random(12)
    for trial in range(20):
        lengths = [rng.randint(500, 5000) for _ in range(rng.randint(1, 14))]
        texts = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string") if trial < 2 else None
        values, counts = np.unique(lengths, return_counts=True)
        ends = packing.boundaries(values, counts, 4)
        assert sum(min(e for e in ends if e >= n) - n for n in lengths) == brute_padding(lengths, 4)
        if texts:
            assert sum(r["padding"] for r in packing.pack(texts, 4).collect()) == brute_padding(lengths, 4)


def test_packing(docs, empty):
    got = packing.pack(docs, 4, 256).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(awkward_texts())))
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(ws(t)) for i, t in enumerate(awkward_texts())}
    batches = Counter((r["bucket"], r["batch"]) for r in got)
    width = {r["bucket"]: r["padded_length"] for r in got}
    assert all(n == 1 or n * width[b] <= 256 for (b, _), n in batches.items())
    for b in width:  # only a bucket's last batch may have room
        slots = max(1, 256 // max(1, width[b]))
        sizes = [batches[b, i] for i in range(sum(x == b for x, _ in batches))]
        assert all(n == slots for n in sizes[:-1])
    assert all(r["padding"] == r["padded_length"] - r["n_tokens"] >= 0 for r in got)
    assert packing.pack(empty).count() == 0


def test_ceilings(spark):
    got = spark.range(0, 100_000, 7).select("id", packing.ceiling(F.col("id")).alias("c")).collect()
    assert all(r["c"] >= r["id"] and r["c"] - r["id"] <= max(0, r["id"] / 100) for r in got)


# 8


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def line_hash(line):
    return signed(xxhash.xxh64_intdigest(line.encode(), 42))


def gram_hash(lines):
    h = 42
    for x in lines:
        h = xxhash.xxh64_intdigest(struct.pack("<q", line_hash(x)), h)
    return signed(h)


def brute_dedup(texts, gram=35, window=15):
    """Fingerprints, first occurrences and extensions one by one."""
    lines = [[(i, x, len(ws(x))) for i, x in enumerate((t or "").split("\n")) if ws(x)] for t in texts]
    prints = set()
    for d, doc in enumerate(lines):
        def reach(i, least, doc=doc):
            total = 0
            for j in range(i, len(doc)):
                total += doc[j][2]
                if total >= least:
                    return j + 1
            return None

        for i in range(len(doc)):
            inside = range(i, reach(i, window) or len(doc))
            found = [(gram_hash([x[1] for x in doc[k : reach(k, gram)]]), k) for k in inside if reach(k, gram)]
            if found:
                prints.add((d, min(found)[1], min(found)[0]))
    first = {}
    for d, k, g in sorted(prints):
        first.setdefault(g, (d, k))
    gone = [set() for _ in texts]
    for d, k, g in prints:
        f, q = first[g]
        if (f, q) < (d, k):
            a = b = 0
            while min(k, q) - a > 0 and lines[d][k - a - 1][1] == lines[f][q - a - 1][1]:
                a += 1
            while max(k + b + 1 - len(lines[d]), q + b + 1 - len(lines[f])) < 0 and lines[d][k + b + 1][1] == lines[f][q + b + 1][1]:
                b += 1
            gone[d] |= {x[0] for x in lines[d][k - a : k + b + 1]}
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]


def test_repeated_passages_go(spark):
    """Any passage of 50 words that an earlier text has is gone, whatever surrounds it; other lines stay."""
    rng = random.Random(21)
    passages = ["\n".join(prose(rng, n) for n in cut) for cut in ((51,), (26, 25), (10, 20, 21), (5,) * 11, (49, 1), (1, 49), (17, 17, 17))]
    texts = ["\n".join([prose(rng, rng.randint(1, 30)), p, prose(rng, rng.randint(1, 30))]) for p in passages for _ in range(3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        assert got[i] == (t if i % 3 == 0 else f"{lines[0]}\n{lines[-1]}"), i


def test_line_dedup(docs, empty, spark):
    texts = awkward_texts()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == brute_dedup(texts)
    assert got[9]["text"] == "" and got[8]["text"] == texts[8] and got[8]["fail_bits"] == "clash"
    assert line_dedup.dedup_lines(empty).count() == 0
    rng, made = random.Random(12), []
    shared = [prose(rng, 14) for _ in range(12)]
    for _ in range(25):
        at = rng.randint(0, 6)
        made.append("\n".join([prose(rng, 11), *shared[at : at + rng.randint(1, 6)], "", prose(rng, 13)]))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, made)).collect()}
    assert [out[i] for i in range(len(made))] == brute_dedup(made)
    twice = spark.createDataFrame([(1, made[0]), (1, made[0])], "doc_id long, text string")
    assert {r["text"] for r in line_dedup.dedup_lines(twice).collect()} == {made[0]}


@pytest.mark.parametrize("reach", [1, 3, 128])
def test_long_matches_are_whole(spark, monkeypatch, reach):
    """Copies and passages of many hundred lines, however few lines are looked at first; null ids."""
    monkeypatch.setattr(line_dedup, "REACH", reach)
    rng = random.Random(23)
    whole = [prose(rng, rng.randint(1, 12)) for _ in range(300)]
    sources = ["\n".join(prose(rng, 20) for _ in range(4)) for _ in range(40)]
    texts = ["\n".join(whole), *sources, "\n".join([*whole[20:280], "a line between", *whole[:150]]), "\n".join(x for s in sources for x in (s, "of its own")), "\n".join(whole)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_dedup(texts)
    assert got[len(texts) - 1] == "" and got[len(texts) - 2] == "\n".join(["of its own"] * 40)
    none = spark.createDataFrame([(None, texts[0]), (3, texts[0]), (None, None)], "doc_id long, text string")
    assert sorted(len(r["text"] or "") for r in line_dedup.dedup_lines(none).collect()) == [0, 0, len(texts[0])]


# 9


def brute_kn(texts, order):
    """p(c | context) by the recursive definition."""
    start = "\x02"
    tables = {order: Counter()}
    for t in texts:
        padded = start * (order - 1) + t
        tables[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discounts = {}
    for k, table in tables.items():
        n = [max(1, sum(c == i for c in table.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts[k] = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
    alphabet = len(tables[1]) + 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / alphabet
        follow = {g: c for g, c in tables[k].items() if g[:-1] == gram[:-1]}
        if not follow:
            return p(gram[1:])
        d = lambda c: discounts[k][min(c, 3) - 1]
        total, freed = sum(follow.values()), sum(d(c) for c in follow.values())
        own = (follow[gram] - d(follow[gram])) / total if gram in follow else 0
        return own + freed / total * p(gram[1:])

    return p


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_kneser_ney(spark, empty, monkeypatch, most):
    monkeypatch.setattr(kneser_ney, "BROADCAST_RUNS", most)  # 0: texts in chunks, answers from shards
    train = ["abra cadabra", "banana band", "a cab and a bar"]
    df = spark.createDataFrame(list(enumerate([*train, "bandana", "xyz", "", None])), "doc_id long, text string").withColumns({"lang": F.lit("en"), "score": F.lit("clash")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.classify(df, labels).collect()}
    p, k = brute_kn(train, kneser_ney.ORDER), kneser_ney.ORDER
    for i, t in enumerate([*train, "bandana", "xyz"]):
        padded = "\x02" * (k - 1) + t
        want = -sum(math.log2(p(padded[j : j + k])) for j in range(len(t))) / len(t)
        assert got[i]["score"] == pytest.approx(want, rel=1e-4), i
    assert got[5]["score"] is None and not got[5]["kept"] and not got[4]["kept"]
    assert all(r["kept"] for r in kneser_ney.classify(df, labels.limit(0)).collect())
    assert kneser_ney.classify(empty, labels).count() == 0


def test_kneser_ney_thresholds(spark):
    """Quantiles of trusted texts that the model has not seen, by language; ties stay, null languages take the overall one."""
    rng = random.Random(31)
    texts = [prose(rng, rng.randint(5, 30)) for _ in range(240)] + [" ".join("qzx%d" % rng.randint(0, 99) for _ in range(20)) for _ in range(30)] + [prose(rng, 20_000)]
    langs = [["en", "de", None, "rare"][i % 4 if i % 16 == 3 or i % 4 != 3 else 0] for i in range(len(texts))]
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))] + [(None, texts[0], "en"), (5, texts[5], langs[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 240, 2) if langs[i] != "rare"] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    left_out = {r[0] for r in labels.where("quality = 1 and doc_id is not null").where(F.pmod(F.xxhash64("doc_id", F.lit(kneser_ney.FOLDS)), F.lit(kneser_ney.FOLDS)) == 0).collect()}
    trusted = [r["doc_id"] for r in labels.where("quality = 1 and doc_id is not null").collect()]
    assert 10 < len(left_out) < len(trusted) / 2
    got = kneser_ney.classify(df, labels).collect()
    assert len(got) == len(rows)
    p, k = brute_kn([texts[i] for i in sorted(set(trusted) - left_out)], kneser_ney.ORDER), kneser_ney.ORDER
    for r in got[:4]:
        t = texts[r["doc_id"] or 0]
        padded = "\x02" * (k - 1) + t
        assert r["score"] == pytest.approx(-sum(math.log2(p(padded[j : j + k])) for j in range(len(t))) / len(t), rel=1e-4)
    score = {r["doc_id"]: r["score"] for r in got}
    quantile = lambda v: sorted(v)[max(0, math.ceil(kneser_ney.UPPER * len(v)) - 1)]
    every = quantile([score[i] for i in left_out])
    for r in got:
        own = [score[i] for i in left_out if langs[i] == r["lang"] and r["lang"] is not None]
        want = quantile(own) if own else every
        assert r["threshold"] == pytest.approx(want) and r["kept"] == (r["score"] <= r["threshold"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(kept & set(range(240))) > 200 and not kept & set(range(240, 270)) and 270 in kept


def test_kneser_ney_learns_all_trusted_texts(spark):
    """However many they are; quantiles are exact."""
    texts = [chr(0x4E00 + i) + "ab"[i % 2] for i in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = df.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    taught = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(kneser_ney.FOLDS)), F.lit(kneser_ney.FOLDS)) != 0)
    own, _, alphabet = kneser_ney.train(df, taught.select("doc_id"))
    n = taught.count()
    assert n > 2_000 and alphabet == n + 3 and own.where("k = 1").count() == n + 2
    judged = spark.createDataFrame([("en", float(i)) for i in range(1, 201)] + [(None, 500.0)], "lang string, score double")
    got = {(r["whole"], r["lang"]): r["cut"] for r in kneser_ney.quantiles(judged, 0.995).collect()}
    assert got == {(False, "en"): 199.0, (True, None): 200.0, (False, None): 500.0}


# 10


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(hits)[2:]) if hits else (host, path, None, "allow")


def test_url_filters(spark):
    rng = random.Random(11)
    rules = [*url_filters.RULES, ("block", "example.com", "/en/70"), ("allow", "a.example.com", "/en/7"), ("block", "net", ""), ("allow", "a.example.com", "/en/")]
    urls = [None, "", "no host", "http://", "http://COM/en/1", "ftp://x.com?/en/", "https://a.example.com/en/70x#f", "http://example.com/en/7", "http://notexample.com/en/7", "a://b://com/en/"]
    urls += [f"http://{rng.choice(['a.', 'b.a.', ''])}{rng.choice(['example.com', 'example.net', 'x.org', 'net'])}/{rng.choice(['en', 'de', 'es'])}/{rng.choice(['7', '70', '8', '81', ''])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for table in (rules, url_filters.RULES):
        got = {r["page_id"]: tuple(r)[2:] for r in url_filters.filter_urls(df, url_filters.rules_table(spark, table)).collect()}
        assert got == {i: brute_verdict(u, table) for i, u in enumerate(urls)}
    assert url_filters.filter_urls(df.limit(0), url_filters.rules_table(spark)).count() == 0
    none = url_filters.filter_urls(df, url_filters.rules_table(spark).limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_repeated_page_ids_and_urls(spark):
    df = spark.createDataFrame([(1, "http://example.com/en/7")] * 3 + [(1, None)] * 3 + [(None, None), (None, "http://example.net/de/8x")], "page_id long, url string")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, url_filters.rules_table(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "example.com/en/7", "allow")] * 3 + [(1, None, "allow")] * 3 + [(None, None, "allow"), (None, "example.net/de/8", "block")]))


# rows without an id


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "aa bb cc dd ee ff gg hh ii jj kk ll"), (None, "aa bb cc dd ee ff gg hh ii jj kk ll"), (None, None), (4, "aa bb cc dd ee ff gg hh ii jj kk ll")], "doc_id long, text string")
    assert sorted(r["n_words"] for r in quality_rules.ledger(df).collect()) == [0, 12, 12, 12] and quality_rules.keep(df).count() == 3
    packed = packing.pack(df).collect()
    assert sorted(r["n_tokens"] for r in packed) == [0, 12, 12, 12] and len({(r["bucket"], r["batch"], r["slot"]) for r in packed}) == 4
    assert sorted(r["n_bytes"] for r in media.digests(media.to_media(df)).collect()) == [0, 35, 35, 35]
    assert [r["removed_lines"] for r in line_dedup.dedup_lines(df, 5, 5).where("doc_id = 4").collect()] == [1]
