"""The corpus operators against versions written out in plain Python, and the pipeline's stages on odd input."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import html_extract, language, near_dedup, order_minhash, packing, quality, shared

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# ---- quality classifier


def naive_features(text):
    """Counts of the buckets of words, 3-grams and 4-grams, gram by gram."""
    mask, mul = 2**32 - 1, [int(x) for x in quality._MUL]
    blank = lambda ch: ord(ch) <= 32 or ord(ch) in (160, 0x3000)
    s = " " + "".join(" " if blank(ch) else ch for ch in text) + " "
    c, found = [ord(ch) for ch in s], []
    for i in range(len(c) - 2):
        if s[i + 1] != " ":
            found.append(c[i] * mul[0] + c[i + 1] * mul[1] + c[i + 2] * mul[2])
    for i in range(len(c) - 3):
        if s[i + 1] != " " and s[i + 2] != " ":
            found.append(c[i] * mul[0] + 7 * c[i + 1] * mul[1] + 11 * c[i + 2] * mul[2] + c[i + 3] * mul[3])
    for word in s.split(" "):
        if word:
            found.append((sum(ord(ch) * mul[k & 63] for k, ch in enumerate(word)) & mask) ^ 0x5BD1E995)
    out = collections.Counter()
    for h in found:
        h = (h & mask) * 0x9E3779B1 & mask
        out[((h ^ (h >> 15)) * 0x85EBCA77 & mask) >> (32 - quality.BUCKETS_LOG2)] += 1
    return out


TEXTS = ["", " ", "a", "one two", "a  b\tc\nd", "été 　 漢字 x", "word " * 40, "\xa0tail\xa0"]


def test_quality_features_and_score_match_the_definition():
    rng = np.random.default_rng(3)
    vectors, layer, bias = rng.normal(size=(1 << quality.BUCKETS_LOG2, 4)), rng.normal(size=(4, 2)), np.array([0.1, -0.2])
    folded = quality.QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    for text in TEXTS:
        want = naive_features(text)
        got = collections.Counter(int(x) for part in quality.features(text) for x in part)
        assert got == want
        n = sum(want.values())
        mean = sum((k * vectors[b] for b, k in want.items()), np.zeros(4)) / max(1, n)
        z = mean @ layer + bias
        assert quality.score_texts([text], folded)[0] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-4)


def test_quality_odd_input(spark):
    rows = [(1, "good prose here"), (1, "good prose here"), (2, None), (3, ""), (None, "no id"), (4, "long " * 300_000), (5, "### $$$"), (6, "good text too"), (8, "@@ ##")]
    d = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, label string, score int")
    labels = spark.createDataFrame([(1, 1), (6, 1), (5, 0), (8, 0), (8, 0), (None, 1)], "doc_id long, quality int")
    m = quality.fit_quality(d, labels)
    out = quality.score_quality(d, m).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all() and out.score[out.doc_id == 1].nunique() == 1
    assert quality.keep_quality(d, m).columns == d.columns
    assert quality.score_quality(d.limit(0), m).count() == 0


# ---- language identification


def naive_mixture(p, counts, rounds):
    k = len(p[0])
    w = [1 / k] * k
    for _ in range(rounds):
        new = [0.0] * k
        for row, n in zip(p, counts):
            total = sum(w[j] * row[j] for j in range(k))
            for j in range(k):
                new[j] += n * w[j] * row[j] / total
        w = [x / sum(counts) for x in new]
    return w, sum(n * np.log(sum(w[j] * row[j] for j in range(k))) for row, n in zip(p, counts))


def test_language_mixture_matches_plain_expectation_maximisation():
    rng = np.random.default_rng(5)
    p, c = rng.dirichlet(np.ones(60), 3).T, rng.integers(1, 20, 60)
    w, ll = language.mixture(p, c.astype(float), 12)
    want, want_ll = naive_mixture(p.tolist(), c.tolist(), 12)
    assert w == pytest.approx(want) and ll == pytest.approx(want_ll)


def test_language_set_by_penalised_likelihood(spark):
    """A small share of a second language in a long text joins the set; letter-like numbers are no letters."""
    one, two = "der die und das nicht mit von ein " * 20, "the and of to with that was for " * 20
    rows = [(i, t, l) for i, (t, l) in enumerate([(one, "de"), (two, "en"), (two, "en"), (one, None), (None, "fr")] * 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rank", F.lit("clash")).withColumn("h", F.lit(1))
    m = language.fit_languages(d)
    odd = spark.createDataFrame([(1, two * 100 + one), (2, "①②③"), (3, "Ⅷ"), (4, "²"), (5, two * 3000), (5, two * 3000), (6, "\xaa")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(odd, m).collect()}
    assert got[1].langs == ["en", "de"] and got[1].lang_pred == "en" and got[1].score > 0.9
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred == "en" and got[6].lang_pred != "und"
    assert language.identify(odd.limit(0), m).count() == 0


# ---- packing


def test_packing_matches_a_plain_version():
    def plain(lengths, capacity, linear, quadratic):
        count = -(-sum(lengths) // capacity)
        bins, out = [[capacity, 0.0] for _ in range(count)], []
        for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            start, left = 0, lengths[item]
            while left:
                fits = [s for s in range(count) if bins[s][0] >= left]
                s = min(fits, key=lambda s: bins[s][1]) if fits else max(range(count), key=lambda s: bins[s][0])
                n = min(left, bins[s][0])
                out.append((item, start, n, s, capacity - bins[s][0]))
                bins[s][0] -= n
                bins[s][1] += linear * n + quadratic * n * n
                start, left = start + n, left - n
        return out, count

    rng = random.Random(9)
    for _ in range(40):
        lengths = [rng.randint(1, 63) for _ in range(rng.randint(1, 60))]
        assert packing.pack_rests(np.array(lengths), 64, 1.0, 1 / 64) == plain(lengths, 64, 1.0, 1 / 64)


# ---- order MinHash


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def naive_fingerprint(text):
    text_hash = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    number = lambda v, size, seed=42: xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), seed)
    words = re.findall(r"(?:(?<!\S)|(?<=\S{16})|(?=\S{17}))(?=(\S{1,16}))", text or "", re.ASCII)
    if not words:
        return ""
    places = [(text_hash(w2, text_hash(w1)) & order_minhash._KEY, i) for i, (w1, w2) in enumerate(zip(words, [*words[1:], ""]))]
    seen, points = collections.Counter(), []
    for key, at in places:
        n = seen[key]
        seen[key] += 1
        points.append((key if n == 0 else number(n, 4, number(key, 8)) & order_minhash._KEY, at))
    points.sort()
    out = ""
    for slot in range(order_minhash.SLOTS):
        i = next((i for i, (key, _) in enumerate(points) if key >> 29 >= slot), 0)
        a, b = sorted((points[i], points[(i + 1) % len(points)]), key=lambda p: p[1])
        out += f"{number(b[0], 8, number(a[0], 8)) & 0xFFFF:04x}"
    return out


def test_fingerprint_matches_the_definition(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts += ["", None, " \n", "one", "a " * 50, "x" * 15, "y" * 16, "z" * 17, "q" * 40 + " r", "漢字" * 30 + " é " + "字" * 18]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", order_minhash.fingerprint(F.col("t")).alias("f"))
    got = {r.i: r.f for r in d.collect()}
    assert got == {i: naive_fingerprint(t) for i, t in enumerate(texts)}
    pairs = spark.createDataFrame([(got[i], got[j]) for i in range(0, 40, 7) for j in range(0, 45, 11)], "a string, b string")
    for r in pairs.select("a", "b", order_minhash.likeness(F.col("a"), F.col("b")).alias("v")).collect():
        same = sum(r.a[k : k + 4] == r.b[k : k + 4] for k in range(0, 256, 4)) / 64 if r.a and r.b else float(r.a == r.b)
        assert r.v == same


def test_edited_likeness_with_null_and_repeated_ids(spark):
    rows = [(None, "null id"), (None, "another"), (5, "five five"), (5, "other five"), (5, "five five"), (7, "seven")]
    out = order_minhash.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"), blocks=3).collect()
    assert len(out) == len(rows) and all(0 <= r.near_next <= 1 for r in out)
    assert sorted(r.n_chars for r in out) == sorted(len(t) for _, t in rows)


# ---- near duplicates


def test_boilerplate_makes_few_pairs(spark):
    """Many documents that share much boilerplate, none linked: the pairs compared stay far below all pairs."""
    rng = random.Random(2)
    common = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(40)])) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dedup.near_duplicates(d).where("NOT kept").count() == 0
    sigs = d.mapInArrow(near_dedup._signatures(1, 5), "doc_id long, n long, key long, bands array<long>, sig binary").select(F.col("key").alias("id"), F.explode("bands").alias("band"))
    met = shared.met(sigs).cache()
    pairs, blocks = shared.across(met, spark.createDataFrame([], "node long, component long"), near_dedup.FEW, near_dedup.LEFT, near_dedup.RIGHT)
    compared = {(r.a, r.b) for r in shared.first_pairs(met).union(pairs).collect()}
    assert len(compared) < 0.25 * 800 * 799 / 2 and blocks.groupBy("band", "block", "piece").count().agg(F.max("count")).first()[0] in (None, *range(2000))


# ---- HTML


def test_html_keeps_all_of_the_article():
    m = html_extract.main_text
    body = "<p>A paragraph of the article, long enough to count, with commas.</p>"
    assert m(f"<body><main><header><h1>Title</h1></header>{body}</main></body>").startswith("Title A paragraph")
    assert m(f'<article>{body}<div class="market-share"><p>Ten percent.</p></div></article>').endswith("Ten percent.")
    assert m(f"<article>{body}<figure><img><figcaption>A caption</figcaption></figure></article>").endswith("A caption")
    assert m(f'<article>{body}<ul><li><a href="1">First source</a></li><li><a href="2">Second</a></li></ul></article>').endswith("First source Second")
    assert m(f"<article>{body}<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p></article>").endswith("Where x=2.")
    assert m(f"<body><article>{body}</article><article><p>A short one.</p></article></body>").endswith("A short one.")
    for clutter in ('<div class="share-bar">Share</div>', '<div class="article-share-buttons">Share</div>', '<div id="comments-section">Reader</div>', '<div class="ad-slot-3 x">Buy</div>', '<div class="post-comments">Reader</div>', '<p class="cookie-notice">Cookies</p>', '<div role="search">Find</div>', "<div hidden>Not shown</div>"):
        assert m(f"<article>{body}{clutter}</article>") == m(f"<article>{body}</article>")
    deep = "<div>" * 400 + '<nav><a href="1">menu</a></nav><p>deep text</p>' + "</div>" * 400
    assert m(deep) == "deep text"


def test_html_without_an_article():
    page = '<body><div class="top-nav"><a href="1">Home</a></div><div><h1>Head</h1><p>First paragraph, which is long, with commas, and so the best.</p><h2>Part</h2><ul><li>one</li><li>two</li></ul><p>Short.</p><pre>code</pre><p>Last paragraph, also long enough, with commas, to be kept.</p></div><div class="sidebar">side</div></body>'
    assert html_extract.main_text(page) == "Head First paragraph, which is long, with commas, and so the best. Part one two Short. code Last paragraph, also long enough, with commas, to be kept."


def test_html_empty_table(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string, n_chars int")
    assert html_extract.extract(d).columns == ["page_id", "url", "text", "n_chars"] and html_extract.extract(d).count() == 0


# ---- the pipeline's stages


@pytest.fixture(scope="module")
def odd_docs(spark):
    base = "plain words that make a sentence of some length for this very test to read"
    rows = [(1, base), (1, base), (2, base), (3, None), (4, ""), (5, " \n\t\n"), (None, "a row without an id"), (None, "a row without an id"), (6, "first text of six"), (6, base), (7, "w " * 60_000)]
    d = spark.createDataFrame([(i, t, "en", None if i == 3 else "src0", len(t or ""), "x", "y", k) for k, (i, t) in enumerate(rows)], DOC + ", mix_slot string, lines string, id long")
    return d


def test_stages_on_odd_input(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 1), (7, 0)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    scratch = shared.Scratch(spark, "odd")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for label, d in (("odd", odd_docs), ("none", odd_docs.limit(0))):
            d = scratch.write(d, f"in-{n}-{label}")
            out = scratch.write(stage(spark, d, str(tmp_path)), f"out-{n}-{label}")
            if name != "packing":
                assert out.columns == d.columns
            if label == "none":
                assert out.count() == 0
            elif name == "line dedup":
                got = sorted((r.id, r.text) for r in out.collect() if r.text)
                assert [i for i, _ in got] == [0, 1, 5, 6, 8, 10] or [i for i, _ in got] == [0, 1, 5, 6, 7, 8, 10]
                assert out.where("mix_slot = 'x' AND lines = 'y'").count() == out.count()
            elif name == "minhash near dedup":
                ids = sorted(r.id for r in out.collect())
                assert len(set(ids) & {0, 1}) == 1 and not set(ids) & {2, 9} and {3, 4, 5, 6, 7, 8, 10} <= set(ids)
            elif name == "source mixing":
                assert sorted(r.id for r in out.collect()) == list(range(11))
            elif name == "packing":
                whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
                assert len(whole) == 8 and all(r.n == r.of for r in whole if r.doc_id in (2, 3, 4, 5, 7))


def test_packing_follows_the_mixture(spark, tmp_path):
    """Sequence numbers grow along the files that the mixing stage wrote."""
    rows = [(i, f"text number {i} " * 40, "en", f"src{i % 4}", 100) for i in range(400)]
    scratch = shared.Scratch(spark, "order")
    mixed = scratch.write(corpus_pipeline.source_mixing(spark, spark.createDataFrame(rows, DOC), str(tmp_path)), "mixed")
    order = [r.doc_id for r in mixed.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    packed = corpus_pipeline.cost_packing(spark, mixed, str(tmp_path)).groupBy("doc_id").agg(F.min(F.shiftright("sequence_id", 40)).alias("part")).collect()
    part = {r.doc_id: r.part for r in packed}
    assert [part[i] for i in order] == sorted(part[i] for i in order) and len(order) == 400
