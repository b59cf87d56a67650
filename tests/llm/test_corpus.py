"""The corpus operators: brute-force versions, round trips, and odd input."""

import glob
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import html_extract, language, line_dedup, mixing, near_dedup, nearest, order_minhash, packing, quality, queries, shared, tokens

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(words, seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


# ---- nearest neighbours


def test_nearest_recall_and_scores(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {(r.query_id, r.vec_id): r.score for r in queries.op1_ann_collision_counting(spark, "/root/testdata/sf0.01").collect()}
    p = v.toPandas()
    want = list(nearest.brute_force(p.vec_id.tolist(), np.stack(p.embedding), [i for i in p.vec_id if i % 50 == 0]))
    assert np.mean([(q, i) in got for q, _, i, _ in want]) >= 0.9
    assert all(got[q, i] == s for q, _, i, s in want if (q, i) in got)


def test_nearest_odd_input(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (9, [float("inf"), 0.0]), (2, [2.0, 0.0]), (10, [])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(v, v.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert nearest.nearest(v.limit(0), v.limit(0)).count() == 0
    many = nearest.nearest(v, v, k=2, block=2, query_block=2)  # several blocks on both sides
    assert many.where("query_id = 1").count() == 2


def test_collisions_are_counted_on_the_smaller_side(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index, lines = nearest.CollisionIndex(x[:1000], 64), []
    at, gaps = index.lines @ x[1200], np.abs(index.lines @ x[:1000].T - (index.lines @ x[1200])[:, None])
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda v, **k: lines.append(len(v)) or count(v, **k))
    cos = x[:1000] @ x[1200]
    rows, found, more = index.search(x[1200], lambda r: cos[r], 5, float(np.sort(cos)[-5]))
    assert sum(lines) < 64 * 1000 / 2 and not more and set(np.argsort(cos)[-5:]) <= set(rows) and len(set(rows)) == len(rows) < 1000
    for radius in (0.1, 0.6, 1.1, 1.9):
        assert (index.collisions(at + index.shift[:, 0], radius) == (gaps <= nearest.WIDTH * radius).sum(axis=0)).all()
    rows, found, more = index.search(x[1200], lambda r: cos[r], 5)  # without a bound
    assert set(np.argsort(cos)[-5:]) <= set(rows) and len(set(rows)) == len(rows) < 1000 and (found == cos[rows]).all()
    assert len(index.search(x[1200], lambda r: cos[r], 1000)[0]) == 1000


# ---- quality and language


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.85 and out.score.between(0, 1).all()


def test_quality_ignores_other_columns_and_held_out_labels(spark, words):
    rows = [(i, prose(words, i, 30) if i % 2 else "### $$$ %%% " * 9, "s") for i in range(60)]
    d = docs(spark, [*rows, (None, "a b", "s"), (100, None, "s"), (101, "", "s")])
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, (i % 2) ^ (i in held)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    m = quality.fit_quality(d, labels)
    got = {r.doc_id: r for r in quality.score_quality(d.withColumn("score", F.lit("x")), m).collect()}
    assert all(got[i].predicted == i % 2 for i in range(60)) and len(got) == 63
    assert got[100].score == got[101].score
    assert quality.keep_quality(d, m).columns == d.columns
    assert quality.score_quality(d, quality.fit_quality(d, labels.limit(0))).first().score == 0.5


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98


def test_language_mixture_and_odd_input(spark):
    one, two = "der die und das nicht mit von ein " * 20, "the and of to with that was for " * 20
    d = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([(one, "de"), (two, "en")] * 6)], "doc_id long, text string, lang string")
    m = language.fit_languages(d)
    odd = spark.createDataFrame([(1, one + two), (2, None), (3, ""), (4, "123 !!"), (5, one * 300), (6, "µ"), (None, two)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(odd, m).collect()}
    assert set(got[1].langs) == {"de", "en"}
    assert [got[i].lang_pred for i in (2, 3, 4, 5, None)] == ["und", "und", "und", "de", "en"]
    assert got[6].lang_pred in ("de", "en")
    assert language.identify(odd, language.fit_languages(d.limit(0))).where("lang_pred <> 'und'").count() == 0


# ---- near duplicates


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_truth(rows, k, percent):
    s = {i: shingles(t, k) for i, t in rows}
    part = {i: i for i in s}
    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = part[a], part[b]
            part = {i: min(x, y) if c in (x, y) else c for i, c in part.items()}
    return {i: (len(s[i]), part[i], part[i] == i) for i in s}


def test_near_duplicates_match_brute_force(spark, words):
    rng, rows = random.Random(4), []
    for g in range(12):
        base = prose(words, g, 60).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE two"), (905, "one"), (906, prose(words, 99, 30000)), (907, prose(words, 99, 30000) + " x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("band", F.lit(2))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(d, k=4).collect()}
    assert got == near_truth(rows, 4, 80)


def test_near_duplicates_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(d).collect())
    assert [g[:2] for g in got] == [(-1, 3), (3, 3), (5, 3), (5, 3)] or [g[:2] for g in got] == [(-1, -1), (3, 3), (5, 3), (5, 3)]
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (None, 1)]
    scratch = shared.Scratch(spark, "t")
    got = {r.node: r.component for r in shared.components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100, 102: 100}


# ---- HTML


def test_html_cases():
    m = html_extract.main_text
    page = '<body><header><h1>Site</h1></header><nav>menu</nav><div class="sidebar"><p>side, bar, text</p></div><article><h1>Head &amp; more</h1><p>First, para<br>of text, with commas.<p>Second <b>bold</b> para.<div class="comments"><p>reader says, hello</p></div></article><form>f</form><footer>foot</footer><script>var a = "<p>no</p>";</script></body>'
    assert m(page) == "Head & more First, para of text, with commas. Second bold para."
    assert [m(x) for x in (None, "", "<br>", "plain &lt;text&gt;")] == ["", "", "", "plain <text>"]
    assert m("<p>a</p>" * 3000).count("a") == 3000
    assert m('<a "' * 50000) is not None and m("<div>" * 5000 + "deep") == "deep"
    assert m("<p>shown</p><!-- never closed <p>hidden</p>") == "shown"


def test_html_operator(spark):
    rows = [(1, None, "<article><p>Text, one.</p></article>", "x"), (1, None, "<article><p>Text, one.</p></article>", "x"), (None, "u", None, "y")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_extract.extract(d).collect())
    assert got == [(0, "u", "", 0), (1, "", "Text, one.", 10), (1, "", "Text, one.", 10)]


def test_html_matches_articles(spark):
    got = {r.page_id: r.text for r in queries.op4_html_extract(spark, DATA).collect()}
    import html as h

    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(h.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


# ---- tokens and packing


TABBED = ["a\tb\tc\n\n", "a\t b\tc\n\n\td", "Price:\xa05\xa0EUR\n\n", "hello <|endoftext|> ok", "<|endoftext|>"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD_TEXTS = ["", "a", " a", "a  b", "a \n b", "x\n\ny", "tail ", "\ttab", "it's  <|endoftext|> ok", "é ñ 漢字 の テスト", "a b c", "word " * 5000, "''' 's don't", "\U0001f600 \U0001f600", "1 22 333", "x" * 5000]


def encoder_ids(enc, texts):
    ids, ends = enc.encode(texts)
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_encoder_equals_library(words, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 200)  # the memory is emptied now and then
    enc = tokens.Encoder(queries.tokenizer_path())
    texts = [None, *ODD_TEXTS, *TABBED] + [prose(words, i, 50) for i in range(20)]
    for _ in range(2):  # the second time from memory
        assert encoder_ids(enc, texts) == [i.tolist() for i in plain_ids(texts)]
    assert encoder_ids(enc, [""]) == [[]] and encoder_ids(enc, []) == [] or encoder_ids(enc, []) == [[]]


def test_encoder_equals_library_on_random_strings():
    enc, rng = tokens.Encoder(queries.tokenizer_path()), random.Random(12)
    atoms = [" ", "  ", "\n", "\n\n", "\t", "\r", "\xa0", "\u3000", "\x85", "\x1c", "\u200b", "\ufeff", "a", "ab", "The", " of", "don't", "'", "''", "'s", "'re", "'ll", "'ve", "'LL", "'sub", "'d", "'m", "'t", "r", "e", "l",
             "1", "22", "\xbd", "\xb2", "!", "?!", "...", "\u0301", "\xe9", "漢", "字", "ที่", "\U0001f600", "_", "-", "“", "<|endoftext|>", "x" * 40]
    for _ in range(350):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(60)]
        assert encoder_ids(enc, texts) == [i.tolist() for i in plain_ids(texts)]


def test_long_texts_are_encoded_in_parts(words):
    text = prose(words, 3, 9000) + "  two\n\nbreaks 's " + "y" * 3000 + prose(words, 4, 3000)
    assert len(list(tokens._parts(text, 1000, []))) > 20
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, None, "short"])], ["i", "t"])
    got = [(r.num_rows, ids.tolist(), ends.tolist()) for r, ids, ends in tokens.encoded(iter([batch]), 1, queries.tokenizer_path(), 9, chars=250)]
    want = [[*x.tolist(), 9] for x in plain_ids([text, None, "short"])]
    assert sum(n for n, _, _ in got) == 3 and [i for _, ids, _ in got for i in ids] == sum(want, [])


def test_token_file_round_trip(spark, tmp_path):
    rows = [(i * 7 % 31, t, "s") for i, t in enumerate(ODD_TEXTS + TABBED)] + [(50, None, "s")]
    path = str(tmp_path / "ids")
    d = docs(spark, rows).withColumn("ids", F.lit("clash")).withColumn("h", F.lit(1))
    tokens.write_tokens(d, path, queries.tokenizer_path(), end_id=2, files=3)
    want = {i: np.append(x, 2).astype("<u4") for (i, _, _), x in zip(rows, plain_ids([t for _, t, _ in rows]))}
    at = 0
    got = {r.doc_id: r for r in tokens.token_spans(spark, path).collect()}
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want[i]), zlib.crc32(want[i].tobytes()))
        at += len(want[i])
    assert "ids" not in tokens.token_counts(spark, path).columns
    again = [(None, "no id", "s"), (None, None, "s"), (4, "twice", "s"), (4, "twice", "s"), (4, "other", "s")]
    tokens.write_tokens(docs(spark, again), f"{path}-r", queries.tokenizer_path(), end_id=2, files=3)
    spans = tokens.token_spans(spark, f"{path}-r").orderBy("start").collect()
    assert [r.doc_id for r in spans] == [None, None, 4, 4, 4] and [r.start for r in spans] == np.cumsum([0, *[r.n_tokens for r in spans[:-1]]]).tolist()
    tokens.write_tokens(docs(spark, rows).limit(0), f"{path}-0", queries.tokenizer_path(), end_id=2, files=3)
    assert tokens.token_spans(spark, f"{path}-0").count() == 0


def test_token_file_layout(spark, words, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "ids")
    tokens.write_tokens(docs(spark, [(i, prose(words, i, 2000), "s") for i in range(400)]), path, queries.tokenizer_path(), end_id=2, files=1, row_group_mb=1)
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/part-*")]
    assert sum(m.num_rows for m in metas) == 400 and max(m.num_row_groups for m in metas) > 1
    for m in metas:
        for g in range(m.num_row_groups):
            cols = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for c in range(4)}
            assert all("DELTA_BINARY_PACKED" in cols[c].encodings for c in ("doc_id", "n_tokens", "before"))
            assert cols["ids.list.element"].has_dictionary_page and all(c.has_column_index and c.has_offset_index for c in cols.values())


def test_packing(spark, words):
    rows = [(i, prose(words, i, random.Random(i).choice([1, 20, 300, 900])), "s") for i in range(80)] + [(200, None, "s"), (201, "", "s"), (202, "word " * 9000, "s"), (7, "again", "s"), (None, "no id", "s")]
    got = packing.pack(docs(spark, rows).coalesce(1).withColumn("start", F.lit("x")), queries.tokenizer_path(), block_tokens=20000).toPandas()
    assert not got.duplicated(["sequence_id", "offset"]).any()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and (s.offset == s.length.cumsum() - s.length).all()
    ids = {i: np.append(x, 0).astype("<u4") for (i, _, _), x in zip(rows, plain_ids([t for _, t, _ in rows])) if i not in (7, None)}
    for i, x in ids.items():
        p = got[got.doc_id == i].sort_values("start")
        assert p.length.sum() == len(x) and (p.start == p.length.cumsum() - p.length).all()
        assert [zlib.crc32(x[a : a + n].tobytes()) for a, n in zip(p.start, p.length)] == p.ids_crc32.tolist()
    used = got.groupby("sequence_id").length.sum()
    assert used.sum() / (1024 * len(used)) > 0.97
    assert packing.pack(docs(spark, rows).limit(0), queries.tokenizer_path()).count() == 0


def test_packing_balances_cost():
    pieces, n = packing.pack_rests(np.array([600, 500, 400, 300, 200, 48]), 1024, 1.0, 1 / 1024)
    assert n == 2 and sorted(sum(p[2] for p in pieces if p[3] == s) for s in range(2)) == [1024, 1024]


# ---- order MinHash


def test_edited_text_and_fingerprints(spark, words):
    rows = [(i * 3, prose(words, i, random.Random(i).choice([1, 5, 200])), "s") for i in range(30)] + [(100, None, "s"), (101, "", "s"), (102, "a " * 3000, "s"), (103, "a " * 3000, "s"), (104, "é漢\U0001f600", "s")]
    got = {r.doc_id: r for r in order_minhash.edited_likeness(docs(spark, rows).withColumn("rank", F.lit(1)), blocks=4).collect()}
    ordered = sorted(rows, reverse=True)
    for (i, t, _), (j, u, _) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[102].fingerprint == got[103].fingerprint and got[103].near_next == 1.0 and got[100].fingerprint == ""
    long = [got[i] for i, t, _ in rows if t and len(t) > 500 and i < 100]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.05
    assert order_minhash.edited_likeness(docs(spark, rows).limit(0), 4).count() == 0
    assert order_minhash.edited_likeness(docs(spark, rows[-2:-1]), 4).first().near_next == 1.0


def test_fingerprint_sees_order_and_repeats(spark, words):
    t = prose(words, 1, 300).split()
    texts = [" ".join(t), " ".join(t[150:] + t[:150]), " ".join(reversed(t)), " ".join(t + t), " ".join(t[:290] + ["x"] * 10)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", order_minhash.fingerprint(F.col("t")).alias("f"))
    f = {r.i: r.f for r in d.collect()}
    like = lambda a, b: spark.range(1).select(order_minhash.likeness(F.lit(f[a]), F.lit(f[b])).alias("v")).first().v
    assert like(0, 0) == 1.0 and like(0, 4) > 0.8 and like(0, 2) < 0.1 and like(0, 1) < 0.9 and like(0, 3) < 0.9


def test_fingerprint_of_unspaced_text_survives_an_insertion(spark):
    rng = random.Random(4)
    t = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1000))
    d = spark.createDataFrame([(t, t[:3] + "x" + t[3:])], "a string, b string")
    assert d.select(order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b"))).alias("v")).first().v > 0.8


# ---- line dedup


def test_line_dedup_matches_brute_force(spark, words):
    rng, rows = random.Random(8), []
    pool = [prose(words, 500 + i, rng.choice([3, 8, 30])) for i in range(40)]
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.5 else prose(words, rng.randrange(10**6), 12) for _ in range(5)]
        rows.append((i, "\n".join(x[: len(x) // 2] + "zz" + x[len(x) // 2 :] if rng.random() < 0.2 else x for x in lines), "s"))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    occ = [(i, n, x.lower().strip(" \t\r\f")) for i, t, _ in rows for n, x in enumerate(t.split("\n"))]
    grams = {x: {x[j : j + 5] for j in range(len(x) - 4)} or {x} for _, _, x in occ}
    part = {x: x for x in grams}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(grams, 2):
        if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
            part[root(a)] = root(b)
    first, want = {}, {}
    for i, n, x in occ:
        first.setdefault(root(x), (i, n))
    for i, t, _ in rows:
        want[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if first[root(x.lower().strip(" \t\r\f"))] == (i, n))
    assert got == want


def test_line_dedup_tests_all_of_a_wide_band(spark, words):
    """Two like pairs, and a chain, among 300 unlike lines that all meet in one band; in two components from the start."""
    lines = [prose(words, 9000 + i, 4) for i in range(300)]
    lines += [f"{lines[100]}z", f"{lines[200]}z", f"{lines[200]}zy"]
    met = shared.met(spark.createDataFrame([(7, i) for i in range(len(lines))], "band long, id long"))
    comp = spark.createDataFrame([(5, 4), (6, 4)], "node long, component long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    pairs, blocks = shared.across(met, comp, few=64, left=32, right=48)
    assert pairs.count() == 0
    links = blocks.join(texts, "id").groupBy("band", "block", "piece").applyInArrow(line_dedup._across(80), "a long, b long").collect()
    found = {frozenset((r.a, r.b)) for r in links}
    assert frozenset((100, 300)) in found and found <= {frozenset(x) for x in [(100, 300), (200, 301), (301, 302), (200, 302)]}
    assert len(found & {frozenset(x) for x in [(200, 301), (301, 302), (200, 302)]}) >= 2
    pairs, blocks = shared.across(met, comp, few=1000, left=32, right=48)
    assert blocks.count() == 0
    assert {(r.a, r.b) for r in pairs.collect()} == set(itertools.combinations(range(len(lines)), 2)) - {(4, 5), (4, 6), (5, 6)}


def test_meeting_stream(spark):
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.randint(0, 30), rng.randint(0, 6)) for _ in range(120))
    want = []
    for band, run in itertools.groupby(sorted(set(rows)), key=lambda r: r[0]):
        ids = [i for _, i in run]
        want += [(band, i, ids[0], ids[k - 1] if k else None, k) for k, i in enumerate(ids)] if len(ids) > 1 else []
    for size in (1, 2, 7, 200):
        batches = (pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.int64()), pa.array([i for _, i in part], pa.int64())], ["band", "id"]) for part in (rows[k : k + size] for k in range(0, len(rows), size)))
        got = [tuple(r.values()) for out in shared._meeting(batches) for r in out.to_pylist()]
        assert got == want


def test_line_dedup_recall(spark, words):
    """Pairs of lines at a similarity of 0.8 or little more, of several kinds: nearly all are linked."""
    rng, lines = random.Random(6), []

    def jaccard(x, y):
        a, b = ({s[j : j + 5] for j in range(len(s) - 4)} or {s} for s in (x, y))
        return len(a & b) / len(a | b)

    while len(lines) < 1200:
        kind = len(lines) // 2 % 4
        x = prose(words, rng.random(), rng.randint(6, 30)) if kind < 2 else "https://example.org/" + "".join(rng.choice("abcdefghij0123456789/-") for _ in range(100)) if kind == 2 else "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randint(40, 200)))
        y = list(x)
        for _ in range(rng.randint(1, 1 + len(x) // 60)):
            y[rng.randrange(len(y))] = "z"
        y = "".join(y)
        if x != y and jaccard(x, y) >= 0.8:
            lines += [x, y]
    out = line_dedup.dedup_lines(docs(spark, [(i, x, "s") for i, x in enumerate(lines)])).where("lines_kept = 0").toPandas()
    assert len(set(out.doc_id) & set(range(1, len(lines), 2))) >= 0.97 * len(lines) / 2 and not set(out.doc_id) & set(range(0, len(lines), 2))


def test_line_dedup_very_long_lines(spark, words):
    long = prose(words, 77, 120_000)  # longer than a group of lines
    rows = [(1, long, "s"), (2, long[:-5] + "xxxxx\nshort", "s"), (3, "other\n" + long.upper(), "s")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: long, 2: "short", 3: "other"}


def test_line_dedup_signs_the_verified_shingles(spark):
    """Like lines whose words, script or marks differ meet; each pair has a similarity of 0.8 or more."""
    thai = "".join(chr(0x0E01 + i * 7 % 40) for i in range(60))
    url = "https://example.org/a/long/path/of/pages/item-number-00"
    pairs = [("advertisement 1", "advertisement 2"), (f"{url}1", f"{url}2"), (thai, thai[:-1]), ("a line of plain words that all have their own letters", "\ufeffa line of plain words that all have their own letters")]
    out = line_dedup.dedup_lines(docs(spark, [(i, x, "s") for i, x in enumerate(x for p in pairs for x in p)])).toPandas()
    assert sorted(out.doc_id[out.lines_kept == 0]) == [1, 3, 5, 7]


def test_line_dedup_shuffles_lines_not_sets(spark):
    blocks = spark.createDataFrame([(1, 1, 7, 0, 0, 0), (2, 2, 7, 0, 0, 1)], "id long, comp long, band long, block int, piece int, side int")
    texts = spark.createDataFrame([(1, "one line of some words"), (2, "one line of some words.")], "id long, line string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = line_dedup._joined(blocks, texts, 80)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: (.*)", plan)
    assert any("line#" in x for x in moved) and not any("set_" in x for x in moved)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


@pytest.mark.parametrize("size", [5, 10, 20, 40, 80, 160, 400])
def test_line_dedup_bands_of_sets_of_all_sizes(spark, size):
    rng, pairs = np.random.default_rng(size), []
    while len(pairs) < 200:
        x = rng.integers(0x4E00, 0x9000, size + 4).tolist()
        if size <= 20:  # one end less
            y = x[: size + 4 - max(1, size // 5)]
        else:
            y = list(x)
            for at in range(2, len(x), 50):  # an edit in 50 characters
                y[at] = 0x3042
        x, y = ("".join(map(chr, c)) for c in (x, y))
        sx, sy = ({c[k : k + 5] for k in range(len(c) - 4)} for c in (x, y))
        assert 0.79 < len(sx & sy) / len(sx | sy) < 0.9
        pairs.append((x, y))
    lines = spark.createDataFrame([(2 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)], "id long, line string")
    got = line_dedup._bands(lines).toPandas()
    assert not got.duplicated().any() and got.groupby("id").size().min() >= 14
    held = got.groupby("id")["band"].agg(set)
    assert sum(bool(held[2 * k] & held[2 * k + 1]) for k in range(200)) >= 194
    assert len(got) - got["band"].nunique() < 200 * 31  # no lines meet that are not a pair


def test_line_dedup_odd_input(spark):
    rows = [(2, "same line here\n\nother", "s"), (1, "Same line here ", "s"), (3, None, "s"), (4, "", "s"), (5, "漢字漢字漢字漢字の行です", "s"), (6, "x\n" * 3 + "x", "s"), (2, "same line here\n\nother", "s"), (None, "null id", "s"), (9, "null id", "s")]
    d = docs(spark, rows).withColumn("lines", F.lit("clash")).withColumn("id", F.lit(0))
    out = line_dedup.dedup_lines(d)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text, r.lines, r.lines_kept) for r in out.collect() if r.text is not None)
    assert got == [(-1, "null id", 1, 1), (1, "Same line here ", 1, 1), (2, "\nother", 2, 1), (2, "\nother", 2, 1), (4, "", 0, 0), (5, "漢字漢字漢字漢字の行です", 1, 1), (6, "x", 4, 1), (9, "", 1, 0)]
    assert out.where("doc_id = 3 AND text IS NULL").count() == 1
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_is_sql_only(spark, monkeypatch):
    """No Python on the executors; lines of few distinct shingles meet whatever their lengths, and so do crowds of one template."""
    plans, write = [], shared.Scratch.write

    def seen(self, df, table, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, df, table, **options)

    monkeypatch.setattr(shared.Scratch, "write", seen)
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    rng = random.Random(12)
    unit = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(57)) + "q"
    log = lambda n: f"2024-05-01 12:00:00 worker finished request id={n} with status 200 in time"
    crowd = [log(rng.randrange(10**19, 10**20)) for _ in range(200)]
    lines = ["-" * 10, "-" * 3000, unit + unit[:4], unit * 5, "ha " * 12 + "ha", "ha " * 60 + "ha", *crowd, crowd[150].replace("200", "404")]
    out = line_dedup.dedup_lines(docs(spark, [(i, x, "s") for i, x in enumerate(lines)]))
    assert sorted(r.doc_id for r in out.where("lines_kept = 0").collect()) == [1, 3, 5, 206]
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) > 15 and not [p for p in plans if "Arrow" in p or "Python" in p or "Pandas" in p]


# ---- mixing


def earliest_deadline_first(sizes, weights, slots):
    """The source sent in each slot while all sources last, by the definition, on exact fractions."""
    from fractions import Fraction
    from math import ceil, floor

    share = {s: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items()}
    sent, out = dict.fromkeys(share, 0), []
    for t in range(slots):
        ready = [(ceil((sent[s] + 1) / w), s) for s, w in sorted(share.items()) if floor(sent[s] / w) <= t]
        out.append(min(ready)[1])
        sent[out[-1]] += 1
        if sent[out[-1]] == sizes[out[-1]]:
            break
    return out


def sent_slots(rows):
    at = {}
    for r in rows:
        assert at.setdefault((r.source, r.mix_block), r.mix_slot) == r.mix_slot
    assert len(set(at.values())) == len(at)
    return [s for _, (s, _) in sorted((t, k) for k, t in at.items())], sorted(at.values())


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 2.0, "c": 1.0}, {"a": 0.02, "b": 0.9, "c": 0.08}, {"a": 0.3333, "b": 0.5004, "c": 0.1663}])
def test_mixing_is_earliest_deadline_first(spark, weights):
    sizes = {"a": 700, "b": 300, "c": 200}
    rows = [(k, f"{s}{i}", s) for k, (s, i) in enumerate((s, i) for s, n in sizes.items() for i in range(n))]
    out = mixing.mix(docs(spark, rows).withColumn("block", F.lit(1)), weights, block_rows=10, bucket_rows=64).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows) and all(0 <= r.mix_place < 10 for r in out)
    got, slots = sent_slots(out)
    want = earliest_deadline_first({s: n // 10 for s, n in sizes.items()}, weights, 10**6)
    assert got[: len(want)] == want and slots[: len(want)] == list(range(len(want)))


def test_mixing_is_exact_over_many_slots(spark):
    weights = {"a": 0.02, "b": 0.9, "c": 0.08}
    d = spark.range(14_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.expr("if(id % 50 = 0, 'a', if(id % 12 = 1, 'c', 'b'))").alias("source"))
    rows = mixing.mix(d, weights, block_rows=1).select("source", "mix_slot").toPandas().sort_values("mix_slot")
    end = min(rows[rows.source == s].mix_slot.max() for s in weights)
    rows = rows[rows.mix_slot <= end]
    assert end > 10_000
    for s, w in weights.items():
        assert (np.abs((rows.source == s).cumsum() - w * (rows.mix_slot + 1)) < 1).all()


def test_mixing_in_turn_and_weights(spark):
    rows = [(i, "t", "abc"[min(2, i // 4)]) for i in range(12)] + [(12, "t", "c")]
    got, _ = sent_slots(mixing.mix(docs(spark, rows), block_rows=1).collect())
    assert got == ["a", "b", "c"] * 4 + ["c"]
    assert mixing.whole_weights({"a": 0.5, "b": 0.25, "c": 0.0}) == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 0.1234567, "b": 1.0})


def test_mixing_query_has_unequal_weights(spark):
    first = {}
    for r in queries.op9_pfair_mixing(spark, DATA).collect():
        first[r.source] = min(first.get(r.source, r.mix_slot), r.mix_slot)
    heavy, light = ([first[s] for s, w in queries.MIX_WEIGHTS.items() if w == x] for x in (4.0, 1.0))
    assert max(heavy) < min(light)


def test_mixing_odd_input(spark):
    rows = [(1, None, None), (1, None, None), (None, "t", "a"), (2, "", "a"), (3, "x", "left out")]
    d = docs(spark, rows).withColumn("mix_slot", F.lit("old"))
    out = mixing.mix(d, {"a": 1.0, "": 2.0}).collect()
    assert len(out) == 5 and max(out, key=lambda r: r.mix_slot).source == "left out"
    assert mixing.mix(d.limit(0)).count() == 0


# ---- pipeline


def test_pipeline(spark):
    scratch, d = shared.Scratch(spark, "p"), spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = d.columns, {r.doc_id for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = scratch.write(stage(spark, d, DATA), name.replace(" ", "_"))
        assert d.columns == columns
        now = {r.doc_id for r in d.collect()}
        assert now and now <= ids and d.count() == len(now)
        ids = now
    truth = near_truth([(r.doc_id, r.text) for r in d.collect()], 5, 80)
    assert all(kept for _, _, kept in truth.values())
    last = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(last.doc_id) == ids and (last.groupby("doc_id").length.sum() == last.groupby("doc_id").doc_tokens.first()).all()
