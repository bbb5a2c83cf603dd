"""Corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe, bpe_codec, html_text, license_scan, lm_scoring, quality_rules, simhash, source_mixing, token_counts, top_k, toxicity
from tesserae.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor " * 20_000
ODD = [None, "", " ", "\n\n", "one", "A b\tC\x0bd\x85e", "é 日本 🙂  two", "the same text", "the same text", LONG, "x" * 5000, "<|endoftext|> MIT License #*", "a b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "en", None if i % 4 == 0 else f"s{i % 2}", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[7:9], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


# --- BPE and edits


def test_bpe_equals_the_library():
    library, encoder, decoder = Tokenizer.from_file(PATH), bpe.encoder(PATH), bpe.Decoder(bpe.vocabulary(PATH))
    rng = random.Random(1)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "'ll", "é", "日本", "12", "<|endoftext|>", "!!", "\x85", "\t", "🙂", "x" * 9, "\x1c"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    encoder.learn(texts)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == want
        assert decoder.decode(np.array(want)) == library.decode(want, skip_special_tokens=False)


def test_transducer_keeps_to_its_lookahead():
    v, rng = bpe.vocabulary(PATH), random.Random(2)
    tokens = list(v.bytes_of.values())
    for _ in range(15):
        data = b"".join(rng.choice(tokens) for _ in range(2000))
        assert list(v.transduce([data[i : i + 700] for i in range(0, len(data), 700)])) == v.merge(data)


def test_decoder_state_machine_on_broken_bytes():
    v = bpe.vocabulary(PATH)
    ids = [v.byte_ids[b] for b in b"a\xf0\x9fz\xe2\x82\xac\xff"]
    assert bpe.Decoder(v).decode(np.array(ids)) == Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)


def test_codec_on_odd_rows(odd, nothing):
    out = bpe_codec.round_trip(odd.withColumn("ids", F.lit("old"))).collect()
    assert len(out) == odd.count()
    assert all(r.decoded == (r.text or "") for r in out)
    assert bpe_codec.digests(bpe_codec.round_trip(nothing)).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(odd)).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_token_tree_follows_edits():
    encoder, rng = bpe.encoder(PATH), random.Random(3)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "é", "12", "!!", " \n", "word"]
    for _ in range(120):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 500)))
        tree = token_counts.TokenTree(text, encoder)
        for _ in range(5):
            at, remove, insert = rng.randint(0, len(text) + 2), rng.choice([0, 1, 7, 300]), rng.choice(["", " ", "'", "s", " it's", "w " * 90])
            tree.edit(at, remove, insert)
            at = min(at, len(text))
            text = text[:at] + insert + text[at + remove :]
            assert tree.text() == text
            assert [x for leaf in tree.leaves for x in leaf] == bpe.PRETOKEN.findall(text)
            assert tree.n_tokens == sum(len(encoder.pretoken[x]) // 4 for x in bpe.PRETOKEN.findall(text))


def test_edits_touch_little_and_odd_rows_pass(odd, nothing):
    edited = token_counts.count_with_edits(odd.withColumn("edits", token_counts.revision(F.length(F.coalesce("text", F.lit(""))))))
    rows = edited.collect()
    assert len(rows) == odd.count()
    assert next(r for r in rows if r.text == LONG).n_reencoded < 60
    assert token_counts.count_with_edits(nothing.withColumn("edits", token_counts.revision(F.length("text")))).count() == 0
    none = token_counts.count_with_edits(odd.withColumn("edits", F.lit(None).cast(f"array<{token_counts.EDIT.simpleString()}>"))).collect()
    assert all(r.tokens_before == r.tokens_after for r in none)


# --- language model


def brute_base(texts, train):
    counts = Counter()
    for t, use in zip(texts, train):
        if use:
            counts.update(ascii_words(t) + [None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        tokens = ascii_words(t) + [None]
        out.append((len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


@pytest.mark.parametrize("bound", [lm_scoring.BROADCAST, 0])
def test_lm_base_is_exact_both_ways(odd, bound):
    rows = lm_scoring.score(odd, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False)), broadcast=bound).collect()
    texts, ids = [*ODD, *ODD[7:9]], [*(i if i != 3 else None for i in range(len(ODD))), 7, 8]
    want = sorted((i if i is not None else -1, *b) for i, b in zip(ids, brute_base(texts, [i is not None and i % 3 != 1 for i in ids])))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_lm_filter_never_reads_low_and_seldom_high():
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64))
    counts = np.maximum(1, (rng.pareto(1.0, len(hashes)) * 2).astype(np.int64))
    s = lm_scoring.Segment.build(hashes, counts)
    told = lm_scoring.counts_of(s.levels(hashes))
    assert (told >= counts / lm_scoring.STEP - 1).all()
    assert (told > counts * lm_scoring.STEP + 1).mean() < 0.2
    assert (s.levels(rng.integers(1 << 48, 1 << 49, 20_000, dtype=np.uint64)) > 0).mean() < 0.02


def test_lm_without_training_rows(odd, nothing):
    rows = lm_scoring.score(odd, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in rows} == {(0, 0)} and all(r.base_score == 0 for r in rows)
    assert lm_scoring.score(nothing, F.lit(True)).count() == 0


def test_lm_prefers_what_it_has_seen(spark):
    rows = [(i, "the cat sat on the mat today") for i in range(50)] + [(100, "the cat sat on the mat today"), (101, "mat the on today cat the sat")]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 100).collect()}
    assert got[100] > got[101] + 2


# --- quality rules


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, nothing):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "c", " ", "\n", " x ", "#", "é"]) for _ in range(rng.randint(0, 200))) for _ in range(200)] + [t for t in ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in quality_rules.measures(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
    judged = quality_rules.judge(odd.withColumn("host", F.lit(1)).withColumn("rate", F.lit(2))).collect()
    assert len(judged) == odd.count() and all(r.q_kept is not None for r in judged)
    assert quality_rules.judge(nothing).count() == 0


def test_bad_hosts_take_soft_failures_with_them(spark):
    good = " ".join(f"w{i}" for i in range(60))
    messy = " ".join(f"w{i}#####" for i in range(60))
    rows = [(i, messy, "bad") for i in range(95)] + [(200 + i, good, "bad") for i in range(5)] + [(1000 + i, good, f"g{i % 7}") for i in range(300)] + [(5000, messy, "g1")]
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not out[3].q_kept and out[201].q_kept and out[1000].q_kept and out[5000].q_kept
    assert out[3].q_host_rate > 0.5 > out[5000].q_host_rate


# --- SimHash


def test_close_pairs_equal_brute_force():
    rng = np.random.default_rng(6)
    for radius in (0, 3, 4, 7):
        n = 300
        f = rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, n)]
        for _ in range(5):
            f = np.where(rng.random(n) < 0.7, f ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), f)
        group = np.sort(rng.integers(0, 3, n))
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and bin(int(f[i] ^ f[j])).count("1") <= radius}
        got = [(int(a), int(b)) for i, j in simhash.close_pairs(f, group, radius) for a, b in zip(i, j)]
        assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)


def test_masks_leave_no_close_pair_apart():
    rng = random.Random(7)
    for n in (10, 1 << 24, 1 << 33):
        for radius in (4, 7):
            masks = simhash.bucket_masks(n, radius)
            for _ in range(300):
                d = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(d & m == 0 for m in masks)


def brute_components(prints):
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, f in prints:
            for j, g in prints:
                if bin(f ^ g).count("1") <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_near_duplicates_equal_brute_force(spark, odd, nothing):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)) for _ in range(12)]
    texts = []
    for t in base:
        for _ in range(5):
            words = t.split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    texts += [None, "", "  ", base[0], base[0]]
    rows = [(100 + 3 * i, t) for i, t in enumerate(texts)]
    want = brute_components([(i, simhash.fingerprint(t)) for i, t in rows])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(nothing).count() == 0


def test_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    fps = [0x1234 ^ (1 << (i % 60)) for i in range(60)] + [(1 << 62) | i * 0x0101010101 for i in range(40)]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(fps))], "fp bigint, rep bigint")
    got = {r.node: r.component for r in components(simhash.linked(df)).collect()}
    want = brute_components([(i, f) for i, f in enumerate(dict.fromkeys(fps))])
    assert {k: got.get(k, k) for k in want} == want


def test_fingerprint_definition():
    for t in ["", "A", "a B  c\td", "x y z w v u", "x\x85y z " * 5]:
        w = ascii_words(t)
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        assert simhash.fingerprint(t) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- licences


def test_licenses(spark, odd, nothing):
    lines = [
        "Released under the MIT License.", "see the mit-license and MIT LICENSE", "license mit", "GNU General Public License, version 3", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit licenses", None, "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [out[i].lic_n_base for i in range(9)] == [1, 2, 0, 1, 0, 0, 0, 0, 0]
    assert (out[1].lic_first_word, out[1].lic_last_word) == (2, 5)
    assert [out[i].lic_labels for i in range(9)] == ["mit", "mit", "", "gpl", "cc-by-nc", "mit", "", "", ""]
    assert 0.6 <= out[5].lic_score <= 1 and out[0].lic_score == 1 and out[8].lic_score == 0
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(nothing).count() == 0


def test_licenses_of_a_file_with_every_template(spark):
    every = ". ".join(text for _, text, _ in license_scan.TEMPLATES)
    out = license_scan.scan(spark.createDataFrame([(1, every), (2, "bare words")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert out[0].lic_labels.split(",") == sorted({label for label, _, _ in license_scan.TEMPLATES})
    # without a base phrase the score is the best of all templates, not of those whose words are looked up
    bsd, isc, domain = (next(text for label, text, _ in license_scan.TEMPLATES if label == x) for x in ("bsd", "isc", "public-domain"))
    row = license_scan.scan(spark.createDataFrame([(1, ". ".join([bsd, isc, domain]))], "doc_id bigint, text string")).first()
    assert (row.lic_labels, row.lic_score) == ("bsd,isc,public-domain", 1.0)


# --- HTML

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies ok</div>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><main><article><h1>A &amp; B</h1><p>First <i>par</i>agraph &lt;x&gt; with&nbsp;words and more words.</p>
<div class="advert">Buy now!</div><p>Second one has a <a href=x>link</a> in it, yes.<form><input>Email <button>go</button></form><p>Third<!-- c --> end.</p></article>
<section class="comments"><p>Nice post! I really like it very much indeed, thanks</p></section></main><aside>Side</aside><footer>&copy; Foot</footer><script>var a="</p>";</script></body></html>"""


def test_html():
    w = html_text.weights_from(html_text.count_types(PAGE) + html_text.count_types(PAGE.replace("Third", "Third and many more words of the article " * 5)))
    assert html_text.main_text(PAGE, w) == "A & B First paragraph <x> with words and more words. Second one has a link in it, yes. Third end."
    for page in (None, "", "<", "<p", "</div></div>", "<script>", "<!--", "<a href='"):
        assert isinstance(html_text.main_text(page, w), str)
    assert html_text.main_text("just words", w) == "just words"


def test_insets_do_not_part_an_article():
    inset = "<div class='advert'>" + "<p>buy now and more of it</p>" * 12 + "</div>"
    page = "<body><article><p>Short lead</p>" + inset + "<p>" + "Words of the article stand here. " * 10 + "</p>" + inset + "<p>Last words</p></article></body>"
    text = html_text.main_text(page, html_text.DEFAULT)
    assert text.startswith("Short lead Words") and text.endswith("here. Last words") and "buy" not in text


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, "u", None, "old"), (2, "u", None, "old")], "page_id bigint, url string, html string, main_text string")
    assert [r.main_text for r in html_text.extract(df).orderBy("page_id").collect()][1:] == ["", ""]
    assert html_text.extract(df.where("false")).count() == 0


# --- toxicity


def test_toxicity_held_out(spark, odd, nothing):
    rng = random.Random(9)
    clean = [f"w{i}" for i in range(400)]
    insults = ["foozle", "barflug", "quxnar", "zibble"]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(clean) for _ in range(80)]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(insults) + rng.choice(["", "s", "ly"])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    truth = dict(labels)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = toxicity.toxicity(docs, known).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.tox_predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.tox_score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(math.isclose(again[r.doc_id], r.tox_score, rel_tol=1e-9) for r in out)  # held-out labels are never read
    assert all(0 <= r.tox_score <= 1 for r in toxicity.toxicity(odd, known).collect())
    assert toxicity.toxicity(nothing, known).count() == 0
    assert {r.tox_predicted for r in toxicity.toxicity(odd, known.where("false")).collect()} == {0}


def test_label_model_finds_the_classes_and_pairs():
    rng = np.random.default_rng(10)
    y = rng.random(20_000) < 0.1
    fires = np.where(y[:, None], rng.random((20_000, 10)) < 0.6, rng.random((20_000, 10)) < 0.02)
    fires[:, 1] = fires[:, 0] ^ (rng.random(20_000) < 0.02)  # repeats voter 0
    patterns, n = np.unique((fires << np.arange(10)).sum(axis=1), return_counts=True)
    m = toxicity.LabelModel(patterns, n.astype(float), 0.1)
    assert (0, 1) in m.groups and abs(m.prior - y.mean()) < 0.02
    assert ((m.posterior((fires << np.arange(10)).sum(axis=1)) > 0.5) == y).mean() > 0.98


# --- top-k


def test_top_k(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 4]) for i in range(2600)]
    rows += [(None, [0.0] * 8), (9001, None), (9002, [1.0, None] * 4), (9003, [float("nan")] * 8), (9004, [float("inf")] * 8), (9005, []), (9100, [1.0, 2.0]), (9101, [0.5, 0.5]), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect())
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 100 == 0:
            q = [math.floor(1024 * x) for x in v]
            best = sorted((-sum(x * math.floor(1024 * y) for x, y in zip(q, u)), j) for b, (j, u) in enumerate(good) if b != a and len(u) == len(v))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert top_k.top_k(df.where("false"), F.lit(True)).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(12)
    blocks = []
    for b in range(20):
        m = rng.integers(0, 10, (64, 4)) + 100 * b
        blocks.append(top_k.Block(np.arange(64, dtype=np.int64).tobytes(), (np.arange(64) + 64 * b).astype(np.int64).tobytes(), m.astype(np.int64).tobytes(), 4))
    q = top_k.Block(np.array([1], np.int64).tobytes(), np.array([-1], np.int64).tobytes(), np.array([[1, 1, 1, 1]], np.int64).tobytes(), 4)
    assert top_k.search(q, blocks, 5)[2] == 1


# --- mixing


def test_mixture_meets_its_targets(spark, odd, nothing):
    rng = random.Random(13)
    rows = [(i, f"s{min(int(rng.paretovariate(0.8)), 9)}", rng.randint(1, 60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    m = source_mixing.mixture(df, flatten=0.5, most_epochs=3.0)
    w = {r.source: r for r in m.collect()}
    assert math.isclose(sum(r.weight for r in w.values()), 1.0, rel_tol=1e-9)
    assert max(r.budget / r.tokens for r in w.values()) <= 3.01
    used = source_mixing.realise(df, m).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("n_tokens")).alias("u"), F.max("n_tokens").alias("t")).collect()
    assert all(abs(r.u - w[r.source].budget) <= r.t for r in used)
    assert source_mixing.mix(odd).count() == odd.count()
    assert source_mixing.mix(nothing).count() == 0


def test_exponent_is_least(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    h = lambda a: -sum(p * math.log(p) for p in [x**a / sum(y**a for y in (0.7, 0.2, 0.1)) for x in (0.7, 0.2, 0.1)])
    a = source_mixing.solve_exponent(shares, flatten=0.5, most_epochs=100.0)
    assert abs(h(a) - (h(1) + 0.5 * (h(0) - h(1)))) < 1e-6
    assert source_mixing.solve_exponent(shares, flatten=1.0, most_epochs=1e9) == 0.0
    assert source_mixing.solve_exponent(shares, flatten=0.0, most_epochs=1e9) == pytest.approx(1.0)
