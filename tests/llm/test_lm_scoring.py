"""The language model's scores against brute force, on both ways that the filter reaches the texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import lm_scoring as lm

START, END = object(), ""


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")), END]


def brute(texts, train, level_of):
    """log10 probability of each text, with counts quantised as `level_of` tells."""
    one, two = Counter(), Counter()
    for t, learn in zip(texts, train):
        w = words_of(t)
        if learn:
            one.update(w)
            two.update(zip([START, *w], w))
    n, v, starts = sum(one.values()), len(one), one[END]
    out = []
    for t in texts:
        w, total = words_of(t), 0.0
        for a, b in zip([START, *w], w):
            before = starts if a is START else one[a]
            p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            pair = float(lm.counts_of(np.array([level_of((a, b), two)]))[0])
            total += math.log10((min(pair, before) + lm.MU * p) / (before + lm.MU))
        out.append(total)
    return out


def exact_level(pair, counts):
    return 1 + math.floor(math.log(counts[pair]) / math.log(lm.STEP) + 1e-9) if counts[pair] else 0


def corpus(n=400):
    rng = random.Random(5)
    vocabulary = ["a", "the", "of", "Cat", "dog", "é", "日本", "🙂", *(f"w{i}" for i in range(200))]
    texts = [" ".join(rng.choices(vocabulary, [200 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 80))) for _ in range(n)]
    texts += ["", " \t\n", None, texts[0], texts[0], "the " * 30_000]
    return texts, [i % 5 != 1 for i in range(len(texts))]


def scores(spark, texts, train, broadcast):
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, train))], "id int, text string, b boolean").repartition(3)
    rows = lm.score(df, F.col("b"), doc_id="id", broadcast=broadcast).collect()
    assert len(rows) == len(texts) and all(r.train == train[r.doc_id] for r in rows)
    return [r.score for r in sorted(rows, key=lambda r: r.doc_id)]


def test_score_equals_brute_force_with_the_filters_levels(spark):
    texts, train = corpus()

    def hash_of(pair):
        word = lambda w: np.uint64(xxhash.xxh64_intdigest(w, 7) >> 16)
        found, _ = lm.bigrams(np.array([word(pair[1])] if pair[0] is START else [word(pair[0]), word(pair[1])]), np.array([1 if pair[0] is START else 2]))
        return found[-1]

    two = Counter(p for t, b in zip(texts, train) if b for p in zip([START, *words_of(t)], words_of(t)))
    hashes = {p: hash_of(p) for t in texts for p in zip([START, *words_of(t)], words_of(t))}
    keys = sorted(two, key=hashes.__getitem__)
    segment = lm.Segment.build(np.array([hashes[p] for p in keys]), np.array([two[p] for p in keys]))
    levels = dict(zip(hashes, segment.levels(np.array(list(hashes.values()))).tolist()))
    assert np.allclose(scores(spark, texts, train, lm.BROADCAST), brute(texts, train, lambda p, _: levels[p]))
    # against the true quantised counts: a level too high now and then, never one too low
    exact = {p: exact_level(p, two) for p in hashes}
    assert all(levels[p] >= exact[p] for p in exact)
    truth = brute(texts, train, exact_level)
    size = [len(words_of(t)) for t in texts]
    assert np.mean([abs(a - b) / n for a, b, n in zip(scores(spark, texts, train, lm.BROADCAST), truth, size)]) < 0.03


def test_both_ways_give_equal_scores_in_many_blocks_and_segments(spark, monkeypatch):
    texts, train = corpus()
    whole = scores(spark, texts, train, lm.BROADCAST)
    for name, value in (("BLOCK", 4000), ("SEGMENT", 3000), ("WORDS", 1000)):
        monkeypatch.setattr(lm, name, value)
    # both calls cut the same segments, so they hold the same bits
    shared, sent = scores(spark, texts, train, lm.BROADCAST), scores(spark, texts, train, 0)
    assert shared == sent
    assert np.mean([abs(a - b) / len(words_of(t)) for a, b, t in zip(shared, whole, texts)]) < 0.05


def test_filter_stays_under_its_bound():
    rng = np.random.default_rng(3)
    for shape in (0.5, 1.0, 3.0):
        counts = np.maximum(1, (rng.pareto(shape, 5000) * 2).astype(np.int64)).clip(max=10**6)
        hashes = np.sort(rng.choice(1 << 48, len(counts), replace=False).astype(np.uint64))
        assert lm.Segment.build(hashes, counts).bits.nbytes <= lm.filter_bound(int(counts.sum())) + 8


def test_ids_of_any_type_and_repeats(spark):
    df = spark.createDataFrame([("a", "x y", 1), ("a", "x y", 2), (None, None, 3)], "doc_id string, text string, score int")
    rows = lm.score(df, F.lit(True)).collect()
    assert sorted((r.doc_id or "", r.n_tokens) for r in rows) == [("", 1), ("a", 3), ("a", 3)]
    assert len({r.score for r in rows if r.doc_id}) == 1
