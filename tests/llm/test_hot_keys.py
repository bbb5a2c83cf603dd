"""Hot keys: hubs, repeated fingerprints and sources, against brute force; names that clash."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tesserae.llm import common, components, quality_rules, simhash, source_mixing


def test_components_with_hubs(spark):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 2000)] + [(5000, i) for i in range(4000, 5000)] + [(rng.randrange(6000, 9000), rng.randrange(6000, 9000)) for _ in range(1500)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_split_join_is_a_join(spark):
    left = spark.createDataFrame([(1, None), *((2, k) for k in range(300)), (None, 7)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 10)
    for hot in (1, 50, 1000):
        got = sorted((r.k or 0, r.v or 0, r.w or 0) for r in common.split_join(left, right, ["k"], "n", 302, hot).collect())
        assert got == sorted([(1, 0, 10), (0, 7, 0), *((2, k, 20) for k in range(300))])


def test_bit_sliced_distances_up_to_31():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.array([base[i % 4] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, i % 30).astype(np.uint64), initial=np.uint64(0)) for i in range(400)], np.uint64)
    group = np.sort(rng.integers(0, 3, 400))
    label = np.concatenate([np.sort(rng.integers(0, 3, (group == g).sum())) for g in range(3)])
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    for radius in (0, 3, 4, 7, 8, 15, 16, 24, 31):
        for of in (None, label):
            want = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and apart[i, j] <= radius and (of is None or of[i] != of[j])}
            got = [(int(i), int(j)) for a, b in simhash.close_pairs(fps, group, radius, of) for i, j in zip(a, b)]
            assert len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == want


def test_repeated_fingerprints(spark):
    rows = [(i, "the same words again" if i % 3 else f"other {i} words {i * 7} here") for i in range(2000)] + [(None, None), (3000, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in range(2000) if i % 3} == {1} and got[3000] == got[None] == 3000 and len(got) == 2002


def test_mixing_keeps_clashing_columns(spark):
    rows = [(i, f"s{i % 2}", 5, "a", "b", 1, 2, 3) for i in range(50)] + [(None, None, 4, "a", "b", 1, 2, 3)] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, u_source string, row string, mix_copies int, u_size int, docs int")
    out = source_mixing.realise(df, source_mixing.mixture(df))
    assert out.columns == ["doc_id", "source", "n_tokens", "u_source", "row", "u_size", "docs", "mix_copies", "mix_weight", "mix_place"]
    got = out.collect()
    assert len(got) == 90 and all((r.u_source, r.row, r.u_size, r.docs) == ("a", "b", 2, 3) for r in got)


def test_texts_under_one_id_are_kept_apart(spark):
    text = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(5, text), (5, other), (6, other + " more"), (5, text), (7, text), (None, text), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in P.distinct(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, text), (5, other), (None, text), (8, None)], key=str)


def test_verdicts_replace_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "a", 9, 9, True), (2, None, None, 9, 9, True)], "doc_id bigint, text string, source string, q_host int, host int, q_kept boolean")
    got = {r.doc_id: (r.q_kept, r.host, r.q_n_words) for r in quality_rules.judge(df).collect()}
    assert got == {1: (True, 9, 80), 2: (False, 9, 0)} and "q_host" not in quality_rules.judge(df).columns
