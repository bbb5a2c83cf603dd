"""The engine's own operators against published values, definitions and brute force."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import codepoints, coords, identity, json_values, ratings, segments, shapes, sphere, tensors, vertex
from tesserae.operators import consensus, directions, graphs, paths, registry, text, vectors
from tesserae.sources import containers, wire


# --- identity and text


def test_blake3_published_values():
    message = lambda n: bytes(i % 251 for i in range(n))
    got = [x.hex() for x in identity.hash_many([b"", message(1025), message(3072)])]
    assert got == ["af1349b9f5f9a1a6a0404dea36dcc949", "d00278ae47eb27b34faecf67b4fe263f", "b98cb0ff3623be03326b373de6b90952"]


def root(value):
    store = identity.Composer()
    node = segments.decompose(value, store)
    return store.ids()[node].hex(), store, node


def test_golden_ids():
    assert root("A")[0] == "32684bfa28c0c84d6f210511aace0efc"
    assert root("Holmes")[0] == "5b7e40e9a23ae55eaccd45646934977d"
    assert root("ADJ")[0] == "d88366c648b9e04d7a2c3365b1921025"


def shape(store, node):
    part = store.parts[node]
    return part if isinstance(part, str) else tuple(shape(store, c) for c in part)


@pytest.mark.parametrize(
    "value, tree, tier",
    [("banana", ("b", ("a", "n"), ("a", "n"), "a"), 2), ("aaaa", ("a",) * 4, 1), ("cababcabab", (("c", ("a", "b"), ("a", "b")),) * 2, 3)],
)
def test_factoring(value, tree, tier):
    _, store, node = root(value)
    assert shape(store, node) == tree and store.tier[node] == tier


def test_squares_equal_the_definition():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.choice((1, 2, 3)[: rng.choice((2, 3))]) for _ in range(rng.randint(0, 110))]
        want = [next((p for p in range(2, (len(s) - i) // 2 + 1) if s[i : i + p] == s[i + p : i + 2 * p] and len(set(s[i : i + p])) > 1), 0) for i in range(len(s))]
        assert identity.squares(s) == want


def count_segments(value):
    seen = []
    segments.decompose(value, identity.Composer(), lambda *x: seen.append(x))
    return len(seen)


def test_segments():
    assert count_segments("a banana café microsoft.com") == 9
    assert count_segments("3.14 can't word_1") == 11


ODD_TEXTS = ["a\u0301b c\u00add", "x\U0001f469\u200d\U0001f680y", "\u30ab\u30bf\u30ab\u30ca. \u6f22\u5b57\u3002\u3000\u3000x", "\U0001f1e9\U0001f1ea\U0001f1eb", "it's 3.14_a\u2019b", "one\ntwo\r\nthree. Four\r\n\r\nfive", " \t ", "e.g. this? No! (Yes.) 1.5 U.S.A. end.\u0085x", "\r", ""]


def test_letters_are_the_leaves(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD_TEXTS, None, "ababab"])], "key int, text string").repartition(3)
    leaves = {r.letter for r in text.edges(df, "text").where("letter is not null").collect()}
    got = [r.letter for r in text.letters(df, "text").collect()]
    assert sorted(got) == sorted(leaves) and set(got) == set("".join(ODD_TEXTS) + "ab")


def test_letters_build_no_trees(spark, monkeypatch, sf_dir):
    import __spark_entry__ as entry

    monkeypatch.setattr(text, "edges", None)
    assert entry.queries()["text_letters"](spark, sf_dir).count() > 50


def test_entities_are_those_of_the_edges(spark):
    texts = [*ODD_TEXTS, None, "ababab", "a  b  a  b. a  b  a  b.", "one two one two three", "ababab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, text string").repartition(3)
    made = text.text_entities(df, "text")
    assert sorted(map(str, made.collect())) == sorted(map(str, text.entities(text.edges(df, "text")).collect()))
    # sums of fixed width are hashed; nothing is sorted
    assert "Sort" not in made._jdf.queryExecution().executedPlan().toString()


def test_packed_compositions_are_the_edges_and_come_back(spark):
    texts = [*ODD_TEXTS, None, "ababab", "a  b  a  b. a  b  a  b.", "one two one two three", "ababab", "x", "word", "y" * 300, "so so so. " * 40, "ab" * 200 + ". End", "A b. A b. A b. C"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, text string").repartition(3)
    nodes = text.packed(df, "key", "text")
    rows = lambda d: sorted(map(str, d.select("parent", "ordinal", "child", "run", "tier", "letter").collect()))
    assert rows(text.unpacked(nodes)) == rows(text.edges(df, "text"))
    assert nodes.where("who is null").count() == nodes.where("who is null").select("id").distinct().count()
    # a key twice stays twice
    twice = text.packed(df.unionAll(df), "key", "text")
    want = sorted([(i, t or None) for i, t in enumerate(texts)] * 2)
    assert sorted(map(tuple, text.realized_packed(twice, "key").collect())) == want


def test_texts_in_arrays_have_the_same_trees():
    rng = random.Random(6)
    for _ in range(60):
        own = rng.sample([*"aAbB  ..,'!?1\n\r\t-_\u00e9\u0301\u30ab\u200d\U0001f600"], rng.randint(2, 16)) + ["ab ", "c. "]
        texts = [None, "", *("".join(rng.choice(own) for _ in range(rng.randint(0, 200))) for _ in range(4))]
        a, b = identity.Composer(), identity.Composer()
        one = [segments.decompose(t, a) if t else None for t in texts]
        many = segments.decompose_many(texts, b)
        assert [r if r is None else a.ids()[r] for r in one] == [r if r is None else b.ids()[r] for r in many]
        trees = [{s.ids()[n]: (s.tier[n], p if isinstance(p, str) else [s.ids()[c] for c in p]) for n, p in enumerate(s.parts)} for s in (a, b)]
        assert trees[0] == trees[1]


def test_segment_lists_are_the_trees_words(spark, sf_dir):
    import __spark_entry__ as entry

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD_TEXTS, None])], "key int, text string")
    want = {}
    for i, t in enumerate(ODD_TEXTS):
        store, seen = identity.Composer(), []
        segments.decompose(t, store, lambda *x: seen.append(x))
        ids = store.ids()
        want |= {(i, k): (o, n, ids[node]) for k, (o, n, node) in enumerate(seen)}
    got = {(r.key, r.pos): (r.offset, r.length, bytes(r.id)) for r in text.segments(df, "key", "text").collect()}
    assert got == want
    # a list a text, and nothing is dealt out or gathered
    plan = entry.queries()["text_segments"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_plain_segments_are_those_of_all_rules():
    rng = random.Random(5)
    for _ in range(400):
        t = "".join(rng.choice("ab c.\n?\u00e9\u00df1'\r\t\u2019\u4e2d\u05d0_ ") for _ in range(rng.randint(1, 80)))
        shown = segments.blanked(t)
        cuts = sorted({x for span in (*segments.word_spans(shown), *segments.sentences(shown)) for x in span})
        assert segments.cut_up(t)[2] is None and segments.words(t) == [t[a:b] for a, b in zip(cuts, cuts[1:])]
        assert segments.lengths(t) == [len(t[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


def test_texts_come_back():
    rng = random.Random(2)
    store = identity.Composer()
    for _ in range(300):
        t = "".join(rng.choice("ab c.\n?é1'\r") for _ in range(rng.randint(0, 150)))
        assert segments.realize(segments.decompose(t, store), store) == t


def test_edges_and_realization(spark):
    df = spark.createDataFrame([(1, "ababab é. New one!\n\nAnother paragraph."), (2, None), (3, ""), (4, "ababab"), (5, "x")], "key int, text string")
    back = text.realized(text.text_ids(df, "key", "text"), text.edges(df, "text"))
    assert {r.key: r.text for r in back.collect()} == {1: "ababab é. New one!\n\nAnother paragraph.", 2: None, 3: None, 4: "ababab", 5: "x"}


def test_fnv():
    assert identity.fnv1a(b"") == 0xCBF29CE484222325 and identity.fnv1a(b"a") == 0xAF63DC4C8601EC8C


# --- coordinates


def test_hilbert_round_trip_and_steps():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 65536, (5000, 4))
    h = coords.encode(g)
    assert (coords.decode(h) == g).all()
    h = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    assert (np.abs(coords.decode(h) - coords.decode(h + np.uint64(1))).sum(axis=1) == 1).all()


def test_axis(spark):
    values = [(0.5 - 2.0**-53, 49151), (-(2.0**-1074), 32767), (2.0**-1074, 32768), (-math.inf, 0), (math.inf, 65535)]
    got = [r.g for r in spark.createDataFrame([(i, v) for i, (v, _) in enumerate(values)], "i int, x double").orderBy("i").select(coords.grid_of(F.col("x")).alias("g")).collect()]
    assert got == [g for _, g in values]


def test_mean_truncates_and_wall_is_exact(spark):
    df = spark.createDataFrame([(7,), (-7,), (1,)], "m bigint").select("m", (-F.col("m")).alias("w"))
    r = df.agg(coords.mean(F.col("m")).alias("m"), coords.mean(F.col("w")).alias("w")).first()
    assert (r.m, r.w) == (0, 0)
    r = spark.createDataFrame([(7,), (0,), (0,)], "m bigint").agg(coords.mean(F.col("m")).alias("m"), coords.mean(-F.col("m")).alias("w")).first()
    assert (r.m, r.w) == (2, -2)
    one = coords.ONE
    rows = spark.createDataFrame([(one, 0), (one, 1), (one + 1, 0), (-(2**63), -(2**63))], "a bigint, b bigint")
    assert [r.ok for r in rows.select(coords.inside([F.col("a"), F.col("b"), F.col("b"), F.col("b")]).alias("ok")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("cap", [1, 8, 64])
def test_covers_hold_everything(cap):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 65536, (4000, 4))
    keys = coords._key(coords.encode(g))
    for _ in range(4):
        lo = rng.integers(0, 50000, 4)
        hi = lo + rng.integers(0, 15000, 4)
        ranges = coords.box_ranges(list(lo), list(hi), cap)
        assert len(ranges) <= cap and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        inside = ((g >= lo) & (g <= hi)).all(axis=1)
        covered = np.any([(keys >= a) & (keys <= b) for a, b in ranges], axis=0)
        assert (covered | ~inside).all()
        center, r = rng.uniform(-0.5, 0.5, 4), 0.4
        x = (g + 0.5) / 32768 - 1
        near = (((x - center) ** 2).sum(1) <= r * r) & ((x**2).sum(1) <= 1)
        covered = np.any([(keys >= a) & (keys <= b) for a, b in coords.ball_ranges(list(center), r, cap)], axis=0)
        assert (covered | ~near).all()


def test_codepoint_table(spark):
    t = codepoints.build(spark, 2048).cache()
    assert codepoints.faults(t).first().asDict() == {"ids": 0, "ranks": 0, "outside": 0, "order": 0}
    assert codepoints.branch(t, "ascii").count() == 128
    assert codepoints.branch(t, "utf").count() == 2048 - codepoints.branch(t, "cjk").count() + codepoints.branch(t, "utf").count() - (2048 - codepoints.branch(t, "cjk").count())


# --- paths and vertices


def test_run_pairs_equal_expansion(spark):
    rng = random.Random(5)
    rows = [(s, p, rng.choice("ab") if rng.random() < 0.7 else "c") for s in range(4) for p in range(40)]
    df = spark.createDataFrame(rows, "seq int, ord int, id string")
    want = {}
    for s in range(4):
        ids = [i for q, _, i in rows if q == s]
        for g in range(1, 9):
            for a, b in zip(ids, ids[g:]):
                want[a, b, g] = want.get((a, b, g), 0) + 1
    got = {(r.a, r.b, r.gap): r.times for r in paths.run_pairs(paths.runs(df), 1, 8).collect()}
    assert got == want


def test_vertex_fields(spark):
    row = spark.range(1).select(vertex.pack(F.lit(0), F.lit(9), F.lit(2), F.lit(1 << 20)).cast("double").alias("m"))
    r = row.select(vertex.run(F.col("m")).alias("r"), vertex.said(F.col("m")).alias("s"), vertex.outcome(F.col("m")).alias("o"), vertex.position(F.col("m")).alias("p")).first()
    assert tuple(r) == (1, 1, 2, (1 << 18) - 1)
    back = spark.createDataFrame([(0.25,), (0.5,), (1.5,), (-1.0,), (float("nan"),)], "s double").select(vertex.score_carried(F.col("s")).alias("c"))
    assert [r.c for r in back.collect()] == [0.25, 0.5, 1.0, 0.0, 1.0]


# --- shapes and sphere


def test_shapes():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(12, 4))
    stray = a.copy()
    stray[5] += 9
    assert shapes.frechet(a, a) == 0 and shapes.frechet(a, stray) > 8 and shapes.frechet(a, stray, 1) < shapes.frechet(a, stray)
    assert shapes.dtw(a, a) == (0.0, 12) and shapes.edr(a, stray, 0.1) == 1 and shapes.edr(a, a[:0], 1.0) == 12
    assert shapes.frechet(a, a[:0]) == math.inf and shapes.dtw(a[:0], a) == (math.inf, 0)
    b = rng.normal(size=(9, 4))
    d = np.full((13, 10), 99)
    d[0], d[:, 0] = np.arange(10), np.arange(13)
    for i in range(12):
        for j in range(9):
            d[i + 1, j + 1] = min(d[i, j] + (math.dist(a[i], b[j]) > 1.5), d[i, j + 1] + 1, d[i + 1, j] + 1)
    assert shapes.edr(a, b, 1.5) == d[12, 9]


def test_sphere_means(spark):
    ring = np.array([[math.cos(t), math.sin(t), 0, 0] for t in np.arange(6) / 40])
    rows = [("ring", *map(float, p)) for p in ring] + [("lone", 0.0, 0.0, 3.0, 0.0), ("nowhere", 0.0, 0.0, 0.0, 0.0), (None, 2.0, 0.0, 0.0, 0.0)]
    rows += [("even", 1.0, 0.0, 0.0, 0.0), ("even", -1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, d double")
    got = {r.k: r.karcher for r in directions.karcher_means(df, "k", list("abcd")).collect()}
    large = {r.k: r.karcher for r in directions.karcher_means(df, "k", list("abcd"), gathered=1).collect()}
    assert got.keys() == large.keys() and all(a is b or np.allclose(a, b, atol=1e-11) for a, b in ((got[k], large[k]) for k in got))
    assert np.allclose(got["ring"], [math.cos(2.5 / 40), math.sin(2.5 / 40), 0, 0], atol=1e-11)
    assert got["lone"] == [0, 0, 1, 0] and got["nowhere"] is None and got["even"] == [-1, 0, 0, 0]
    axis = {r.k: r.eigen for r in directions.dominant_directions(df, "k", list("abcd")).collect()}
    assert np.allclose(axis["ring"], got["ring"], atol=1e-3) and axis["nowhere"] is None
    assert np.allclose(np.abs(sphere.dominant(ring.T @ ring)), np.abs(got["ring"]), atol=1e-3)


def test_angles(spark):
    e = [[1.0, 0.0, 0.0, 0.0], [0.0, 2.0, 0.0, 0.0], [-3.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(e[0], x) for x in e], "a array<double>, b array<double>")
    got = [r.t for r in df.select(sphere.angle(sphere.point(F.col("a")), sphere.point(F.col("b"))).alias("t")).collect()]
    assert got[0] == 0 and math.isclose(got[1], math.pi / 2) and math.isclose(got[2], math.pi) and math.isnan(got[3])


# --- vectors


def test_knn_ties_and_rowsig(spark):
    rng = np.random.default_rng(8)
    v = [[float(x) for x in rng.integers(-2, 3, 5)] for _ in range(90)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v + v)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in vectors.knn(df.where("vec_id < 20"), df, 5).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r.d2, r.id)
    for q in range(20):
        want = sorted((sum((x - y) ** 2 for x, y in zip(v[q], u)), i) for i, u in enumerate(v + v))[:5]
        assert [got[q][k + 1] for k in range(5)] == want
    assert vectors.knn(df, df.where("false"), 3).count() == 0


def test_dense_algebra():
    n = 24
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[(i + 1) % n, i] = 1
    values, _ = vectors.eigenmap(w, 2)
    assert np.allclose(values, 1 - math.cos(2 * math.pi / n))
    rng = np.random.default_rng(9)
    a = rng.normal(size=(40, 4))
    q = vectors.orthonormal_rows(rng.normal(size=(4, 4)))
    q[0] *= np.sign(np.linalg.det(q))
    rotation, scale = vectors.procrustes(a, 2.5 * a @ q)
    assert np.allclose(rotation, q) and math.isclose(scale, 2.5)
    assert vectors.orthonormal_rows(np.array([[1.0, 0], [2.0, 0]])) is None


# --- ratings


def test_published_rating_period():
    r = ratings.rate((1500, 200, 0.06), np.array([[1400, 30], [1550, 100], [1700, 300]]), np.array([1.0, 0.0, 0.0]))
    assert np.allclose(r, (1464.05, 151.52, 0.05999), atol=0.01)


def test_series_goldens():
    s = ratings.series([10**6], [10**6], [0.85])
    assert math.isclose(s["rating"], 1832.827344606, abs_tol=1e-6) and math.isclose(s["deviation"], 170.547513798, abs_tol=1e-6)
    s = ratings.series([10**6] * 2, [10**6] * 2, [0.85] * 2)
    assert math.isclose(s["rating"], 1877.652957569, abs_tol=1e-6) and math.isclose(s["deviation"], 128.453983205, abs_tol=1e-6)
    again = ratings.series([3, 5, 8], [1, 5, 2], [0.3, 0.9, 0.5])
    turned = ratings.series([8, 3, 5], [2, 1, 5], [0.5, 0.3, 0.9])
    assert again["rating"] == turned["rating"] and again["deviation"] == turned["deviation"]


def test_witness_series_goldens(spark):
    want = {1: (1663.04, 259.40), 30: (1946.43, None), 1000: (2008.88, None), 10**6: (2011.50, 152.60)}
    df = spark.createDataFrame([(n,) for n in want], "n bigint")
    for r in df.select("n", ratings.attest_series(F.lit(1500.0), F.lit(350.0), F.lit(0.9), F.col("n"), F.lit(1.0)).alias("s")).collect():
        rating, deviation = want[r.n]
        assert abs(r.s.rating - rating) < 0.01 and (deviation is None or abs(r.s.deviation - deviation) < 0.01)


def test_costs(spark):
    df = spark.createDataFrame([(1774.3, 93.3), (1675.1, 247.2)], "r double, d double").select(ratings.confidence(F.col("r"), F.col("d")).alias("c"), ratings.cost(F.col("r"), F.col("d")).alias("p")).collect()
    assert abs(df[0].c - 0.624) < 1e-3 and abs(df[0].p - 0.472) < 1e-3 and abs(df[1].p - 1.986) < 1e-3


def test_shares(spark):
    df = spark.createDataFrame([("g", m, 1.0) for m in "cab"] + [("z", "a", 0.0)], "g string, m string, w double")
    assert {(r.g, r.m): r.share for r in consensus.shares(df, "g", "m", "w").collect()} == {("g", "a"): 3334, ("g", "b"): 3333, ("g", "c"): 3333, ("z", "a"): 0}


# --- graphs


def test_dag(spark):
    e = spark.createDataFrame([(0, 1, 2, 1), (0, 2, 1, 1), (1, 3, 3, 1), (2, 3, 1, 1)], "parent bigint, child bigint, times int, distance int")
    nodes = spark.range(4).withColumnRenamed("id", "node")
    assert {r.node: int(r.paths) for r in graphs.path_counts(e, nodes.where("node = 0")).collect()} == {0: 1, 1: 2, 2: 1, 3: 7}
    assert {r.node: r.level for r in graphs.levels(e, nodes).collect()} == {0: 2, 1: 1, 2: 1, 3: 0}
    assert {r.node: r.wave for r in graphs.order(e, nodes).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    ring = e.union(spark.createDataFrame([(3, 0, 1, 1)], e.schema))
    for refused in (lambda: graphs.levels(ring, nodes), lambda: graphs.path_counts(ring, nodes)):
        with pytest.raises(graphs.CycleError):
            refused()
    assert {r.component for r in graphs.strong_components(ring, nodes).collect()} == {0}


# --- registries, JSON


def test_masks(spark):
    row = spark.range(1).select(registry.put(registry.put(F.lit(0).cast("bigint"), "upos", F.lit(12)), "kind", F.lit(2)).alias("m"))
    r = row.select("m", registry.get(F.col("m"), "upos", 17).alias("u"), registry.get(F.col("m"), "kind", 4).alias("k"), registry.get(F.col("m"), "upos", 5).alias("x"), registry.put(F.col("m"), "kind", F.lit(8)).alias("y")).first()
    assert (r.m, r.u, r.k, r.x, r.y) == (13 << 8 | 4, 12, 2, -1, None)
    m = spark.createDataFrame([(1, 13 << 8), (1, 13 << 8 | 1), (2, 1 << 8), (2, 2 << 8), (3, 1 << 60)], "k int, m bigint")
    assert {r.k: r["mask"] for r in registry.merged(m, "k", "m").collect()} == {1: 13 << 8 | 1, 2: None, 3: None}


@pytest.mark.parametrize("doc", ['{"a":1,"a":2}', "[]", "-0.5e+3", '"\\ud800"', " true ", "[" * 256 + "]" * 256])
def test_json_accepted(doc):
    json_values.parse(doc)


@pytest.mark.parametrize("doc", ["", "01", "+1", "1.", "[1,]", "{a:1}", "NaN", "Infinity", '"\t"', "[1] 2", "[" * 257 + "]" * 257, "'a'"])
def test_json_refused(doc):
    with pytest.raises((ValueError, RecursionError)):
        json_values.parse(doc)


def test_json_values(spark):
    df = spark.createDataFrame([('{"a":1,"b":1.5,"c":true,"a":2}',)], "j string")
    j = F.col("j")
    r = df.select(json_values.member(j, "a").alias("a"), json_values.integer(j, "b", 7).alias("b"), json_values.number(j, "b").alias("n"), json_values.flag(j, "c").alias("c"), json_values.kind(j).alias("k")).first()
    assert tuple(r) == ("1", 7, 1.5, True, "object")
    assert json_values.written_double(-0.0) == "0" and json_values.written_double(0.1) == "0.10000000000000001" and json_values.written_double(math.inf) == "null"


# --- tensors, containers, wire


def test_plain_types():
    assert tensors.decode(struct.pack("<3e", 1.5, -2, 65504), "F16").tolist() == [1.5, -2, 65504]
    assert tensors.decode(b"\x80\x3f\xc0\xff", "BF16")[0] == 1 and np.isnan(tensors.decode(b"\xc0\xff", "BF16"))[0]
    assert tensors.FP8["F8_E4M3"][0x7E] == 448 and np.isnan(tensors.FP8["F8_E4M3"][0x7F]) and tensors.FP8["F8_E5M2"][0x7B] == 57344 and np.isinf(tensors.FP8["F8_E5M2"][0x7C])
    assert tensors.decode(b"abc", "F16") is None and tensors.decode(b"", "NOPE") is None
    assert tensors.f32_to_bf16(np.array([1.00390625, 1.01171875], np.float32)).tolist() == [0x3F80, 0x3F82]


def test_blocks_by_their_layout():
    d = struct.pack("<e", 0.5)
    assert tensors.decode(d + bytes(range(16)), "Q4_0").tolist() == [(i - 8) * 0.5 for i in range(16)] + [-4.0] * 16
    assert tensors.decode(d + bytes(range(256 - 16, 256)) + bytes(range(16)), "Q8_0").tolist() == [i * 0.5 for i in range(-16, 16)]
    raw = d + struct.pack("<e", 0.25) + bytes([1 | 2 << 6, 2, 3, 4, 5, 6, 7, 8, 0x21, 0, 0, 0]) + bytes([0x10] * 128)
    y = tensors.decode(raw, "Q4_K").reshape(8, 32)
    assert y[0, 0] == -0.25 * 5 and y[1, 0] == 0.5 * 2 - 0.25 * 6
    assert y[4, 0] == -0.25 * 2 and y[5, 0] == -0.0
    rng = np.random.default_rng(10)
    for name, (values, size, _) in tensors.TYPES.items():
        out = tensors.decode(rng.integers(0, 60, 3 * size).astype(np.uint8).tobytes(), name)
        assert out is not None and len(out) == 3 * values and out.dtype == np.float32


def test_six_bit_quants_one_value_at_a_time():
    rng = np.random.default_rng(11)
    b = rng.integers(0, 256, 210).astype(np.uint8)
    b[208:210] = np.frombuffer(struct.pack("<e", 0.125), np.uint8)
    y = tensors.decode(b.tobytes(), "Q6_K")
    for k in range(256):
        half, r = divmod(k, 128)
        group, lane = divmod(r, 32)
        low = int(b[64 * half + 32 * (group % 2) + lane]) >> (4 * (group // 2)) & 15
        high = int(b[128 + 32 * half + lane]) >> (2 * group) & 3
        scale = int(np.int8(b[192 + 8 * half + 2 * group + lane // 16]))
        assert y[k] == 0.125 * scale * ((low | high << 4) - 32)


def test_containers():
    t = [("w", "F32", [2, 2], struct.pack("<4f", 1, 2, 3, 4)), ("q", "Q8_0", [32], bytes(34))]
    found, meta = containers.read_safetensors(containers.write_safetensors(t, {"a": "b"}))
    assert [(x[0], x[1], x[2]) for x in found] == [("w", "F32", [2, 2]), ("q", "Q8_0", [32])] and meta == {"a": "b"}
    g = containers.read_gguf(containers.write_gguf([("n", 8, "é"), ("l", 9, (4, [1, 2])), ("f", 12, 0.5)], t, 64))
    assert g["alignment"] == 64 and g["kv"][:3] == [("n", 8, "é"), ("l", 9, [1, 2]), ("f", 12, 0.5)] and g["tensors"][1][4] - g["tensors"][1][3] == 34
    for broken in (b"", b"GGUF", containers.write_gguf([], t)[:-40], b"\xff" * 20):
        with pytest.raises(containers.Malformed):
            (containers.read_gguf if broken[:4] == b"GGUF" or not broken else containers.read_safetensors)(broken)


def test_geometry():
    ident = bytes(range(16))
    assert wire.unpack_id(wire.pack_id(ident, 0xABCDEF1)) == (ident, 0xABCDEF1)
    path = wire.path([(ident, 3.0, 0), (ident[::-1], 1.0, 5), (ident, 1.0, 0)])
    assert len(path) == 9 + 3 * 32 and len(wire.path([(ident, 1.0, 0)])) == 37
    ring = [(0.0, 0, 0, 0), (1.0, 0, 0, 0), (0.0, 1, 0, 0), (0.0, 0, 0, 0)]
    many = wire.collection(wire.COLLECTION, [wire.polygon([ring, ring]), wire.point(ring[1]), wire.collection(wire.MANY_LINES, [wire.line(ring)])])
    assert [len(s) for s in wire.spans(many)] == [4, 4, 1, 4]
    for bad in (many[:-1], many + b"x", b"\x02" + many[1:], b""):
        with pytest.raises(wire.Malformed):
            wire.spans(bad)


def test_wire_forms():
    ids = [bytes([i] * 16) for i in range(3)]
    assert wire.pg_array_read(wire.pg_array(ids)) == ids and wire.pg_array_read(b"") == []
    from pyspark.sql import types as T

    data = b"".join(wire.copy_stream([(1, None, "é")], [T.LongType(), T.DoubleType(), T.StringType()]))
    assert data == b"PGCOPY\n\xff\r\n\x00" + bytes(8) + b"\x00\x03" + struct.pack(">iq", 8, 1) + struct.pack(">i", -1) + struct.pack(">i", 2) + "é".encode() + b"\xff\xff"
    assert json.loads(json.dumps("x")) == "x"


def test_places_of_compositions(spark):
    texts = ["banana", "a b a b a b.", "the end.\n\nThe end.", "zzzz", "b"]
    rng = random.Random(3)
    at = {c: [rng.randrange(-(1 << 52), 1 << 52) for _ in range(4)] for c in {c for t in texts for c in t}}
    points = spark.createDataFrame([(c, *p) for c, p in at.items()], "letter string, m0 bigint, m1 bigint, m2 bigint, m3 bigint")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.node: ([r.m0, r.m1, r.m2, r.m3], r.tier) for r in text.placed(text.edges(df, "text"), points).collect()}
    store = identity.Composer()
    for t in texts:
        segments.decompose(t, store)
    ids, want = store.ids(), []
    for n, part in enumerate(store.parts):
        if isinstance(part, str):
            want.append(at[part])
            continue
        sums = [sum(want[c][d] for c in part) for d in range(4)]
        want.append([abs(x) // len(part) * (1 if x >= 0 else -1) for x in sums])
    assert got == {ids[n]: (want[n], store.tier[n]) for n in range(len(store.parts))}
