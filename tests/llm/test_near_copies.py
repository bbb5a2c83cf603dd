"""Near copies at 0.80 to 0.95 against brute force over whole shingle sets."""

import random

import corpus_pipeline as P
from tesserae.llm import near_copies as N


def sets(text, size=5):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def brute_force(rows):
    """The least id of each row's component, over all pairs of Jaccard similarity 0.8 or more; and the number of such pairs."""
    made = [(i, sets(t)) for i, t in rows]
    label, pairs = {i: i for i, _ in made}, 0

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(made):
        for j, b in made[x + 1 :]:
            if 10 * len(a & b) >= 8 * len(a | b):
                pairs += 1
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return {i: root(i) for i, _ in made}, pairs


def planted():
    """Copies with replaced words at similarities from below 0.8 to 0.97, a chain, and a group around one text."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = word()
        return words

    for k in range(120):
        base = [word() for _ in range(400)]
        rows.append((1000 + k, " ".join(base)))
        rows.append((2000 + k, " ".join(changed(base, 1 + k % 14))))
    chain = [word() for _ in range(300)]
    for k in range(12):
        rows.append((3000 + k, " ".join(chain)))
        chain = changed(chain, 5)
    base = [word() for _ in range(200)]
    rows += [(4000 + k, " ".join(changed(base, 1 + k % 3))) for k in range(60)]
    rng.shuffle(rows)
    return rows


def test_planted_pairs_are_found(spark):
    rows = planted()
    want, pairs = brute_force(rows)
    assert pairs > 150
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(docs).collect()}
    assert got == want


def test_buckets_in_parts(spark, monkeypatch):
    rows = [r for r in planted() if r[0] >= 3000]
    monkeypatch.setattr(N, "PART", 8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == brute_force(rows)[0]


def test_stage_keeps_one_of_each_component(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in P.distinct(spark, docs, "").collect()) == sorted(set(brute_force(rows)[0].values()))


def templates(n, words, changed, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, out = [word() for _ in range(words)], []
    for k in range(n):
        own = list(base)
        for i in rng.sample(range(words), changed):
            own[i] = word()
        out.append((k, " ".join(own)))
    return out


def test_texts_of_a_template_propose_few_pairs(spark, monkeypatch):
    """400 texts that pairwise share some 0.6 of their shingles: nearly all of the 79,800 pairs are told apart before texts are compared."""
    proposed = []
    whole = N._confirm

    def counted(pairs, texts, size):
        proposed.append(pairs.count())
        return whole(pairs, texts, size)

    monkeypatch.setattr(N, "_confirm", counted)
    rows = templates(400, 400, 10)
    got = N.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_force(rows)[0]
    assert sum(proposed) < 5 * len(rows), proposed


def test_sketches_keep_similar_pairs():
    """Of pairs at 0.8 or a little more, sketches drop none."""
    base = templates(1, 300, 0, seed=8)[0][1].split()
    first = N.shingles(" ".join(base), 5)
    apart, own_print = [], N.np.array(N.sketch(first)).view(N.np.uint64)
    for k in range(400):
        rng = random.Random(k)
        own = list(base)
        for i in rng.sample(range(300), 3 + k % 4):
            own[i] = f"new{k}x{i}"
        h = N.shingles(" ".join(own), 5)
        if N.similar(first, h):
            apart.append(int(N.np.bitwise_count(own_print ^ N.np.array(N.sketch(h)).view(N.np.uint64)).sum()))
    assert len(apart) > 150 and max(apart) <= N.APART


def test_a_bucket_makes_rows_by_its_members():
    """400 texts around one, at 0.7 to 0.8 to each other, in one bucket: thousands of pairs stay open, and no more rows come out than members."""
    sets = [N.shingles(t, 5) for _, t in templates(400, 300, 4)]
    made = {"key": 1, "part_a": 0, "part_b": 0, "own": 0, "node": range(400), "label": range(400), "fp": [N.fingerprint_of(s) for s in sets], "sketch": [N.np.array(N.sketch(s)) for s in sets]}
    found = N.pd.concat(N._bucket_pairs(iter([N.pd.DataFrame(made)])))
    bits = N.np.stack(made["sketch"]).view(N.np.uint64)
    open_pairs = sum(int((N.np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1) <= N.APART).sum()) for i in range(400))
    assert open_pairs > 20_000 and len(found) < 400, (open_pairs, len(found))


def test_families_connect_what_brute_force_connects(spark, monkeypatch):
    """Texts of two templates, few pairs of which reach 0.8, and small groups beside them; families whole and in parts, tiles cut small."""
    rows = templates(200, 300, 4) + [(1000 + i, t) for i, t in templates(100, 200, 3, seed=5)] + [r for r in planted() if r[0] >= 3000]
    want, pairs = brute_force(rows)
    assert pairs > 200 and len(set(want.values())) > 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    families = []
    whole = N._of_families

    def counted(dense, texts, size):
        families.append(dense.count())
        return whole(dense, texts, size)

    monkeypatch.setattr(N, "_of_families", counted)
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == want
    monkeypatch.setattr(N, "FAMILY_PART", 70)
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == want
    assert len(families) == 2 and min(families) > 100


def test_similar_links_in_tiles(monkeypatch):
    sets = [N.shingles(t, 5) for _, t in templates(90, 300, 4)] + [N.shingles(t, 5) for t in ("", "one two", "one two three four five six")]
    monkeypatch.setattr(N, "TILE", 16)
    monkeypatch.setattr(N, "COLUMNS", 50)
    for across in (None, N.np.arange(len(sets)) % 3 == 1):
        label = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                if label[i] != label[j] and (across is None or across[i] != across[j]) and N.similar(a, sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
        rows, to = N.similar_links(sets, across)
        got = list(range(len(sets)))
        for i, j in zip(rows.tolist(), to.tolist()):
            got[i] = j
        assert got == label and len(set(label)) < len(sets)
