"""The source audit against sums over all terms, and the radix selection with ties."""

import random
import re

import pytest

from tesserae.llm import source_audit as A

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n string, p string, value string"


def brute_force(rows, least):
    low = str.maketrans(A.UPPER, A.LOWER)
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", TERM.findall((text or "").translate(low))
        groups.add((lang, source))
        for w in words:
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang, source in groups:
        kept = [w for (own, w), n in docs.items() if own == lang and n >= least]
        sources = [s for own, s in groups if own == lang]
        v = len(kept)

        def shares(n):
            total = sum(n.values())
            return {w: 1 + 10**9 * (n[w] + 2) // (total + 2 * v) for w in kept}

        own = {s: {w: counts.get((lang, s, w), 0) for w in kept} for s in sources}
        p, q = {s: shares(own[s]) for s in sources}, shares({w: sum(own[s][w] for s in sources) for w in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(sum(f(p[source][w], p[s][w]) for w in kept), s) for s in sources if s != source]
        terms = [(f(p[source][w], q[w]), w) for w in kept if own[source][w] and p[source][w] > q[w]]
        for part, found, k in (("pair", pairs, None), ("term", terms, 10)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:k]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def planted():
    rng = random.Random(5)
    words = ["The", "the", "straße", "ÉTÉ", "été", "日本", "a1b", "x_y", "", "@", "zz"] + [f"w{c}" for c in "abcdefghijklmnopqrstuvw"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "ü", None])) for _ in range(260)]
    return rows + rows[:5] + [(None, "en", "none"), ("", "fr", "s1"), ("rare words", "fr", "s2"), ("lone " * 400, "it", "s1")] + [("lone same", "pt", "only")] * 10


@pytest.mark.parametrize(("block", "shard"), [(2, 7), (64, 200_000)])
def test_audit(spark, monkeypatch, block, shard):
    rows = planted()
    whole = A.divergences
    monkeypatch.setattr(A, "divergences", lambda cells, sizes: whole(cells, sizes, block, shard))
    df = spark.createDataFrame([(i, *r, "x", "x", "x", "x") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in A.audit(df).collect())
    assert got == brute_force(rows, A.LEAST_DOCS)


def test_no_rows(spark):
    assert A.audit(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("few", [1, 3, 1024])
def test_radix_top_orders_ties_by_bytes(spark, few):
    rng = random.Random(2)
    items = ["", "a", "aa", "aaa", "ab", "é", "😀", "z", "aab"] + [f"{'long' * 5}{i}" for i in range(40)]
    rows = [("many", rng.choice([0, 5, (1 << 30) - 1]), i) for i in items] + [("tie", 7, i) for i in items] + [("few", 3, "x")]
    df = spark.createDataFrame(rows, "g string, v bigint, item string")
    got = sorted((r.g, r["rank"], r.v, r.item) for r in A.radix_top(df, ["g"], "v", "item", 10, few=few).collect())
    want = []
    for g in ("many", "tie", "few"):
        best = sorted((-v, i.encode(), i) for own, v, i in rows if own == g)[:10]
        want += [(g, k + 1, -v, i) for k, (v, _, i) in enumerate(best)]
    assert got == sorted(want)


def test_shares_of_very_large_counts(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n bigint, total bigint, v bigint")
    assert df.select(A._share("n", "total", "v")).first()[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)
