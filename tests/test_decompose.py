"""Entries taken apart and verified, against the store of compositions."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import identity, segments
from tesserae.operators import decompose as D
from tesserae.plans.catalogue import queries

ENTRIES = {1: ["agent"], 2: ["give", "take up"], 3: ["a"], 4: ["aa bb", "x", "x"], 5: ["", "b"], 6: [], 7: None, 8: [None]}
PLACES = "m0 bigint, m1 bigint, m2 bigint, m3 bigint"


def trunc(total, n):
    return abs(total) // n * (1 if total >= 0 else -1)


@pytest.fixture(scope="module")
def at():
    return {c: [(-1) ** n * (n * 7919 + d * 104729) for d in range(4)] for n, c in enumerate(sorted({c for x in ENTRIES.values() for t in x or [] for c in t or ""}))}


def wanted(at):
    store = identity.Composer()
    roots = {}
    for key, texts in ENTRIES.items():
        if texts and all(texts):
            own = [segments.decompose(t, store) for t in texts]
            roots[key] = (own, store.compose(own))
    ids, place = store.ids(), []
    for part in store.parts:
        place.append(at[part] if isinstance(part, str) else [trunc(sum(place[c][d] for c in part), len(part)) for d in range(4)])
    return store, ids, place, roots


def test_entries_are_what_their_parts_make(spark, at):
    store, ids, place, roots = wanted(at)
    points = spark.createDataFrame([(c, *m) for c, m in at.items()], f"letter string, {PLACES}")
    entries = spark.createDataFrame(list(ENTRIES.items()), "key bigint, parts array<string>")
    rows = D.composed(entries.withColumn("node", F.lit(1)), points).collect()
    assert {r.key for r in rows} == {k for k, x in ENTRIES.items() if x}
    assert {r.key: (bytes(r.id), r.tier, [r.m0, r.m1, r.m2, r.m3]) for r in rows if r.id} == {k: (ids[n], store.tier[n], place[n]) for k, (_, n) in roots.items()}
    # the true ones, then each with another's id, then each somewhere else
    said = [(k, bytes(ids[n]), *place[n], ENTRIES[k]) for k, (_, n) in roots.items()]
    said += [(k + 10, bytes(ids[0]), *place[n], ENTRIES[k]) for k, (_, n) in roots.items() if n]
    said += [(k + 20, bytes(ids[n]), place[n][0] + 1, *place[n][1:], ENTRIES[k]) for k, (_, n) in roots.items()] + [(30, None, 1, 1, 1, 1, ["a"])]
    got: dict = {}
    for r in D.decomposed(spark.createDataFrame(said, f"key bigint, id binary, {PLACES}, parts array<string>"), points).orderBy("key", "ordinal").collect():
        got.setdefault(r.key, []).extend([bytes(r.child)] * r.run)
    want = {k: [ids[c] for c in (own if len(own) > 1 else (n,) if isinstance(store.parts[n], str) else store.parts[n])] for k, (own, n) in roots.items()}
    assert got == want


def test_query(spark, sf_dir):
    rows = {(r.r_regionkey, r.forged): r.children for r in queries()["registry_decomposed"](spark, sf_dir).collect()}
    assert all((n > 0) != forged for (_, forged), n in rows.items()) and len(rows) == 10
