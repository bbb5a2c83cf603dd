"""Digests of artifacts in parts against the published ones and against hashing whole inputs."""

import random

import numpy as np
import pytest

from tesserae.functions import identity
from tesserae.operators import fingerprints as P
from tesserae.plans.catalogue import queries

#: Published digests of the bytes 0, 1, ... 250, 0, 1, ... of these lengths. (Fixed values.)
PUBLISHED = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
}


def whole(data):
    return np.ascontiguousarray(identity._hash_some([data]).T).astype("<u4").tobytes().hex()


def pattern(n):
    return bytes(i % 251 for i in range(n))


def rows_of(rng, name, data, most):
    at, n = 0, 0
    while at < len(data):
        size = rng.randint(0, most)
        yield name, n, bytearray(data[at : at + size])
        at, n = at + size, n + 1


def test_published_digests(spark):
    rng = random.Random(1)
    rows = [r for n in PUBLISHED for r in rows_of(rng, str(n), pattern(n), 400)] + [("0", 0, None)]
    got = {r.name: (r.n_bytes, r.digest) for r in P.fingerprints(spark.createDataFrame(rows, "name string, ord int, body binary"), "name", "ord", "body").collect()}
    assert got == {str(n): (n, d) for n, d in PUBLISHED.items()}


@pytest.mark.parametrize("reach,together", [(20, 1 << 22), (2, 3000)])
def test_cuts_and_partitions_do_not_matter(spark, monkeypatch, reach, together):
    monkeypatch.setattr(P, "REACH", reach)
    rng = random.Random(reach)
    sizes = [1, 1023, 1024, 1025, 2048, 2049, 3072, 4096, 5000, 8192, 8193, 31744, 65536, 300_000]
    data = {n: rng.randbytes(n) for n in sizes}
    for most in (700, 200_000):
        rows = [r for n in sizes if n <= 100 * most for r in rows_of(rng, n, data[n], most)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "name bigint, ord int, body binary").repartition(7)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.name: r.digest for r in P.fingerprints(df, "name", "ord", "body").collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == {r[0]: whole(data[r[0]]) for r in rows}


def test_odd_rows(spark):
    rows = [(None, 1, "b"), (None, None, "a"), ("x", 1, "d"), ("x", 1, "c"), ("x", 1, "c"), ("none", 1, None)]
    got = {r.name: (r.n_bytes, r.digest) for r in P.fingerprints(spark.createDataFrame(rows, "name string, ord int, n_bytes string"), "name", "ord", "n_bytes").collect()}
    assert got == {None: (2, whole(b"ab")), "x": (3, whole(b"ccd")), "none": (0, PUBLISHED[0])}
    assert P.fingerprints(spark.createDataFrame([], "name string, ord int, body binary"), "name", "ord", "body").count() == 0


def test_texts_of_each_source(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text").orderBy("doc_id").collect()
    want: dict = {}
    for r in docs:
        want[r.source] = want.get(r.source, b"") + (r.text or "").encode()
    got = {r.source: (r.n_bytes, r.digest) for r in queries()["artifact_digests"](spark, sf_dir).collect()}
    assert got == {s: (len(b), whole(b)) for s, b in want.items()}
