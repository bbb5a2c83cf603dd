"""Stages on odd rows, and the whole pipeline with planted copies and toxic documents."""

import random

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 300))]
        if i % 10 == 3:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["foozle", "barflug", "quxnar"])
        labels.append((i, 1, int(i % 10 == 3)))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
    rows += [(1000 + i, rows[i][1], "en", "s9", 1) for i in (0, 1, 2)]
    rows[5] = (5, " ".join(rng.choice(vocabulary) for _ in range(900)), *rows[5][2:])
    near = rows[5][1].split()
    near[50] = "changed"
    rows += [(1005, " ".join(near), "en", "s9", 1), (2000, None, None, None, None), (2001, "too short", "en", "s1", 9), (None, rows[8][1] + " and more", "en", "s1", 1), rows[7]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_run(spark, corpus):
    folder, rows = corpus
    out = P.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {1000, 1001, 1002, 1005, 2000, 2001}
    assert not {i for i in ids if i is not None and i % 10 == 3}
    assert all(len(r.ids_sha256) == 64 and len(r.decoded_sha256) == 64 for r in out)


def test_stages_keep_columns_and_clean_documents(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.quality(spark, docs, folder)
    assert kept.columns == list(P.COLUMNS)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {2000, 2001}
    clean = {r.doc_id for r in P.clean(spark, kept, folder).collect()}
    assert clean == {r[0] for r in rows} - {2000, 2001} - {i for i in range(300) if i % 10 == 3}
    one = P.distinct(spark, docs, folder)
    ids = [r.doc_id for r in one.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 2, 5, 7, None} <= set(ids) and not {1000, 1001, 1002, 1005} & set(ids)
    assert P.mixture(spark, docs, folder).columns == list(P.COLUMNS)


def test_stages_on_an_empty_table(spark, corpus):
    folder, _ = corpus
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_stages_ignore_further_columns(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20).selectExpr("*", "1 AS fp", "2 AS rep", "3 AS weight", "4 AS share", "5 AS ids", "6 AS block", "7 AS n")
    for _, stage in P.STAGES:
        stage(spark, docs, folder).count()
