"""Trees that are stored and take edits later, against encoding the whole edited text."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe
from tesserae.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the cat", " it's", "\n\n", "  ", "日本 é", "🙂", "x" * 300, " 12", "!!", "\t", " word" * 90, "'ll"]


def edited(text, at, remove, insert):
    at = min(max(at, 0), len(text))
    return text[:at] + insert + text[at + max(remove, 0) :]


def test_edits_reach_stored_trees(spark, tmp_path):
    rng, library = random.Random(11), Tokenizer.from_file(PATH)
    texts = {i: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for i in range(60)}
    texts[60], texts[61] = "", "word " * 20_000
    rows = [(i, t, 7) for i, t in texts.items()] + [(62, None, 7)]
    C.plant(spark.createDataFrame(rows, "doc_id bigint, text string, sizes int")).drop("text").write.parquet(f"{tmp_path}/0")
    texts[62] = ""
    for stage in range(3):
        trees = spark.read.parquet(f"{tmp_path}/{stage}")
        log = []
        for i in texts:
            for order in range(rng.randint(0, 4)):
                change = rng.randint(0, len(texts[i]) + 5), rng.randint(0, 30), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 3)))
                texts[i] = edited(texts[i], *change)
                log.append((i, order, *change))
        table = spark.createDataFrame(log, "doc_id bigint, ord int, at int, remove int, insert string").repartition(3)
        done = C.apply(trees.join(C.gathered(table, "doc_id", "ord"), "doc_id", "left"))
        got = {r.doc_id: r for r in done.collect()}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            assert got[i].tree.text == t and got[i].sizes == 7
            assert got[i].tokens_after == sum(got[i].tree.tokens) == len(library.encode(t, add_special_tokens=False).ids)
            assert sum(got[i].tree.sizes) == len(got[i].tree.lengths) == got[i].n_pretokens
        assert got[61].n_reencoded < 2000  # of 20,000
        done.select("doc_id", "sizes", "tree").write.parquet(f"{tmp_path}/{stage + 1}")


def test_trees_of_odd_rows(spark):
    change = F.array(F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("remove"), F.lit("ab").alias("insert")), F.lit(None))
    df = spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id bigint, text string")
    got = C.apply(C.plant(df).withColumn("edits", change)).collect()
    assert [(r.doc_id, r.tokens_before, r.tokens_after, r.tree.text) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, 0, 1, "ab"), (1, 0, 1, "ab"), (2, 0, 1, "ab")]
    bare = df.select("doc_id", F.lit(None).cast(C.TREE).alias("tree"), F.lit(None).cast(f"array<{C.EDIT.simpleString()}>").alias("edits"))
    assert {(r.tokens_before, r.tokens_after, r.n_reencoded) for r in C.apply(bare).collect()} == {(0, 0, 0)}
    assert C.apply(C.plant(df.limit(0)).withColumn("edits", change)).count() == 0


class Asked:
    """An encoder that notes what it is asked for."""

    def __init__(self, encoder):
        self.pretoken, self.own, self.calls = self, encoder.pretoken, []

    def __getitem__(self, piece):
        self.calls.append(piece)
        return self.own[piece]


def test_edits_encode_what_they_made_and_nothing_else():
    rng, library, encoder = random.Random(5), Tokenizer.from_file(PATH), bpe.encoder(PATH)
    for _ in range(40):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 80)))
        state = C.TokenTree(text, encoder).state()
        for _ in range(4):
            asked = Asked(encoder)
            tree = C.TokenTree.restored(dict(zip(C.TREE.fieldNames(), state)), asked)
            assert not asked.calls
            change = rng.randint(0, len(text) + 2), rng.randint(0, 20), rng.choice(["", " one two", "it's", "\n"])
            text = edited(text, *change)
            tree.edit(*change)
            state = tree.state()
            want = [len(library.encode(x, add_special_tokens=False).ids) for x in bpe.PRETOKEN.findall(text)]
            assert len(asked.calls) == tree.encoded and tree.n_tokens == sum(want)
            assert C._of_bytes(*state[3:5]).tolist() == want and state[0] == text
    words = "word " * 5_000
    asked = Asked(encoder)
    tree = C.TokenTree.restored(dict(zip(C.TREE.fieldNames(), C.TokenTree(words, encoder).state())), asked)
    tree.edit(12_502, 1, "x")
    assert len(asked.calls) == tree.encoded <= 4
