"""Published registries, manifests, labels and small fixed tables."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import identity, segments
from tesserae.operators import consensus, text
from tesserae.operators.order import numbered
from tesserae.sources import registries


def test_manifest_and_branches(spark, tmp_path):
    (tmp_path / "upos.tsv").write_text("# frozen\nslot\tid\tstatus\tkey\n0\td88366c648b9e04d7a2c3365b1921025\tlive\tADJ\n1\taf0ffef4ea543e66eb440600cde48008\tlive\tADP\n")
    (tmp_path / "vnrole.tsv").write_text('slot\tid\tstatus\tkey\tidentifier\n0\tff\tretired\t"x\tshown\n')
    a, b = registries.slots(spark, str(tmp_path / "upos.tsv"), "upos"), registries.slots(spark, str(tmp_path / "vnrole.tsv"), "vnrole")
    assert [(r.slot, bytes(r.id).hex()[:4], r.identifier) for r in a.collect()] == [(0, "d883", "ADJ"), (1, "af0f", "ADP")]
    assert [(r.key, r.identifier) for r in b.collect()] == [('"x', "shown")]
    assert {r.list for r in registries.branch(a.union(b), ["frames"]).collect()} == {"vnrole"}
    ids = text.text_ids(a, "key", "key").join(a.select("key", F.col("id").alias("frozen")), "key")
    assert ids.where("id <> frozen").count() == 0


def test_publish_is_all_or_nothing(spark, tmp_path):
    good = spark.createDataFrame([(0, b"a"), (1, b"b")], "slot int, id binary")
    registries.publish({"slots": good}, str(tmp_path / "x"), "tables-1")
    assert registries.opened(spark, str(tmp_path / "x"), "tables-1")["slots"].count() == 2
    with pytest.raises(registries.Stale):
        registries.opened(spark, str(tmp_path / "x"), "tables-2")
    good.limit(1).write.mode("append").parquet(str(tmp_path / "x" / "slots"))
    with pytest.raises(registries.Stale):
        registries.opened(spark, str(tmp_path / "x"), "tables-1")
    for bad in ([(0, b"a"), (0, b"b")], [(0, b"a"), (2, b"b")], [(0, b"a"), (1, b"a")]):
        with pytest.raises(registries.Stale):
            registries.publish({"slots": spark.createDataFrame(bad, "slot int, id binary")}, str(tmp_path / "y"))


def test_scalars_and_trust_by_id(spark):
    few = {r.v: r.tier for r in text.scalars(spark, -12, 1111).collect()}
    assert (few[7], few[10], few[-5], few[-10], few[1111], few[1010]) == (0, 1, 1, 2, 1, 2)
    store = identity.Composer()
    node = segments.decompose("AppDerived", store)
    rows = spark.createDataFrame([(store.ids()[node],), (b"x",)], "i binary")
    assert [r.prior for r in consensus.trust_by_id(rows, "i").collect()] == [0.4, None]


def test_numbered(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.lit(1).alias("n_"))
    got = [(r.k, r.n) for r in numbered(df, ["k"]).collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(k for k, _ in got))]


def test_labels():
    world = {
        b"h": "h", b"i": "i", b"hi": (0, [(b"h", 1, 0), (b"i", 2, 0)]), b"t": (text.TUPLE, [(b"hi", 1, 0), (b"gone", 3, 0)]),
        b"r": (text.OPAQUE, [(b"hi", 2, 0)]), b"o": (text.OPAQUE, []), b"c": (0, [(b"hi", 1, 0), (b"h", 1, text.CLAIM)]), b"x": (0, [(b"x", 1, 0)]),
    }
    shown = {k: text.label(k, world.get) for k in (b"hi", b"t", b"r", b"o", b"c")}
    assert shown == {b"hi": "hii", b"t": f"[hii · {b'gone'.hex()} × 3]", b"r": "[hii × 2]", b"o": b"o".hex(), b"c": "hii"}
    with pytest.raises(ValueError):
        text.label(b"x", world.get)
