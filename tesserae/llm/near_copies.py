"""Near copies: SimHash distances of texts that share a bucket, compared bit-sliced, then whole shingle sets.

At a Jaccard similarity of 0.8 two 64-bit fingerprints differ in some 10 bits, up to 24 now and then. Blocks of bits that
must agree, which deal fingerprints to buckets where the radius is 4, would have to be two bits long for that. So buckets are
dealt by least hashes: texts share one if they agree on all rows of one of BANDS bands, which a pair of 0.8 misses with a
chance of 3 in a million. In the buckets the bit planes of the fingerprints are compared as for exact radii: pairs beyond RADIUS
bits are abandoned (a pair of 0.8 lies beyond it with a chance of some 3 in 100,000). Texts from one template, with 0.6 of their
shingles in common, would nearly all pass that, so a sketch follows: one bit of each of SKETCH further least hashes. Two texts
of similarity J differ in (1 - J) / 2 of the bits, a tenth at 0.8; pairs that differ in more than APART are dropped (a pair of 0.8 with a
chance of one in a million, all but 5 in 10,000 at 0.6). What is left is decided by the shingle sets themselves.

Texts with equal shingle sets are one node. Each bucket first proposes its members to its least node, so that a large group of
copies needs no pair of all its members. Then every pair of a bucket that isn't connected yet is looked at. Where the pairs that
sketches leave open are few for their nodes, they are proposed one by one. Where they are many, as among texts of one template at 0.7 to
0.8, only links that hold their nodes together are: what these connect is a family, whose members meet in tasks once, each
with its text. There all their pairs are decided by products of the matrices of members and shingles, and only links that connect
what is similar come out. So rows grow with the members of a family, not with its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, split_join
from tesserae.llm.components import components
from tesserae.llm.simhash import close_pairs, merged

#: Bands and their rows.
BANDS, ROWS = 24, 4
#: Differing bits up to which a pair's shingle sets are compared.
RADIUS = 24
#: Bits of a sketch, and differing bits up to which a pair is looked at.
SKETCH, APART = 768, 117
#: Members of a bucket that are compared as one group; larger buckets are split into pairs of parts.
PART = 8192
#: Pairs of one node that a task gets together, about.
PAIRS = 256
#: Pairs whose sketches are compared at once.
SLICE = 1 << 16
#: Open pairs for each node of a bucket's cluster, above which it goes to a family.
MANY = 4
#: Characters and members of a family that are compared as one group, about; larger families are split into pairs of parts.
FAMILY_CHARS, FAMILY_PART = 1 << 23, 4096
#: Members to a side and shingles of a matrix product.
TILE, COLUMNS = 1024, 4096
#: Shingles that meet all hash functions at once.
AT_ONCE = 1024

_made = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_sketched_by = np.random.default_rng(21).integers(0, 1 << 32, (2, SKETCH), dtype=np.uint32)
_TIMES, _PLUS = (_made[0] << np.uint64(1)) | np.uint64(1), _made[1]


def shingles(text: str | None, size: int) -> np.ndarray:
    """The XXH64s of the text's shingles, each once and rising; words as fingerprint() has them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, starts, ends, at = b" ".join(words), [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    spans = zip(starts, ends[size - 1 :]) if len(words) > size else [(0, ends[-1])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """A signed 64-bit name of the shingle set."""
    return int.from_bytes(hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values, band by band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), AT_ONCE):
        mixed = hashes[start : start + AT_ONCE, None] * _TIMES + _PLUS
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def sketch(hashes: np.ndarray) -> list[int]:
    """A bit of each of SKETCH least hashes, as signed 64-bit numbers."""
    least, times, plus = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32), _sketched_by[0] | np.uint32(1), _sketched_by[1]
    own = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(own), AT_ONCE):
        np.minimum(least, (own[start : start + AT_ONCE, None] * times + plus).min(axis=0), out=least)
    return np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31) == 1).view(np.int64).tolist()


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of a shingle set, as a signed number: bit k is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), AT_ONCE):
        part = hashes[start : start + AT_ONCE].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _signed(size: int):
    def run(batches):
        for batch in batches:
            nodes, keys, fps = [], [], []
            for x in batch.column(2):
                hashes = shingles(x.as_py(), size)
                nodes.append(node_of(hashes))
                fps.append(fingerprint_of(hashes))
                bands = signature(hashes).reshape(BANDS, ROWS)
                keys.append([xxhash.xxh64_intdigest(v.tobytes(), i) - (1 << 63) for i, v in enumerate(bands)])
            made = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "text_hash", "node", "keys", "fp"])

    return run


def _confirmed(size: int):
    def run(batches):
        last, held = None, None
        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(*(batch.column(i) for i in range(4))):
                a, b, text_a, text_b = a.as_py(), b.as_py(), text_a.as_py(), text_b.as_py()
                if last is None or last != text_a:
                    last, held = text_a, shingles(text_a, size)
                other = shingles(text_b, size)
                if similar(held, other):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _sketched(size: int):
    def run(batches):
        for batch in batches:
            made = [sketch(shingles(x.as_py(), size)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "sketch"])

    return run


def _beside(pairs: DataFrame, nodes: DataFrame, side: str, other: str, value: str) -> DataFrame:
    """`pairs` with the `value` of their nodes of one side, as {value}_{side}; a node of many pairs meets them in as many tasks as it needs."""
    degrees = cut(pairs.groupBy(side).agg(F.count("*").alias("n")))
    spread = F.ceil(F.col("n") / PAIRS).cast("int")
    salted = split_join(pairs, degrees, [side], "n", pairs.count(), PAIRS).withColumn("salt", F.pmod(F.xxhash64(other), spread).cast("int")).drop("n")
    values = degrees.join(nodes.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}")), side)
    values = values.select(side, f"{value}_{side}", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
    return salted.join(values, [side, "salt"]).drop("salt")


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of `pairs` whose sketches differ in no more than APART bits."""
    met = cut(_beside(cut(pairs), sketches, "a", "b", "sketch"))
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return _beside(met, sketches, "b", "a", "sketch").where(apart <= APART).select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Those of `pairs` (a, b) whose shingle sets are similar."""
    met = cut(_beside(cut(pairs), texts, "b", "a", "text"))
    return cut(_beside(met, texts, "a", "b", "text").select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(size), "a bigint, b bigint"))


def _bucket_pairs(batches):
    """Rows (a, b, dense): the open pairs of clusters with few, and links that span clusters with many (dense)."""
    keys = ["key", "part_a", "part_b"]

    def pairs(pdf):
        changed = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
        node, own = pdf["node"].to_numpy(), pdf["own"].to_numpy()
        sketches = np.stack(pdf["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        across = (pdf["part_a"] != pdf["part_b"]).to_numpy()
        # a cluster is named by its least row; of dense ones no pairs are kept
        cluster, dense, kept = np.arange(len(pdf)), np.zeros(len(pdf), bool), np.zeros((2, 0), np.int64)

        def sparse():
            of = cluster[kept[0]]
            dense[np.bincount(of, minlength=len(pdf)) > MANY * np.bincount(cluster, minlength=len(pdf))] = True
            return kept[:, ~dense[of]]

        for some_i, some_j in close_pairs(pdf["fp"].to_numpy(np.int64).view(np.uint64), np.r_[0, np.cumsum(changed)], RADIUS, pdf["label"].to_numpy(np.int64)):
            for start in range(0, len(some_i), SLICE):
                i, j = some_i[start : start + SLICE], some_j[start : start + SLICE]
                # pairs within a part are met where both parts are that one
                use = (~across[i] | (own[i] != own[j])) & ~(dense[cluster[i]] & (cluster[i] == cluster[j]))
                i, j = i[use], j[use]
                use = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64) <= APART
                i, j = i[use], j[use]
                were = np.flatnonzero(dense)
                cluster = merged(cluster, i, j)
                dense[cluster[were]] = True
                kept = np.concatenate([kept, np.stack([i, j])], axis=1)
                if kept.shape[1] > MANY * len(pdf):
                    kept = sparse()
        i, j = sparse()
        rows = np.flatnonzero(dense[cluster] & (cluster != np.arange(len(pdf))))
        a, b = node[np.r_[i, rows]], node[np.r_[j, cluster[rows]]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "dense": np.arange(len(a)) >= len(i)}).drop_duplicates()

    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        same = (held[keys] == held[keys].iloc[-1]).all(axis=1).to_numpy() if len(held) else np.zeros(0, bool)
        if len(held) < 4096 or same.all():
            continue
        yield pairs(held[~same].reset_index(drop=True))
        held = held[same].reset_index(drop=True)
    if held is not None and len(held):
        yield pairs(held)


def _unconnected(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b, dense) of nodes that share a bucket, have different labels and may be similar; dense ones stand for all pairs of what they connect."""
    known = members.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = cut(known.select("key", "node", "fp", "label"))
    buckets = known.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    parts = split_join(known, cut(buckets.select("key", "n")), ["key"], "n", known.count())
    parts = parts.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    parts = parts.select("key", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "own", "node", "label", "fp").join(sketches, "node")
    keys = ["key", "part_a", "part_b"]
    return parts.repartition(*keys).sortWithinPartitions(*keys, "label").mapInPandas(_bucket_pairs, "a bigint, b bigint, dense boolean").distinct()


def _in_common(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one list has in common with each of the other."""
    both = np.intersect1d(np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b)), assume_unique=True)

    def places(sets):
        values = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.searchsorted(both, values)
        shared = column < len(both)
        shared[shared] = both[column[shared]] == values[shared]
        return row[shared], column[shared]

    def matrix(sets, row, column, start):
        use = (column >= start) & (column < start + COLUMNS)
        made = np.zeros((len(sets), min(COLUMNS, len(both) - start)), np.float32)
        made[row[use], column[use] - start] = 1
        return made

    # sums of ones are exact up to 2^24 a product
    a, b, total = places(sets_a), places(sets_b), np.zeros((len(sets_a), len(sets_b)), np.int64)
    for start in range(0, len(both), COLUMNS):
        total += (matrix(sets_a, *a, start) @ matrix(sets_b, *b, start).T).astype(np.int64)
    return total


def similar_links(sets: list[np.ndarray], across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, earlier row) links that connect just what similar() connects, at most one for each row; with `across`, by pairs of different sides."""
    sides = [np.arange(len(sets))] if across is None else [np.flatnonzero(~across), np.flatnonzero(across)]
    tiles = [[rows[i : i + TILE] for i in range(0, len(rows), TILE)] for rows in sides]
    sizes, label = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
    for x, left in enumerate(tiles[0]):
        for right in tiles[0][x:] if across is None else tiles[1]:
            if (label[np.r_[left, right]] == label[left[0]]).all():
                continue
            common = _in_common([sets[i] for i in left], [sets[i] for i in right])
            i, j = np.nonzero(5 * common >= 4 * (sizes[left][:, None] + sizes[right] - common))
            label = merged(label, left[i], right[j])
    rows = np.flatnonzero(label != np.arange(len(sets)))
    return rows, label[rows]


def _family_links(size: int):
    def links(key, nodes, owns, sets):
        _, part_a, part_b = key
        rows, to = similar_links(sets, None if part_a == part_b else np.array(owns) == part_b)
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes)[x], pa.int64()) for x in (to, rows)], names=["a", "b"])

    def run(batches):
        now, nodes, owns, sets = None, [], [], []
        for batch in batches:
            for *key, own, node, text in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
                if key != now and sets:
                    yield links(now, nodes, owns, sets)
                    nodes, owns, sets = [], [], []
                now = key
                nodes.append(node)
                owns.append(own)
                sets.append(shingles(text.as_py(), size))
        if sets:
            yield links(now, nodes, owns, sets)

    return run


def _of_families(dense: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links (a, b) that connect what is similar in each family, which `dense` links connect."""
    members = cut(components(dense).join(texts.select("node", F.length("text").alias("chars")), "node"))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    sizes = cut(sizes.select("component", "n", F.ceil(F.greatest(F.col("n") / FAMILY_PART, F.col("chars") / FAMILY_CHARS, F.lit(1))).cast("int").alias("parts")))
    parts = split_join(members.select("node", "component"), sizes, ["component"], "n", members.count())
    parts = parts.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    keys = ["component", "part_a", "part_b"]
    parts = parts.select("component", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "own", "node").join(texts, "node")
    parts = parts.select(*keys, "own", "node", "text").repartition(*keys).sortWithinPartitions(*keys)
    return cut(parts.mapInArrow(_family_links(size), "a bigint, b bigint"))


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, text_hash, component_id, leads) for every row: the least id that links reach, a link for each pair of similarity 0.8 or more.

    text_hash is xxhash64 of the text, null counting as empty: with the id it tells rows apart. `leads` marks one (id, text) of
    each component, that with the least id and, among equal ids, the least hash; rows that are wholly equal are marked
    together. The similarity is the Jaccard similarity of the sets of `size`-word shingles; a shorter text is one shingle.
    Null and empty texts are equal to each other. Null ids come first. Ids are whole numbers; other columns are not looked
    at. No rows: no rows.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    prints = cut(docs.select("doc_id", "text_hash", "text").mapInArrow(_signed(size), "doc_id bigint, text_hash bigint, node bigint, keys array<bigint>, fp bigint"))
    nodes = cut(prints.groupBy("node").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    dealt = nodes.select("node", "fp", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "fp")).alias("first")).where("n > 1")
    members = cut(split_join(dealt, cut(shared), ["key"], "n", nodes.count() * BANDS).select("node", "fp", "key", "first"))
    needed = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    # equal rows, if the representative is repeated, are one
    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    texts = cut(docs.join(needed, same).groupBy("node").agg(F.first("text").alias("text")))
    sketches = cut(texts.mapInArrow(_sketched(size), "node bigint, sketch array<bigint>"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= RADIUS
    leads = members.where((F.col("node") != F.col("first.node")) & near).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirm(_promising(leads, sketches), texts, size)
    open_pairs = cut(_unconnected(members.select("node", "fp", "key"), components(links), sketches))
    links = links.union(_confirm(open_pairs.where("not dense").select("a", "b"), texts, size))
    dense = open_pairs.where("dense").select("a", "b")
    if not dense.isEmpty():
        links = links.union(_of_families(dense, texts, size))
    found = components(links)
    named = cut(nodes.join(found, "node", "left").select("node", "times", "rep", F.coalesce("component", "node").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")))
    named = cut(split_join(named, least, ["component"], "n", named.count()).select("node", "times", "least"))
    total = named.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    leads = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return split_join(prints.select("doc_id", "text_hash", "node"), named, ["node"], "times", total).select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), leads.alias("leads"))
