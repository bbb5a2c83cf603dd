"""SimHash near-duplicates with a bit-sliced comparison.

Equal fingerprints are put together first. Two fingerprints with at most `radius` differing bits agree wholly on all
but `radius` of any blocks that the 64 bits are cut into, so each fingerprint is dealt to one bucket for each choice of
blocks that must agree, and only buckets are compared inside. There the fingerprints stand in bit planes, 64 to a
machine word: a word of plane k holds bit k of 64 fingerprints. XOR with a query's bit gives 64 differing bits at once,
seven planes at a time go through carry-save adders into vertical counters, and a (query, word) pair is abandoned as
soon as all its 64 distances exceed the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import cut, split_join, table
from tesserae.llm.components import components

#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15
#: Members of a bucket that are compared as one group; larger buckets are split into pairs of parts.
PART = 8192
#: (query, word) pairs whose counters are held at once.
SLAB = 1 << 15


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits: bit k is 1 if it is set in over half of the shingles' XXH64 (seed 42). No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six white-space bytes
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), 0
    step = max(1, AT_ONCE)
    count = max(1, len(words) - size + 1)
    for start in range(0, count, step):
        part = words[start : start + step + size - 1]
        joined, ends, at = b" ".join(part), [], 0
        for w in part:
            at += len(w)
            ends.append(at)
            at += 1
        if len(part) <= size:
            spans = [(0, ends[-1])]
        else:
            spans = zip([0, *(e + 1 for e in ends[: len(part) - size])], ends[size - 1 :])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
        n += len(hashes)
    return int(((2 * total > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", size: int = 4) -> DataFrame:
    """Replace the text column by `out`: the fingerprint as a bigint with the same 64 bits."""
    rest = [c for c in df.columns if c != text]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            fps = [fingerprint(x.as_py(), size) for x in batch.column(at)]
            made = pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), made], names=[*rest, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.LongType())]))


def bucket_masks(n: int, radius: int) -> list[int]:
    """The bits that must agree, one mask for each kind of bucket: all choices of `agree` out of agree + radius blocks.

    More blocks must agree as there are more fingerprints, so that a bucket of evenly spread ones stays small.
    """
    agree = 1
    while agree < 4 and (n >> (64 * agree // (agree + radius))) > 4096:
        agree += 1
    cuts = [64 * i // (agree + radius) for i in range(agree + radius + 1)]
    blocks = [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def _add(x, y, z):
    """A full adder on words: (sum, carry)."""
    t = x ^ y
    return t ^ z, (x & y) | (t & z)


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int, label: np.ndarray | None = None):
    """Yield (i, j) index arrays, i < j, of the rows of equal `group` (rising numbers) within `radius` (below 32) differing bits.

    Rows of equal `label` are no pairs; inside a group it must rise, so that most words have one label and are passed over.
    No rows or one: no pairs. Equal fingerprints are pairs like any others.
    """
    n = len(fps)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    words = -(-sizes // 64)
    word0 = np.r_[0, np.cumsum(words)[:-1]]
    of = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(n) - first[of]
    word, lane = word0[of] + place // 64, (place % 64).astype(np.uint64)
    total = int(words.sum())
    lanes = np.zeros((total, 64), np.uint64)
    lanes[word, lane.astype(np.int64)] = fps
    row_of = np.zeros((total, 64), np.int64)
    row_of[word, lane.astype(np.int64)] = np.arange(n)
    filled = np.zeros(total, np.uint64)
    np.bitwise_or.at(filled, word, np.uint64(1) << lane)
    if label is not None:
        last = np.r_[first[1:], n] - 1
        ends = np.minimum(first[of] + (place // 64) * 64 + 63, last[of])
        one_label = np.zeros(total, np.int64), np.zeros(total, bool)
        one_label[0][word], one_label[1][word] = label, label[ends - (ends - first[of]) % 64] == label[ends]
    shift = np.arange(64, dtype=np.uint64)
    planes = np.stack([np.bitwise_or.reduce(((lanes >> np.uint64(k)) & np.uint64(1)) << shift, axis=1) for k in range(64)])
    # each row meets its own word (the lanes behind it) and the later words of its group
    meets = (word0 + words)[of] - word
    ends = np.cumsum(meets)
    everything = ~np.uint64(0)
    done = 0
    while done < n:
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLAB, "right")))
        rows = np.repeat(np.arange(done, upto), meets[done:upto])
        offset = np.arange(len(rows)) - np.repeat(ends[done:upto] - meets[done:upto] - (ends[done - 1] if done else 0), meets[done:upto])
        done = upto
        at = word[rows] + offset
        valid = filled[at]
        own = offset == 0
        valid[own] &= (everything << lane[rows[own]]) & ~(np.uint64(1) << lane[rows[own]])
        live = valid != 0
        if label is not None:
            live &= ~(one_label[1][at] & (one_label[0][at] == label[rows]))
        rows, at, valid = rows[live], at[live], valid[live]
        ones, twos, fours, eights, sixteens, over = (np.zeros(len(rows), np.uint64) for _ in range(6))
        for k in range(0, 64, 7):
            x = [planes[b][at] ^ (np.uint64(0) - ((fps[rows] >> np.uint64(b)) & np.uint64(1))) for b in range(k, min(k + 7, 64))]
            while len(x) < 7:
                x.append(np.zeros(len(rows), np.uint64))
            a, c1 = _add(x[0], x[1], x[2])
            b, c2 = _add(x[3], x[4], x[5])
            s1, c3 = _add(a, b, x[6])
            s2, s4 = _add(c1, c2, c3)
            ones, carry = ones ^ s1, ones & s1
            twos, carry = _add(twos, s2, carry)
            fours, carry = _add(fours, s4, carry)
            eights, carry = eights ^ carry, eights & carry
            sixteens, carry = sixteens ^ carry, sixteens & carry
            over |= carry
            # lanes above the radius
            value, beyond = (ones, twos, fours, eights, sixteens), over
            equal = everything
            for bit in (4, 3, 2, 1, 0):
                if radius >> bit & 1:
                    equal = equal & value[bit]
                else:
                    beyond = beyond | (equal & value[bit])
                    equal = equal & ~value[bit]
            near = valid & ~beyond
            live = near != 0
            if not live.all():
                rows, at, valid, ones, twos, fours, eights, sixteens, over, near = (v[live] for v in (rows, at, valid, ones, twos, fours, eights, sixteens, over, near))
            if not len(rows):
                break
        if len(rows):
            hit, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = rows[hit], row_of[at[hit], bit]
            apart = slice(None) if label is None else label[i] != label[j]
            yield i[apart], j[apart]


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`label`, which has each row's least connected row, after rows `i` are connected to rows `j`."""
    label = label.copy()
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def spanning_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, earlier row) links that connect just what close_pairs() connects, at most one for each row."""
    label = np.arange(len(fps))
    for i, j in close_pairs(fps, group, radius):
        label = merged(label, i, j)
    rows = np.flatnonzero(label != np.arange(len(fps)))
    return rows, label[rows]


def _bucket_links(radius: int):
    keys = ["mask", "key", "part_a", "part_b"]

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            same = (held[keys] == held[keys].iloc[-1]).all(axis=1).to_numpy() if len(held) else np.zeros(0, bool)
            if len(held) < 4096 or same.all():
                continue
            yield links(held[~same])
            held = held[same]
        if held is not None and len(held):
            yield links(held)

    def links(pdf):
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        changed = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
        rows, to = spanning_links(fps, np.r_[0, np.cumsum(changed)], radius)
        docs = pdf["rep"].to_numpy(np.int64)
        return pd.DataFrame({"a": docs[rows], "b": docs[to]})

    return run


def linked(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between the `rep` ids of distinct fingerprints (fp, rep); they connect all that lie within `radius` bits."""
    fps = fps.select("fp", "rep")
    n = fps.count()
    masks = bucket_masks(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = fps.select("fp", "rep", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("x")).select("fp", "rep", "x.*")
    counted = dealt.groupBy("mask", "key").agg(F.count("*").alias("members")).where("members > 1")
    counted = cut(counted)
    parts = split_join(dealt, counted, ["mask", "key"], "members", n * len(masks), PART).withColumn("parts", F.ceil(F.col("members") / PART).cast("int"))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    parts = parts.select("mask", "key", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "fp", "rep")
    width = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 400_000)
    dealt = parts.repartition(width, "mask", "key", "part_a", "part_b").sortWithinPartitions("mask", "key", "part_a", "part_b")
    return dealt.mapInPandas(_bucket_links(radius), "a bigint, b bigint")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the fingerprint and the smallest id that links reach.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal ids give equal rows. A null id
    never names a component unless all ids of the component are null. Ids are whole numbers; other columns are not looked
    at. radius must be below 8, or there would be too many kinds of buckets. An empty table: no rows. A fingerprint that
    many rows have stays where its rows are: only its component is sent to them.
    """
    if not 0 <= radius < 8:
        raise ValueError("radius must be from 0 to 7")
    prints = cut(with_fingerprints(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), size=size))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = components(linked(distinct.where("rep is not null"), radius))
    labels = cut(distinct.join(found, distinct.rep == found.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")))
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return split_join(prints, labels, ["fp"], "n", total).select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
