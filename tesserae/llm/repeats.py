"""Passages that occur again: every byte that a string of LENGTH bytes covers which also starts earlier in the corpus.

A suffix array of the corpus can't be one task's, nor can all suffixes be shuffled. So each window of LENGTH bytes names an
anchor: the least hash among its GRAM-byte strings. Equal windows name equal anchors at equal places, hence whatever is
repeated meets in the group of its anchor, and an anchor stands for some 40 windows in a row, its context. Only contexts'
names are shuffled. Equal contexts but the first are repeats as they are; of anchors with one context nothing is repeated. What
is left, the contexts that share an anchor and differ, as at the edges of a passage, is fetched from the texts, and each task
builds an enhanced suffix array over its groups: ranks by prefix doubling, common prefixes from those ranks. A stack scan lists
the intervals of suffixes with a common prefix of LENGTH or more; those whose left neighbours differ are maximal repeats, and all
of an interval's occurrences, not neighbours alone, are told from the first.

An anchor with too many contexts for a suffix array is settled window by window: equal windows meet by their hash.
Names are 128 bits of polynomial hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import stored, table

#: Bytes that make a repeat, and of the strings that anchors are chosen from.
LENGTH, GRAM = 100, 24
#: Windows of a text to a piece, and bytes of pieces that are hashed at once: together below 2^24.
PIECE, BUFFER = 1 << 20, 1 << 21
#: Contexts of an anchor that a suffix array takes, and bytes of contexts in one array.
CONTEXTS, ARRAY = 10_000, 1 << 20
#: Rows that are looked at together.
ROWS = 100_000

#: Kinds of rows: a context's name, removed bytes [start, end), a context to be compared, one to be settled window by window.
NAMED, REMOVED, COMPARED, WINDOWED = 0, 1, 2, 3

_KINDS = {"kind": np.int8, "anchor": np.int64, "name": np.int64, "doc": np.int64, "tie": np.int64, "start": np.int32, "n": np.int32}
_ROW = "kind tinyint, anchor bigint, name bigint, doc bigint, tie bigint, start int, n int"
_PLACE = ["anchor", "name", "doc", "tie", "start"]
_made = np.random.default_rng(12).integers(0, 1 << 63, 514, dtype=np.uint64)
_BYTES, _BASES = (_made[:256], _made[256:512]), [int(x) | 1 for x in _made[512:]]
_powers: dict = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Sums:
    """Hashes of any substrings of a buffer: sums of byte values times powers of a base, modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        if which not in _powers or len(_powers[which][0]) < n:
            size, base = max(n, BUFFER), _BASES[which]
            both = [np.full(size, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
            for powers in both:
                powers[0] = 1
                np.cumprod(powers, out=powers)
            _powers[which] = both
        up, self.down = _powers[which]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[which][data] * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, size: int) -> np.ndarray:
        """Of all substrings of `size` bytes."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def _rows(**columns) -> dict:
    size = next(len(x) for x in columns.values() if np.ndim(x))
    return {c: np.broadcast_to(np.asarray(columns.get(c, 0)).astype(kind), size) for c, kind in _KINDS.items()}


def _joined(parts: list[dict]) -> dict:
    return {c: np.concatenate([np.zeros(0, kind), *(p[c] for p in parts)]) for c, kind in _KINDS.items()}


def _batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in _KINDS], names=list(_KINDS))


def contexts(pieces: list[tuple[int, int, int, bytes]], length: int) -> dict:
    """Rows for pieces (doc, tie, start, bytes) of texts, in order of place: names of contexts, each once, and what repeats within the pieces."""
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    offsets = np.cumsum(sizes) - sizes
    grams, whole = Sums(data, 0), Sums(data, 1)
    gram = min(GRAM, length)
    values = _mixed(grams.all_of(gram))
    low = np.uint64((1 << 24) - 1)
    owner = (_least((values & ~low) | np.arange(len(values), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    begins, valid = np.ones(len(owner) + 1, bool), np.zeros(len(owner) + 1, bool)
    begins[1:-1] = owner[1:] != owner[:-1]
    for at, size in zip(offsets, sizes):
        begins[at] = begins[at + size - length + 1] = True
        valid[at : at + size - length + 1] = True
    runs = np.flatnonzero(begins)
    n, runs = np.diff(runs), runs[:-1]
    n, runs = n[valid[runs]], runs[valid[runs]]
    anchor = values[owner[runs]]
    shape = ((owner[runs] - runs) * (1 << 20) + n).astype(np.uint64)
    name = _mixed(whole.of(runs, runs + n + length - 1) * np.uint64(0x9E3779B97F4A7C15) + shape)
    order = np.lexsort((runs, name, anchor))
    again = np.r_[False, (anchor[order][1:] == anchor[order][:-1]) & (name[order][1:] == name[order][:-1])]
    piece = np.searchsorted(offsets, runs, "right") - 1
    doc, tie, first = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
    start = runs - offsets[piece] + first[piece]
    new, old = order[~again], np.sort(order[again])
    made = [_rows(kind=NAMED, anchor=anchor[new].view(np.int64), name=name[new].view(np.int64), doc=doc[piece[new]], tie=tie[piece[new]], start=start[new], n=n[new])]
    if len(old):
        # repeats of one text that touch become one row
        s, e, p = start[old], start[old] + n[old] + length - 1, piece[old]
        cut = np.r_[True, (p[1:] != p[:-1]) | (s[1:] > e[:-1])]
        at = np.flatnonzero(cut)
        made.append(_rows(kind=REMOVED, anchor=_mixed(s[at].astype(np.uint64)).view(np.int64), doc=doc[p[at]], tie=tie[p[at]], start=s[at], n=np.maximum.reduceat(e, at)))
    return _joined(made)


def _named(length: int):
    def run(batches):
        for batch in batches:
            # a row that repeats an id and its text is the same document
            rows = sorted({(d, t): i for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))}.items())
            pieces, size = [], 0
            for (doc, tie), i in rows:
                text = batch.column(2)[i].as_py()
                for start in range(0, len(text) - length + 1, PIECE):
                    pieces.append((doc, tie, start, text[start : start + PIECE + length - 1]))
                    size += len(pieces[-1][3])
                    if size >= BUFFER:
                        yield _batch(contexts(pieces, length))
                        pieces, size = [], 0
            if pieces:
                yield _batch(contexts(pieces, length))

    return run


def _met(length: int, most: int):
    """Rows in order of anchor, name and place: what repeats a context, and the contexts to be compared. No more is held than the first contexts of an anchor."""

    def settled(rows: dict, wide: bool, last: bool):
        """Rows to pass on, rows to hold, and whether those are the last context of an anchor with too many, passed on already."""
        own = np.flatnonzero(rows["kind"] == NAMED)
        passed = [{c: v[rows["kind"] == REMOVED] for c, v in rows.items()}]
        if not len(own):
            return passed, _joined([]), False
        anchor, name = rows["anchor"][own], rows["name"][own]
        first = np.r_[True, (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])]
        lead = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
        same = np.logical_and.reduce([rows[c][own] == rows[c][lead] for c in ("doc", "tie", "start")])
        again = {c: v[own[~first & ~same]] for c, v in rows.items()}
        passed.append({**again, "kind": np.full(len(again["n"]), REMOVED, np.int8), "n": again["start"] + again["n"] + np.int32(length - 1)})
        leads, anchor = own[first], anchor[first]
        bounds = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(leads)]
        number = np.repeat(np.diff(bounds), np.diff(bounds))
        over = (number > most) | (wide & (anchor == anchor[0]))
        open_ = (anchor == anchor[-1]) & (not last)
        told = (np.arange(len(leads)) == 0) & wide
        for kind, which in ((COMPARED, ~over & ~open_ & (number > 1)), (WINDOWED, over & ~told)):
            passed.append({c: v[leads[which]] for c, v in rows.items()} | {"kind": np.full(which.sum(), kind, np.int8)})
        wide = bool((open_ & over).any())
        hold = leads[-1:] if wide else leads[open_]
        return passed, {c: v[hold] for c, v in rows.items()}, wide

    def run(batches):
        hold, parts, size, wide = _joined([]), [], 0, False

        def flushed(last):
            nonlocal hold, parts, size, wide
            passed, hold, wide = settled(_joined([hold, *parts]), wide, last)
            parts, size = [], 0
            return _batch(_joined(passed))

        for batch in batches:
            parts.append({c: np.asarray(batch.column(i)).astype(kind) for i, (c, kind) in enumerate(_KINDS.items())})
            size += batch.num_rows
            if size >= ROWS:
                yield flushed(False)
        yield flushed(True)

    return run


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, texts, places) of each maximal repeat of `least` bytes or more: its occurrences, in no order.

    A repeat is maximal if it can be extended neither right nor left for all of its occurrences; a text's start ends extension.
    """
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    total = len(data)
    there = np.arange(total)
    left = ends[text] - there
    # ranks of the first 7, 14, 28, ... bytes; what is beyond a text is less than any byte
    key = np.zeros(total, np.int64)
    for j in range(7):
        use = np.flatnonzero(left > j)
        key[use] |= data[use + j] << (9 * (6 - j))
    ranks, size = [np.unique(key, return_inverse=True)[1] + 1], 7
    while size < sizes.max():
        beyond = np.zeros(total, np.int64)
        use = np.flatnonzero(left > size)
        beyond[use] = ranks[-1][use + size]
        ranks.append(np.unique((ranks[-1] << 32) | beyond, return_inverse=True)[1] + 1)
        size *= 2
    suffixes = np.flatnonzero(left >= least)
    suffixes = suffixes[np.argsort(ranks[-1][suffixes], kind="stable")]
    if len(suffixes) < 2:
        return []
    a, b = suffixes[:-1], suffixes[1:]
    most = np.minimum(left[a], left[b])
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero(common < most)
        at = at[ranks[level][a[at] + common[at]] == ranks[level][b[at] + common[at]]]
        common[at] += 7 << level
    for _ in range(6):
        at = np.flatnonzero(common < most)
        at = at[data[a[at] + common[at]] == data[b[at] + common[at]]]
        common[at] += 1
    common = np.minimum(common, most)
    # a text's start has a neighbour of its own
    before = np.where(left[suffixes] == sizes[text[suffixes]], -1 - text[suffixes], data[suffixes - 1])
    changes = np.r_[0, np.cumsum(before[1:] != before[:-1])]
    found = []
    stack: list[tuple[int, int]] = []
    for i in np.flatnonzero(np.r_[common, 0] >= least):
        if stack and (i == 0 or common[i - 1] < least):
            _closed(stack, 0, int(i), changes, found)
        at = int(i)
        if stack and stack[-1][0] > common[i]:
            at = _closed(stack, int(common[i]), int(i), changes, found)
        if not stack or stack[-1][0] < common[i]:
            stack.append((int(common[i]), at))
        if i + 1 == len(common) or common[i + 1] < least:
            _closed(stack, 0, int(i) + 1, changes, found)
    starts = ends - sizes
    return [(n, text[own := suffixes[x : y + 1]], own - starts[text[own]]) for n, x, y in found]


def _closed(stack, down_to, last, changes, found) -> int:
    """Take intervals with longer prefixes than `down_to`, which end at suffix `last`, from the stack; those with different left neighbours are found."""
    at = last
    while stack and stack[-1][0] > down_to:
        n, at = stack.pop()
        if changes[last] > changes[at]:
            found.append((n, at, last))
    return at


def _compared(length: int, array: int):
    """Contexts in order of anchors: the maximal repeats of all groups that fit one array, as occurrences that aren't the first."""

    def removed(rows):
        # contexts none of whose windows is met twice can't be part of a repeat
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        offsets = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), n)
        windows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[owner]
        hashes = Sums(data, 0).of(windows, windows + length)
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        rows = [rows[i] for i in np.unique(owner[times[back] > 1])]
        out = []
        if rows:
            place = [(r[1], r[2], r[3]) for r in rows]
            for size, texts, at in maximal_repeats([r[5] for r in rows], length):
                own = [(*place[t][:2], place[t][2] + int(x)) for t, x in zip(texts.tolist(), at.tolist())]
                first = min(own)
                out += [(d, t, s, s + size) for d, t, s in own if (d, t, s) > first]
        # a suffix is in all the intervals around its own: what they remove of one text is passed on once
        merged = []
        for d, t, s, e in sorted(set(out)):
            if merged and merged[-1][:2] == [d, t] and s <= merged[-1][3]:
                merged[-1][3] = max(merged[-1][3], e)
            else:
                merged.append([d, t, s, e])
        spans = np.array(merged, np.int64).reshape(-1, 4)
        return _batch(_rows(kind=REMOVED, doc=spans[:, 0], tie=spans[:, 1], start=spans[:, 2], n=spans[:, 3]))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= array and held[-1][0] != row[0]:
                    yield removed(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield removed(held)

    return run


def _fetched(length: int, kind: int):
    """The bytes of wanted contexts, or the names of their windows."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, size = [], 0
            for doc, tie, z, wanted in zip(*(batch.column(i) for i in range(4))):
                doc, tie, text = doc.as_py(), tie.as_py(), unpack(z.as_py())
                for want in wanted.as_py():
                    out.append((want["anchor"], doc, tie, want["start"], want["n"], text[want["start"] : want["start"] + want["n"] + length - 1]))
                    size += want["n"] + length
                    if size >= 4 << 20:
                        yield packed(out)
                        out, size = [], 0
            if out:
                yield packed(out)

    def packed(rows):
        if kind == COMPARED:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["anchor", "doc", "tie", "start", "n", "context"])
        parts = []
        for _, doc, tie, start, n, text in rows:
            data = np.frombuffer(text, np.uint8)
            anchor, name = (_mixed(Sums(data, k).all_of(length)).view(np.int64) for k in (0, 1))
            parts.append(_rows(kind=NAMED, anchor=anchor, name=name, doc=doc, tie=tie, start=start + np.arange(n), n=1))
        return _batch(_joined(parts))

    return run


def _shrunk(batches):
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        texts = pa.array([pack(x.as_py()) for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc", "tie", "z"])


def _kept(batches):
    kinds = (("doc", pa.int64()), ("tie", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
    for batch in batches:
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for doc, tie, z, spans in zip(*(batch.column(i) for i in range(4))):
            text, merged = unpack(z.as_py()), []
            for span in sorted((s["start"], s["n"]) for s in spans.as_py() or ()):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], span[1]))
                else:
                    merged.append(span)
            digest, at = hashlib.sha256(), 0
            for start, end in merged:
                digest.update(text[at:start])
                at = end
            digest.update(text[at:])
            out.append((doc.as_py(), tie.as_py(), len(text), sum(e - s for s, e in merged), digest.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _per_text(spans: DataFrame, *columns: str) -> DataFrame:
    return spans.groupBy("doc", "tie").agg(F.collect_list(F.struct(*columns)).alias("wanted"))


def removed_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = CONTEXTS, array: int = ARRAY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row: the bytes [start, end) that repeat what starts earlier.

    Texts are UTF-8 bytes, null texts empty. Earlier is a smaller id, or the same text and a smaller start. Null ids come first, as the least long, which isn't an id
    itself. Rows that share an id are ordered by a hash of their texts; if their texts are equal too they are the same document and get the
    same result. Texts shorter than `length` have no repeats. Ids are whole numbers; other columns are not looked at. No
    rows: no rows.
    """
    whole: Column = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc"), whole.alias("text"))
    repeated = not docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").isEmpty()
    null = F.lit(-(1 << 63))
    docs = docs.select(F.coalesce("doc", null).alias("doc"), (F.xxhash64("text") if repeated else F.lit(0).cast("bigint")).alias("tie"), "text")
    shrunk = docs.mapInArrow(_shrunk, "doc bigint, tie bigint, z binary")

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("anchor").sortWithinPartitions(*_PLACE).mapInArrow(_met(length, most), _ROW)

    found = stored(met(docs.mapInArrow(_named(length), _ROW)))
    one = shrunk.dropDuplicates(["doc", "tie"]) if repeated else shrunk

    def fetched(kind: int, out: str) -> DataFrame:
        wanted = _per_text(found.where(F.col("kind") == kind), "anchor", "start", "n")
        return one.join(wanted, ["doc", "tie"]).select("doc", "tie", "z", "wanted").mapInArrow(_fetched(length, kind), out)

    near = fetched(COMPARED, "anchor bigint, doc bigint, tie bigint, start int, n int, context binary").repartition("anchor").sortWithinPartitions("anchor")
    spans = found.unionByName(near.mapInArrow(_compared(length, array), _ROW))
    if not found.where(F.col("kind") == WINDOWED).isEmpty():
        spans = spans.unionByName(met(fetched(WINDOWED, _ROW)))
    removed = _per_text(spans.where(F.col("kind") == REMOVED).select("doc", "tie", "start", "n"), "start", "n")
    kept = shrunk.join(removed, ["doc", "tie"], "left").select("doc", "tie", "z", "wanted")
    kept = kept.mapInArrow(_kept, "doc bigint, tie bigint, n_bytes bigint, n_removed bigint, kept_sha256 string, spans array<struct<start: int, end: int>>")
    return kept.select("doc", "tie", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "spans").withColumn("doc_id", F.nullif("doc", null)).drop("doc", "tie")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
bytes as (select doc_id, encode(text) as b, octet_length(encode(text)) as n from docs),
windows as (select doc_id, unnest(generate_series(0, n - {LENGTH})) as p, b from bytes),
hashed as (select doc_id, p, md5_number(b[p + 1 : p + {LENGTH}]) as h from windows),
named as (select doc_id, p, row_number() over (partition by h order by doc_id, p) as k from hashed),
marks as (select doc_id, p, p + {LENGTH} as till from named where k > 1),
cut as (select *, p > coalesce(max(till) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), -1) as fresh from marks),
grouped as (select *, sum(fresh::int) over (partition by doc_id order by p) as g from cut),
spans as (select doc_id, g, min(p) as s, max(till) as e from grouped group by doc_id, g),
gaps as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as a, s as z from spans
    union all select b.doc_id, coalesce(max(e), 0), any_value(b.n) from bytes b left join spans s on s.doc_id = b.doc_id group by b.doc_id),
kept as (select g.doc_id, string_agg(hex(b.b[a + 1 : z]), '' order by a) as h from gaps g join bytes b on b.doc_id = g.doc_id group by g.doc_id),
sums as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans from spans group by doc_id)
select b.doc_id, b.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(k.h)) as kept_sha256
from bytes b join kept k on k.doc_id = b.doc_id left join sums u on u.doc_id = b.doc_id
"""
