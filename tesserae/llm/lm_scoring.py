"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

The filter holds, for each training bigram whose count falls in level q of a geometric scale, the bigram once for each
level 1..q. Asking for a count is asking for membership at level 1, 2, ... until one is missing. It never reads too low
a level; it reads too high a one with the small chance of a false positive at each step.

Probabilities are Dirichlet-smoothed: p(w | v) = (min(c(vw), c(v)) + MU p(w)) / (c(v) + MU), with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

Texts are split into words once, into blocks of about BLOCK bytes that hold each word as a number. Unigram counts are
exact: each block sends its distinct words to the segments of the vocabulary and gets their counts back. The filter is
cut into segments by hash. T training tokens make a filter of 1.45 T bytes at most (see filter_bound); where that is below
BROADCAST the filter is broadcast. What is learned must grow with the corpus, so no bound holds for all: beyond it each
block sends its distinct bigrams to the segments, which probe the same filter and send the levels back. Both ways give
the same scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import cut, fold_of, stored, table, whole_text

MU = 20.0
#: Each level of counts is this many times the one before.
STEP = 2.0**0.5
#: Bits set for a bigram at level 1, and at each further level.
FIRST, FURTHER = 8, 3
#: Largest filter that is broadcast, in bytes.
BROADCAST = 160 << 20
#: Training tokens to a segment of the filter, and compressed bytes of the blocks' words to a segment of the vocabulary, about.
SEGMENT, WORDS = 2_000_000, 4 << 20
#: Training tokens whose bigrams are counted before they are sent, and hashes that are probed at once.
STRETCH, PROBED = 3_000_000, 1 << 17
#: Bytes of text to a block; a longer text is a block of its own.
BLOCK = 5 << 20
FOLDS, HELD_OUT = 5, 1
_START = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(xxhash.xxh64_intdigest(b"", 7) >> 16)  # no word is empty
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts in one array, and how many each text has; without end tokens."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0))
    ends = np.r_[0, np.cumsum(keep)][np.cumsum(np.asarray(pc.list_value_length(parts)), dtype=np.int64)] if len(texts) else np.zeros(0, np.int64)
    return flat.filter(pa.array(keep)), np.diff(ends, prepend=0)


def filter_bound(tokens: int) -> int:
    """Bytes that a filter of so many tokens can have: a bigram seen c times takes FIRST + FURTHER 2 log2(c) bits, never more than FIRST c."""
    return math.ceil(1.4427 * FIRST * tokens / 8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _salt(level: int) -> np.uint64:
    return np.uint64(level * int(_M3) & (1 << 64) - 1)


def _scaled(x: np.ndarray, size) -> np.ndarray:
    """A place below `size` (itself below 2^32) from the upper half of x."""
    return (x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The middle of each level's counts; 0 for level 0."""
    q = np.arange(256.0)
    low = np.ceil(STEP ** (q - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(STEP**q - 1e-9) - 1)
    return np.where(q > 0, (low + high) / 2, 0.0)[levels]


def bigrams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of all bigrams of texts with `sizes` tokens each, from their words' hashes; where each text begins."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    before = np.r_[_START, words[:-1]] if len(words) else words
    before[starts] = _START
    return _mix(before * _M3 + _mix(words)) >> np.uint64(16), starts


class Segment:
    """One segment of the filter."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, np.uint64(size)

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray) -> "Segment":
        levels = 1 + np.floor(np.log(counts) / np.log(STEP) + 1e-9).astype(np.int64)
        size = max(64, int(1.4427 * (FIRST * len(hashes) + FURTHER * int((levels - 1).sum()))))
        bits = np.zeros(-(-size // 8), np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            here = np.flatnonzero(levels >= level)
            for at in range(0, len(here), PROBED):
                for place in Segment.places(hashes[here[at : at + PROBED]], level, size):
                    np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7))).astype(np.uint8))
        return Segment(bits, size)

    @staticmethod
    def places(hashes: np.ndarray, level: int, size):
        x = _mix(hashes + _salt(level))
        step = _mix(x ^ _M2) | np.uint64(1)
        for _ in range(FIRST if level == 1 else FURTHER):
            yield _scaled(x, size)
            x = x + step

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The highest level that repeated probes reach, 0 for none."""
        if len(hashes) > PROBED:
            return np.concatenate([self.levels(hashes[at : at + PROBED]) for at in range(0, len(hashes), PROBED)])
        level = np.zeros(len(hashes), np.uint8)
        alive = np.arange(len(hashes))
        q = 0
        while len(alive):
            q += 1
            x = _mix(hashes[alive] + _salt(q))
            step = _mix(x ^ _M2) | np.uint64(1)
            for _ in range(FIRST if q == 1 else FURTHER):
                place = _scaled(x, self.size)
                hit = (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, x, step = alive[hit], x[hit] + step[hit], step[hit]
            level[alive] = q
        return level


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Ranges of the 48-bit hashes."""
    return ((hashes >> np.uint64(16)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _packed(data: bytes) -> bytes:
    """The length in eight bytes, then the data, compressed."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all lowest bytes first, compressed: what high bytes there are takes no room."""
    return _packed(numbers.view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T.tobytes())


def _unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unpacked(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _record(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), arrow)], schema=arrow)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of about BLOCK bytes of a partition's texts: its texts' ids, `train` and numbers of tokens (the
    end counted), its distinct words with their hashes and their counts in training texts, and all tokens as places in
    that list (the end token: one past it)."""
    ids = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(ids)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))]
        + [T.StructField(c, T.LongType()) for c in ("train_texts", "train_words")]
        + [T.StructField(c, T.BinaryType()) for c in ("words", "hashes", "counts", "codes")]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        known: dict[str, int] = {}
        held, size, made = [], 0, TaskContext.get().partitionId() << 32

        def out():
            nonlocal made, size
            doc_ids, texts, train = (pa.concat_arrays([batch.column(i) for batch in held]) for i in range(3))
            held.clear()
            size = 0
            flat, sizes = tokens(texts)
            train = np.asarray(train)
            coded = flat.dictionary_encode()
            codes, words = coded.indices.to_numpy(), coded.dictionary
            names = words.to_pylist()
            if len(known) > 200_000:
                known.clear()
            for w in set(names).difference(known):
                known[w] = xxhash.xxh64_intdigest(w, 7) >> 16
            hashes = np.fromiter(map(known.__getitem__, names), np.uint64, len(names))
            seen = np.bincount(codes[np.repeat(train, sizes)], minlength=len(words)).astype(np.uint32)
            codes = np.insert(codes, np.cumsum(sizes), len(words)).astype(np.int32)
            lists = [_one_list(x) for x in (doc_ids, pa.array(train), pa.array((sizes + 1).astype(np.int32)))]
            cells = [int(train.sum()), int(seen.sum()), _packed(" ".join(names).encode()), _planes(hashes), _planes(seen), _planes(codes)]
            columns = [pa.array([made]), *lists, *(pa.array([x]) for x in cells)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
            made += 1

        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column(1)))
            first = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= BLOCK:
                    held.append(batch.slice(first, i + 1 - first))
                    first = i + 1
                    yield from out()
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield from out()

    return rows.select("doc_id", "text", "train").mapInArrow(run, schema)


_WORDS = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("answer", T.BinaryType()), T.StructField("distinct", T.LongType())])


def _by_segment(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by segment, and where each begins in it."""
    of = segment_of(hashes, segments)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(segments + 1))


def _word_counts(blocks: DataFrame, segments: int) -> DataFrame:
    """_ANSWER rows of kind 0: for each block and vocabulary segment, the training counts of the block's words there. `distinct` adds
    up to the number of words with a count."""

    def send(batches):
        for batch in batches:
            for block, words, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, counts = _unplanes(hashes, np.uint64), _unplanes(counts, np.uint32)
                if not len(hashes):
                    continue
                order, cuts = _by_segment(hashes, segments)
                names = pc.split_pattern(pa.array([_unpacked(words)], pa.binary()).cast(pa.string()), " ").flatten().take(pa.array(order))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), names), " ").to_pylist()
                counts = counts[order]
                yield _record(_WORDS, [(s, block, _packed(joined[s].encode()), _planes(counts[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

    def count(table: pa.Table) -> pa.Table:
        lists = pc.split_pattern(pa.array([_unpacked(x) for x in table["words"].to_pylist()], pa.binary()).cast(pa.string()), " ")
        sizes = np.asarray(pc.list_value_length(lists))
        seen = np.concatenate([_unplanes(x, np.uint32) for x in table["counts"].to_pylist()])
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        # whole numbers below 2^53, so the sums are exact
        sums = np.bincount(codes, seen, minlength=len(coded.dictionary)).astype(np.uint64)
        cuts = np.r_[0, np.cumsum(sizes)]
        blocks, segment = table["block"].to_pylist(), table["segment"][0].as_py()
        answers = [_planes(sums[codes[a:b]]) for a, b in zip(cuts, cuts[1:])]
        known = int((sums > 0).sum())
        return pa.Table.from_batches([_record(_ANSWER, [(b, 0, segment, x, known if i == 0 else 0) for i, (b, x) in enumerate(zip(blocks, answers))])])

    return blocks.select("block", "words", "hashes", "counts").mapInArrow(send, _WORDS).groupBy("segment").applyInArrow(count, _ANSWER)


def _block_bigrams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's bigrams, where its texts begin, and its tokens' codes."""
    codes = _unplanes(row["codes"], np.int32)
    hashes = np.r_[_unplanes(row["hashes"], np.uint64), _END]
    found, starts = bigrams(hashes[codes], np.asarray(row["sizes"], np.int64))
    return found, starts, codes


_PACKET = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _packets(blocks: DataFrame, segments: int, every: bool) -> DataFrame:
    """Each segment's distinct bigrams with their counts in training texts, sorted and stored as differences; both columns
    lie in byte planes. With `every`, a packet for each block, and bigrams that no training text has with count 0; else
    packets of a stretch of blocks."""

    def packets(block, hashes, counts):
        cuts = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
        rows = [(s, block, _planes(np.diff(hashes[a:b], prepend=np.uint64(0))), _planes(counts[a:b].astype(np.uint32))) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return [_record(_PACKET, rows)] if rows else []

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                found, _, _ = _block_bigrams(row)
                train = np.repeat(np.asarray(row["train"], bool), row["sizes"])
                if every:
                    hashes, inverse = np.unique(found, return_inverse=True)
                    yield from packets(row["block"], hashes, np.bincount(inverse[train], minlength=len(hashes)))
                    continue
                held.append(found[train])
                size += len(held[-1])
                if size > STRETCH:
                    yield from packets(None, *np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield from packets(None, *np.unique(np.concatenate(held), return_counts=True))

    return blocks.select("block", "train", "sizes", "hashes", "codes").mapInArrow(run, _PACKET)


def _segment_of_packets(table: pa.Table) -> tuple[Segment, list[np.ndarray]]:
    """The segment of the filter that the packets make, and each packet's hashes."""
    parts = [np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64) for x in table["hashes"].to_pylist()]
    hashes = np.concatenate(parts)
    counts = np.concatenate([_unplanes(x, np.uint32) for x in table["counts"].to_pylist()])
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    sums = np.add.reduceat(counts, first)
    return Segment.build(hashes[first][sums > 0], sums[sums > 0]), parts


_BITS = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("bits", T.BinaryType()), T.StructField("size", T.LongType())])


def _bits(table: pa.Table) -> pa.Table:
    made, _ = _segment_of_packets(table)
    return pa.Table.from_batches([_record(_BITS, [(table["segment"][0].as_py(), made.bits.tobytes(), int(made.size))])])


def _levels(table: pa.Table) -> pa.Table:
    """_ANSWER rows of kind 1: the levels that the segment's filter tells for each packet's bigrams."""
    made, parts = _segment_of_packets(table)
    segment = table["segment"][0].as_py()
    return pa.Table.from_batches([_record(_ANSWER, [(b, 1, segment, _packed(made.levels(x).tobytes()), 0) for b, x in zip(table["block"].to_pylist(), parts)])])


class _Filter:
    """All segments, as broadcast."""

    def __init__(self, rows):
        self.segments = {r.segment: (bytes(r.bits), r.size) for r in rows}

    def levels(self, hashes: np.ndarray, segments: int) -> np.ndarray:
        """For hashes in rising order."""
        out = np.zeros(len(hashes), np.uint8)
        cuts = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
        for s, (bits, size) in self.segments.items():
            a, b = cuts[s], cuts[s + 1]
            out[a:b] = Segment(np.frombuffer(bits, np.uint8), size).levels(hashes[a:b])
        return out


def _log_p(pair, before, prob):
    # a pair can't be more frequent than its first word; this also undoes most of what the filter reads too high
    return np.log10((np.minimum(pair, before) + MU * prob) / (before + MU))


def _scorer(total: int, distinct: int, texts: int, word_segments: int, segments: int, shared, schema: T.StructType):
    """From a block and the answers to it, the measures and the score of each of its texts."""
    scale = total + 0.5 * (distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        row = {c: left[c][0].as_py() for c in ("hashes", "codes", "sizes")}
        answers = {(k, s): x for k, s, x in zip(*(right[c].to_pylist() for c in ("kind", "segment", "answer")))}
        found, starts, codes = _block_bigrams(row)
        order, _ = _by_segment(_unplanes(row["hashes"], np.uint64), word_segments)
        counts = np.zeros(len(order) + 1)
        counts[order] = np.concatenate([_unplanes(answers[0, s], np.uint64) for s in range(word_segments) if (0, s) in answers] or [np.zeros(0)])
        counts[-1] = texts
        prob = (counts + 0.5) / scale
        hashes, inverse = np.unique(found, return_inverse=True)
        if shared is not None:
            levels = shared.value.levels(hashes, segments)
        else:
            levels = np.concatenate([np.frombuffer(_unpacked(answers[1, s]), np.uint8) for s in range(segments) if (1, s) in answers])
        before = np.r_[0.0, counts[codes[:-1]]]
        before[starts] = float(texts)  # as many starts as ends
        score = np.add.reduceat(_log_p(counts_of(levels)[inverse], before, prob[codes]), starts)
        base = np.add.reduceat(np.log10(prob)[codes], starts)
        have = np.add.reduceat((counts > 0).astype(np.int64)[codes], starts)
        ids, train = (left[c].combine_chunks().flatten() for c in ("doc_ids", "train"))
        columns = [ids, train, np.asarray(row["sizes"], np.int64), have, base, score]
        return pa.Table.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return run


def score(df: DataFrame, train, text: str = "text", doc_id: str = "doc_id", broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of `df`.

    `train`: a boolean column expression; the model learns from these rows alone (null: not). Null texts count as empty:
    the end token alone. Repeated rows are scored each. With nothing to learn from, all probabilities are 1 / (V + 1).
    An empty table gives no rows. Ids may be null, repeated or of any type; other columns are not looked at. A text is
    held whole, in a block of its own if it is longer than BLOCK.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = stored(_blocks(rows))
    row = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("train_texts", "train_words", F.length("words")))).first()
    texts, total = row[0], row[0] + row[1]
    word_segments, segments = max(1, -(-row[2] // WORDS)), max(1, -(-total // SEGMENT))
    answers = stored(_word_counts(blocks, word_segments))
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] + (texts > 0)
    shared = None
    if filter_bound(total) <= broadcast:
        bits = cut(_packets(blocks, segments, False).groupBy("segment").applyInArrow(_bits, _BITS))
        shared = df.sparkSession.sparkContext.broadcast(_Filter(bits.toLocalIterator()))
    else:
        answers = answers.unionByName(stored(_packets(blocks, segments, True).groupBy("segment").applyInArrow(_levels, _ANSWER)))
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in ("base_score", "score")]
    )
    scorer = _scorer(total, distinct, texts, word_segments, segments, shared, schema)
    own = blocks.select("block", "doc_ids", "train", "sizes", "hashes", "codes")
    out = own.groupBy("block").cogroup(answers.select("block", "kind", "segment", "answer").groupBy("block")).applyInArrow(scorer, schema)
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
