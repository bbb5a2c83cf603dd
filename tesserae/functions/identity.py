"""Content identity: BLAKE3 to 16 bytes, computed for many inputs at once, and ids of codepoints, sequences and runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of BLAKE3.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_PERMUTE = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
#: Rows of the state, k places on.
_TURNED = {k: [(i + k) % 4 for i in range(4)] for k in range(-3, 4)}
#: Blocks that are hashed together, so many that their state stays in the cache.
_AT_ONCE = 4096
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
CHUNK = 1024
SIZE = 16


def _mix(v: np.ndarray, x: np.ndarray, y: np.ndarray, spare: np.ndarray) -> None:
    """The quarter rounds of all four columns of the state (4, 4, n), in place."""
    a, b, c, d = v
    for m, rd, rb in ((x, 16, 12), (y, 8, 7)):
        a += b
        a += m
        for to, by, turn in ((d, a, rd), (c, d, 0), (b, c, rb)):
            if not turn:
                to += by
                continue
            to ^= by
            np.right_shift(to, np.uint32(turn), out=spare)
            to <<= np.uint32(32 - turn)
            to |= spare


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) and message words (16, n) to the first 8 output words (8, n)."""
    n = chain.shape[1]
    out = np.empty((8, n), np.uint32)
    for first in range(0, n, _AT_ONCE):
        own = slice(first, min(first + _AT_ONCE, n))
        v = np.empty((16, own.stop - first), np.uint32)
        v[:8], v[8:12] = chain[:, own], _IV[:4, None]
        v[12], v[13], v[14], v[15] = counter[own] & np.uint64(0xFFFFFFFF), counter[own] >> np.uint64(32), length[own], flags[own]
        v, spare = v.reshape(4, 4, -1), np.empty((4, own.stop - first), np.uint32)
        m, order = words[:, own], np.arange(16)
        for _ in range(7):
            _mix(v, m[order[0:8:2]], m[order[1:8:2]], spare)
            # the diagonals as columns
            for k in (1, 2, 3):
                v[k] = v[k][_TURNED[k]]
            _mix(v, m[order[8:16:2]], m[order[9:16:2]], spare)
            for k in (1, 2, 3):
                v[k] = v[k][_TURNED[-k]]
            order = order[_PERMUTE]
        v = v.reshape(16, -1)
        np.bitwise_xor(v[:8], v[8:], out=out[:, own])
    return out


def _chunks(parts: list[bytes], numbers: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of chunks of at most CHUNK bytes; `root` marks those that are their input's only chunk.

    The longest come first, so that those with a b-th block are always the first ones.
    """
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = np.maximum(1, -(-lengths // 64))
    order = np.argsort(-blocks, kind="stable")
    lengths, blocks, numbers, root = lengths[order], blocks[order], numbers[order].astype(np.uint64), root[order]
    starts = np.r_[0, np.cumsum(blocks)] * 64
    # all chunks in one buffer, each padded to whole blocks
    data = np.frombuffer(b"".join(x for i, n, k in zip(order.tolist(), lengths.tolist(), blocks.tolist()) for x in (parts[i], bytes(64 * k - n))), "<u4").reshape(-1, 16)
    chain = np.repeat(_IV[:, None], len(parts), axis=1)
    for b in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(-blocks, -b, "left"))
        last = blocks[:n] == b + 1
        flags = np.where(last, _END | np.where(root[:n], _ROOT, 0), 0) | (_START if b == 0 else 0)
        size = np.where(last, lengths[:n] - 64 * b, 64)
        chain[:, :n] = _compress(chain[:, :n], np.ascontiguousarray(data[starts[:n] // 64 + b].T), numbers[:n], size, flags)
    out = np.empty_like(chain)
    out[:, order] = chain
    return out


def _hash_some(inputs: list[bytes]) -> np.ndarray:
    """Chaining values (8, n) of whole inputs: chunks, then their trees pair by pair, level by level, all inputs at once.

    A level's odd last value goes up as it is: so the left side of every node has the largest power of two.
    """
    counts = np.array([max(1, -(-len(x) // CHUNK)) for x in inputs])
    parts = [x[i : i + CHUNK] for x in inputs for i in range(0, max(len(x), 1), CHUNK)]
    firsts = np.r_[0, np.cumsum(counts)]
    numbers = np.arange(len(parts)) - np.repeat(firsts[:-1], counts)
    values = _chunks(parts, numbers, np.repeat(counts == 1, counts))
    while (counts > 1).any():
        at = np.arange(values.shape[1]) - np.repeat(firsts[:-1], counts)
        size = np.repeat(counts, counts)
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < size))
        flags = np.where(size[left] == 2, _PARENT | _ROOT, _PARENT)
        words = np.concatenate([values[:, left], values[:, left + 1]])
        values[:, left] = _compress(np.repeat(_IV[:, None], len(left), axis=1), words, np.zeros(len(left), np.uint64), np.full(len(left), 64), flags)
        values = np.ascontiguousarray(values[:, at % 2 == 0])
        counts = -(-counts // 2)
        firsts = np.r_[0, np.cumsum(counts)]
    return values


def _packed(values: np.ndarray) -> list[bytes]:
    data = np.ascontiguousarray(values.T).astype("<u4").tobytes()
    return [data[i : i + 32] for i in range(0, len(data), 32)]


def blake3_chunks(parts: list[bytes], numbers: np.ndarray, root: bool = False) -> list[bytes]:
    """Chaining values, 32 bytes each, of the chunks with these numbers in their input; root: of a chunk that is all of it."""
    return _packed(_chunks(parts, numbers, np.full(len(parts), root)))


def blake3_parents(left: list[bytes], right: list[bytes], root: bool = False) -> list[bytes]:
    """Chaining values of the nodes above pairs of nodes; root: of the tree's top, which is the digest."""
    words = np.concatenate([np.frombuffer(b"".join(side), "<u4").reshape(-1, 8).T for side in (left, right)])
    n = len(left)
    flags = np.full(n, _PARENT | (_ROOT if root else 0))
    return _packed(_compress(np.repeat(_IV[:, None], n, axis=1), words, np.zeros(n, np.uint64), np.full(n, 64), flags))


def hash_many(inputs: list[bytes]) -> list[bytes]:
    """The first 16 bytes of BLAKE3 of each input."""
    out: list[bytes] = []
    at = 0
    while at < len(inputs):
        # as many as fit a few megabytes of padded blocks
        end, size = at, 0
        while end < len(inputs) and (end == at or size < 1 << 22):
            size += len(inputs[end]) + 64
            end += 1
        packed = np.ascontiguousarray(_hash_some(inputs[at:end])[:4].T).astype("<u4").tobytes()
        out += [packed[i : i + SIZE] for i in range(0, len(packed), SIZE)]
        at = end
    return out


def hash_rows(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first 16 bytes of BLAKE3, (n, 16), of stretches of ids (n, 16) of CHUNK bytes at most, given by where they begin and end."""
    sizes = np.diff(offsets)
    out = np.empty((len(sizes), SIZE), np.uint8)
    blocks = np.maximum(1, -(-sizes // 4))
    order = np.argsort(-blocks, kind="stable")
    at = 0
    while at < len(order):
        own = order[at : at + (1 << 15)]
        at += len(own)
        k, n = int(blocks[own[0]]), len(own)
        data = np.zeros((n, 4 * k, SIZE), np.uint8)
        row = np.repeat(np.arange(n), sizes[own])
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        data[row, place] = rows[np.repeat(offsets[:-1][own], sizes[own]) + place]
        words = data.reshape(n, k, 64).view("<u4")
        chain = np.repeat(_IV[:, None], n, axis=1)
        for b in range(k):
            m = int(np.searchsorted(-blocks[own], -b, "left"))
            last = blocks[own[:m]] == b + 1
            flags = np.where(last, _END | _ROOT, 0) | (_START if b == 0 else 0)
            size = np.where(last, SIZE * sizes[own[:m]] - 64 * b, 64)
            chain[:, :m] = _compress(chain[:, :m], np.ascontiguousarray(words[:m, b].T), np.zeros(m, np.uint64), size, flags)
        out[own] = np.ascontiguousarray(chain[:4].T).astype("<u4").view(np.uint8)
    return out


def encode(text: str) -> bytes:
    """UTF-8, lone surrogates in their three-byte form."""
    return text.encode("utf-8", "surrogatepass")


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class Composer:
    """A store of compositions that are told apart by structure; their ids are hashed together when asked for.

    A node is a number. Nodes below are codepoints or tuples of nodes; equal tuples are one node. So repeats can be
    found, and documents decomposed, before anything is hashed.
    """

    def __init__(self):
        self.parts: list[tuple[int, ...] | str] = []
        self.number: dict[tuple[int, ...] | str, int] = {}
        self.tier: list[int] = []
        self.id: list[bytes] = []
        #: Word segments that were decomposed, by text, and sentences by their segments.
        self.words: dict[str, int] = {}
        self.sentences: dict[tuple[str, ...], int] = {}

    def atom(self, char: str) -> int:
        return self._put(char, 0)

    def _put(self, key, tier: int) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.parts)
            self.parts.append(key)
            self.tier.append(tier)
        return n

    def compose(self, children) -> int:
        """One child is that child; else a new level above the highest child."""
        children = tuple(children)
        return children[0] if len(children) == 1 else self._put(children, min(255, 1 + max(map(self.tier.__getitem__, children), default=0)))

    def made(self, children: list[int]) -> int:
        """compose() after factoring, as it is done at every level of a text."""
        return self.compose(self.factor(children) if len(children) >= 4 else children)

    def factor(self, items: list[int]) -> list[int]:
        """Adjacent repeats of a block of two constituents or more become copies of one composition, leftmost and shortest first."""
        size = squares(items)
        if not any(size):
            return items
        out: list[int] = []
        i, n = 0, len(items)
        while i < n:
            p = size[i]
            if not p:
                out.append(items[i])
                i += 1
                continue
            block, times = items[i : i + p], 2
            while items[i + times * p : i + (times + 1) * p] == block:
                times += 1
            out += [self.compose(self.factor(block))] * times
            i += times * p
        return out

    def ids(self) -> list[bytes]:
        """Ids of all nodes so far; new ones are hashed level by level."""
        done = len(self.id)
        self.id += [b""] * (len(self.parts) - done)
        by_tier: dict[int, list[int]] = {}
        for n in range(done, len(self.parts)):
            by_tier.setdefault(self._height(n), []).append(n)
        for tier in sorted(by_tier):
            nodes = by_tier[tier]
            data = [encode(p) if isinstance(p := self.parts[n], str) else b"".join(map(self.id.__getitem__, p)) for n in nodes]
            for n, digest in zip(nodes, hash_many(data)):
                self.id[n] = digest
        return self.id

    def id_table(self) -> np.ndarray:
        """ids() as (n, 16) bytes."""
        return np.frombuffer(b"".join(self.ids()), np.uint8).reshape(-1, SIZE)

    def add(self, items: np.ndarray, offsets: np.ndarray, tiers: np.ndarray, digests: np.ndarray) -> None:
        """Nodes whose parts are stretches of items and whose ids are known; they aren't found by structure."""
        data = digests.tobytes()
        self.id += [data[i : i + SIZE] for i in range(0, len(data), SIZE)]
        self.tier += tiers.tolist()
        flat = items.tolist()
        ends = offsets.tolist()
        self.parts += [tuple(flat[a:b]) for a, b in zip(ends, ends[1:])]

    def _height(self, n: int) -> int:
        return self.tier[n]


def _may_repeat(items: list[int]) -> bool:
    """False only where no block of two or more, unless uniform, is followed by itself: without a frequent item (blanks between words)
    such a square leaves two equal neighbours, or four neighbours that all come twice."""
    often = max(items[0], items[1], key=items.count)
    rest = [x for x in items if x != often]
    seen: set[int] = set()
    twice = {x for x in rest if x in seen or seen.add(x)}
    if not twice:
        return False
    near, last = 0, None
    for x in rest:
        near = near + 1 if x in twice else 0
        if near == 4 or x == last:
            return True
        last = x
    return False


def squares(items: list[int]) -> list[int]:
    """For each place the shortest period p >= 2 with two equal, non-uniform blocks of length p from there on; else 0."""
    n = len(items)
    if n < 4 or not _may_repeat(items):
        return [0] * n
    pairs = list(zip(items, items[1:]))
    if len(set(pairs)) == n - 1:  # a square has its first pair twice
        return [0] * n
    if n > 160:
        return _squares_of_runs(np.array(items))
    out = [0] * n
    seen: set[tuple[int, int]] = set()
    later: dict[tuple[int, int], list[int]] = {x: [] for x in pairs if x in seen or seen.add(x)}
    for i in [i for i, x in enumerate(pairs) if x in later][::-1]:
        first, places = items[i], later[pairs[i]]
        for at in reversed(places):  # the nearest first
            p = at - i
            if i + 2 * p > n:
                break
            if p > 1 and items[i:at] == items[at : at + p] and items[i:at].count(first) != p:
                out[i] = p
                break
        places.append(i)
    return out


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: the ranks, from 1, of the stretches of 2^k items from each place on, cut off at the end."""
    n, out = len(codes), [np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1]
    while out[-1].max() < n:
        step = 1 << len(out) - 1
        behind = np.zeros(n, np.int64)
        if step < n:
            behind[: n - step] = out[-1][step:]
        out.append(np.unique(out[-1] * (n + 1) + behind, return_inverse=True)[1].astype(np.int64) + 1)
    return out


def _squares_of_runs(items: np.ndarray) -> list[int]:
    """squares() in O(n log n), by the runs theorem: every maximal repetition starts from a longest Lyndon word, in the order
    of items or in its reverse, and that word is as long as its period. A shortest square lies in such a repetition."""
    n = len(items)
    levels = _ranks(items)
    place = np.arange(n)

    def common(i, j, step):
        """How many items from i and from j on (step 1), or up to them (step -1), are equal."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            width = 1 << k
            a, b = (i + got, j + got) if step == 1 else (i - got - width + 1, j - got - width + 1)
            lo, hi = np.minimum(a, b), np.maximum(a, b) + width
            ok = np.flatnonzero((lo >= 0) & (hi <= n))
            same = ok[levels[k][a[ok]] == levels[k][b[ok]]]
            got[same] += width
        return got

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for ranks in (levels[-1], _ranks(-items)[-1]):
        # the next smaller suffix: where the longest Lyndon word of each place ends
        nearest, stack = [n] * n, []
        for i, r in enumerate(ranks.tolist()):
            while stack and stack[-1][1] > r:
                nearest[stack.pop()[0]] = i
            stack.append((i, r))
        p = np.array(nearest) - place
        use = np.flatnonzero((p >= 2) & (place + p < n))
        i, p = place[use], p[use]
        left, right = common(i - 1, i + p - 1, -1), common(i, i + p, 1)
        deep = left + right >= p
        found.append((p[deep], (i - left)[deep], (i + right - p)[deep]))
    p, first, last = (np.concatenate(x) for x in zip(*found))
    out = np.zeros(n, np.int64)
    for k in np.lexsort((first, -p)).tolist():  # shorter periods are written over longer ones
        out[first[k] : last[k] + 1] = p[k]
    return out.tolist()


def id_of_text_column(text: Column) -> Column:
    """Id of a string as a flat sequence of codepoints; null for null and empty strings."""

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        letters = sorted({c for t in texts if t for c in t})
        ids = dict(zip(letters, hash_many([encode(c) for c in letters])))
        known = {t: None for t in texts if t}
        flat = [t for t in known if len(t) > 1]
        known.update(zip(flat, hash_many([b"".join(map(ids.__getitem__, t)) for t in flat])))
        known.update({t: ids[t] for t in known if len(t) == 1})
        return texts.map(lambda t: known[t] if t else None)

    return run(text)


def compose_column(ids: Column) -> Column:
    """Id of an array of ids; one id is itself, none hashes the empty sequence."""

    @F.pandas_udf(T.BinaryType())
    def run(lists: pd.Series) -> pd.Series:
        digests = hash_many([b"".join(map(bytes, x)) if x is not None else b"" for x in lists])
        return pd.Series([None if x is None else bytes(x[0]) if len(x) == 1 else d for x, d in zip(lists, digests)])

    return run(ids)
