"""Byte-level BPE as a bounded-lookahead streaming transducer, and the state machine that undoes it.

How far must one read beyond a place to know whether a token ends there? A merge (a, b) can fail to happen only
because something to the right first took b, or a piece on b's right edge. That merge (s, c) must come earlier in the
list than the merge that would have consumed s, and it in turn depends only on what is to its right. Ranks fall at
each step, so the longest chain is found in one pass over the list; `lookahead` is the number of bytes in it. A token
boundary is stable once that many bytes behind it are known, so a transducer needs a buffer of fixed size however long
the text is.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: White space of the pre-token rule, as Unicode's White_Space property has it.
WS = r"\t-\r \x85\xa0  -     　"
#: The pre-token rule of the vocabulary file (a fixed value), with white space spelled out.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS + r"\p{L}\p{N}]+|[" + WS + r"]+(?![^" + WS + r"])|[" + WS + r"]+"
)
#: A space with other white space beside it: then words can't be taken apart at single spaces.
UNEVEN_SPACE = re.compile("[" + WS + "] | [" + WS + "]")
#: A place where the pre-token rule surely starts anew: one space between two characters that are none.
SAFE_CUT = re.compile("(?<=[^" + WS + "]) (?=[^" + WS + "])")
SEGMENT = 1 << 16
#: Characters that are held back when no boundary is in sight, before the pre-token that goes on is passed on by bytes.
HELD = 1 << 15
#: How many characters behind its end can change what a pre-token is.
SIGHT = 3
#: A pre-token that goes on: letters, numbers, other signs or white space.
RUNS = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", "[^" + WS + r"\p{L}\p{N}]+", "[" + WS + "]+"))
NEVER = 1 << 30
HASH = 0x9E3779B97F4A7C15
CACHED = 300_000
CACHED_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pair_table(rank_of: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.uint64, int]:
    """An open table from pair keys to ranks for whole arrays: keys, ranks, multiplier, most probes."""
    bits = max(4, len(rank_of).bit_length() + 3)
    keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
    most, mask = 1, (1 << bits) - 1
    for key, rank in rank_of.items():
        at, probes = ((key * HASH) & ((1 << 64) - 1)) >> (64 - bits), 1
        while keys[at] >= 0:
            at, probes = (at + 1) & mask, probes + 1
        keys[at], ranks[at], most = key, rank, max(most, probes)
    return keys, ranks, np.uint64(64 - bits), most


class Vocabulary:
    """A tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.byte_ids = [model["vocab"][c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((model["vocab"][a], model["vocab"][b]), (rank, model["vocab"][a + b]))
        self.sight = SIGHT + max([0, *(len(x) - 1 for x in self.special)])
        self.special_rule = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.rank_of = {a << 17 | b: rank for (a, b), (rank, _) in self.merges.items()}
        self.token_of = {rank: new for rank, new in self.merges.values()}
        self.table = _pair_table(self.rank_of)
        self.tokens = np.zeros(len(self.token_of), np.int64)
        self.tokens[list(self.token_of)] = list(self.token_of.values())
        self.first_ids = np.array(self.byte_ids, np.int64)
        self.lookahead = self._sufficient_lookahead()
        self.window = 4 * self.lookahead + 1024

    def _sufficient_lookahead(self) -> int:
        made = {new: (rank, b) for (_, b), (rank, new) in self.merges.items()}
        ranks: dict[int, list[int]] = {}
        reach: dict[int, list[int]] = {}  # running maxima beside `ranks`
        longest = 0
        for (a, b), (rank, _) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            here, s, before = 0, b, rank
            while True:
                if (k := bisect_left(ranks.get(s, ()), before)) > 0:
                    here = max(here, reach[s][k - 1])
                if s not in made:
                    break
                before, s = made[s]
            here += len(self.bytes_of[b])
            ranks.setdefault(a, []).append(rank)
            reach.setdefault(a, []).append(max(here, reach[a][-1]) if reach.get(a) else here)
            longest = max(longest, here)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a whole pre-token: always the earliest merge of the list, the leftmost first."""
        ids, merges = [self.byte_ids[b] for b in data], self.merges
        if len(ids) <= 64:
            rank_of, token_of = self.rank_of, self.token_of
            ranks = [rank_of.get(a << 17 | b, NEVER) for a, b in zip(ids, ids[1:])]
            while ranks and (first := min(ranks)) != NEVER:
                i = ranks.index(first)
                ids[i] = new = token_of[first]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank_of.get(ids[i - 1] << 17 | new, NEVER)
                if i < len(ranks):
                    ranks[i] = rank_of.get(new << 17 | ids[i + 1], NEVER)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (p := before[i]) >= 0 and (m := merges.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [x for x in ids if x >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, ranks, shift, most = self.table
        key = a << 17 | b
        at = ((key.view(np.uint64) * np.uint64(HASH)) >> shift).astype(np.int64)
        out = np.where(keys[at] == key, ranks[at], NEVER)
        open_ = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        for _ in range(most - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(keys) - 1)
            there = keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many short pre-tokens at once, packed: in each round every piece makes its earliest merge."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ranks = np.full(len(ids), NEVER, np.int64)  # of the pair that begins here

        def rank(at):
            at = at[(at >= 0) & (at + 1 < len(ids))]
            same = owner[at] == owner[at + 1]
            ranks[at[~same]] = NEVER
            at = at[same]
            ranks[at] = self._ranks(ids[at], ids[at + 1])

        rank(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(ids)])
            if (done := least == NEVER).any():
                packed = ids.astype("<i4")
                for s, n, o in zip(starts[done].tolist(), lengths[done].tolist(), owner[starts[done]].tolist()):
                    out[o] = packed[s : s + n].tobytes()
                stay = np.repeat(~done, lengths)
                ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
                if not len(ids):
                    break
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                lengths, least = np.diff(np.r_[starts, len(ids)]), least[~done]
            hits = np.flatnonzero(ranks == np.repeat(least, lengths))
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]  # the leftmost of each piece
            ids[hits] = self.tokens[ranks[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            last = hits + 1 == len(ids) - 1
            ranks[hits] = NEVER
            moved = hits - np.arange(len(hits))  # where they stand once the consumed ids are gone
            ranks[hits[~last]] = NEVER
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            rank(np.concatenate([moved, moved - 1]))
            if last.any():
                ranks[-1] = NEVER
        return out

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one pre-token that arrives in pieces, each as soon as it is stable. The buffer stays bounded."""
        machine = Lookahead(self)
        for chunk in chunks:
            yield from machine.push(chunk)
        yield from machine.finish()


class Lookahead:
    """One pre-token by bytes: a token is emitted once `lookahead` bytes behind it are known. Never holds more than two windows."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.buffer = vocabulary, b""

    def push(self, chunk: bytes) -> Iterator[int]:
        v = self.vocabulary
        for i in range(0, len(chunk), v.window):
            self.buffer += chunk[i : i + v.window]
            if len(self.buffer) >= v.window:
                done, stable = 0, len(self.buffer) - v.lookahead
                for token in v.merge(self.buffer):
                    if (end := done + len(v.bytes_of[token])) > stable:
                        break
                    yield token
                    done = end
                self.buffer = self.buffer[done:]

    def finish(self) -> Iterator[int]:
        last, self.buffer = self.buffer, b""
        yield from self.vocabulary.merge(last) if last else ()


class _Kept(dict):
    """What has been worked out for a piece of text; forgotten when there is too much of it."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, piece: str) -> bytes:
        out = self.work(piece)
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Texts to ids. Ids are packed as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pretoken = _Kept(self._pretoken)
        self.spaced = _Kept(lambda word: self._pieces(" " + word))

    def _pretoken(self, piece: str) -> bytes:
        data, v = piece.encode("utf-8", "surrogatepass"), self.vocabulary
        # the end of a short pre-token is in sight, so all its tokens are stable at once
        return array("i", v.merge(data) if len(data) < v.window else v.transduce([data])).tobytes()

    def learn(self, texts: Iterable[str]) -> None:
        """Work out the pieces of these texts that aren't known yet, all together. Only saves time."""
        words: set[str] = set()
        pieces: set[str] = set()
        for text in texts:
            for part in self.segments(text):
                if part and part[-1] != " " and not UNEVEN_SPACE.search(part):
                    first, *rest = part.split(" ")
                    words.update(rest)
                    pieces.update(PRETOKEN.findall(first))
                else:
                    pieces.update(PRETOKEN.findall(part))
        words = words.difference(self.spaced)
        split = {w: PRETOKEN.findall(" " + w) for w in words if len(w) <= CACHED_BYTES}
        pieces.update(*split.values())
        self.learn_pieces(pieces)
        if len(self.spaced) + len(split) > CACHED:
            self.spaced.clear()
        self.spaced.update((w, b"".join(map(self.pretoken.__getitem__, x))) for w, x in split.items())

    def learn_pieces(self, pieces: set[str]) -> None:
        new = [x for x in pieces.difference(self.pretoken) if len(x) <= CACHED_BYTES]
        if len(self.pretoken) + len(new) > CACHED:
            self.pretoken.clear()
            new = [x for x in pieces if len(x) <= CACHED_BYTES]
        self.pretoken.update(zip(new, self.vocabulary.merge_many([x.encode("utf-8", "surrogatepass") for x in new])))

    def _pieces(self, text: str) -> bytes:
        return b"".join([self.pretoken[x] for x in PRETOKEN.findall(text)])

    def segments(self, text: str) -> Iterator[str]:
        """The text in parts of bounded size, cut where the pre-token rule starts anew anyway."""
        at = 0
        while len(text) - at > SEGMENT and (m := SAFE_CUT.search(text, at + SEGMENT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def plain(self, text: str) -> Iterator[bytes]:
        for part in self.segments(text):
            if not part:
                continue
            if part[-1] == " " or UNEVEN_SPACE.search(part):
                yield b"".join([self.pretoken[m.group()] for m in PRETOKEN.finditer(part)])
            else:
                first, *rest = part.split(" ")
                yield (self._pieces(first) if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids, in pieces of bounded size."""
        machine = Transducer(self)
        for i in range(0, len(text), SEGMENT):
            yield from machine.feed(text[i : i + SEGMENT], i + SEGMENT >= len(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(text)), dtype="<i4")


class Transducer:
    """A text that arrives in pieces to packed ids, each as soon as it is stable.

    What it holds: the characters behind the last sure boundary, HELD of them and a piece at most; or, inside a pre-token
    longer than that, the bytes of Lookahead and the few characters that a special token or the end of the run may need.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.held, self.run, self.machine = encoder, "", None, None

    def feed(self, piece: str, last: bool = False) -> Iterator[bytes]:
        """Ids that are stable now; with `last`, all that are left."""
        self.held += piece
        v = self.encoder.vocabulary
        sure = len(self.held) if last else len(self.held) - v.sight
        at = 0
        # a special token ends what stands before it, whatever comes after
        for m in v.special_rule.finditer(self.held) if v.special_rule is not None else ():
            if m.end() > sure:
                sure = m.start() - SIGHT  # a longer one might still come of it
                break
            yield from self._text(self.held[at : m.start()], m.start() - at, True)
            yield np.array([v.special[m.group()]], dtype="<i4").tobytes()
            at = m.end()
        self.held = yield from self._text(self.held[at:], sure - at, last)

    def _text(self, text: str, sure: int, last: bool):
        """Packed ids of `text`, in which no special token is left; returns what isn't decided yet, behind `sure` at least."""
        if self.run is not None:
            size = len(text)
            text = yield from self._go_on(text, sure, last)
            sure -= size - len(text)
            if self.run is not None:
                return text
        if last:
            yield from self.encoder.plain(text)
            return ""
        cut = text.rfind(" ", 0, max(sure, 0))
        while cut > 0 and not SAFE_CUT.match(text, cut):
            cut = text.rfind(" ", 0, cut)
        if cut > 0:
            yield from self.encoder.plain(text[:cut])
            text, sure = text[cut:], sure - cut
        if len(text) <= HELD:
            return text
        cut = 0
        for m in PRETOKEN.finditer(text):
            if m.end() > sure:
                break
            yield self.encoder.pretoken[m.group()]
            cut = m.end()
        text, sure = text[cut:], sure - cut
        if sure > HELD:  # all of it one pre-token
            self.run = next(r for r in RUNS if r.match(text, sure - 1))
            self.machine = Lookahead(self.encoder.vocabulary)
            yield self._packed(self.machine.push(text[: sure - 1].encode("utf-8", "surrogatepass")))
            text = text[sure - 1 :]
        return text

    def _go_on(self, text: str, sure: int, last: bool):
        """The same inside a long pre-token: it goes on as long as its kind of characters does."""
        m = self.run.match(text)
        end = m.end() if m else 0
        if end > sure and not last:
            end = max(0, sure - 1)
            yield self._packed(self.machine.push(text[:end].encode("utf-8", "surrogatepass")))
            return text[end:]
        if 0 < end < len(text) and self.run is RUNS[3]:
            end -= 1  # white space leaves its last character to what follows
        yield self._packed(self.machine.push(text[:end].encode("utf-8", "surrogatepass")))
        yield self._packed(self.machine.finish())
        self.run = self.machine = None
        return text[end:]

    @staticmethod
    def _packed(ids: Iterable[int]) -> bytes:
        return array("i", ids).tobytes()


class Decoder:
    """Ids to text, one piece at a time; bytes of an unfinished character wait for the next piece. Bad bytes become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of

    def stream(self, pieces: Iterable[np.ndarray]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))
        yield machine.decode(b"", final=True)

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids[i : i + 16384] for i in range(0, len(ids), 16384)))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per process and file."""
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))
