"""Text to its parts: paragraphs, sentences, word segments, graphemes, codepoints; and back."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex

from tesserae.functions.identity import Composer, encode, hash_rows

_GRAPHEME = regex.compile(r"\X")
_WORD = regex.compile(r"(?V1w)\b")
_JOINER = regex.compile(r"[\p{WB=MidLetter}\p{WB=MidNum}\p{WB=MidNumLet}\p{WB=ExtendNumLet}\p{WB=Single_Quote}\p{WB=Double_Quote}]")
#: A line break with text on both sides.
_LONE = regex.compile(r"(?<=[^\n\r \t][ \t]*)(?:\r\n|\n|\r)(?=[ \t]*[^\n\r \t])")
def _of_plane_0(properties: str) -> str:
    """The characters below U+10000 that have one of these properties, as ranges in a class of `re`, which is faster than `regex`."""
    found = regex.finditer(f"[{properties}]+", "".join(map(chr, range(0x10000))))
    return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in found)


_LETTERS, _BLANKS = _of_plane_0(r"\p{WB=ALetter}\p{WB=Hebrew_Letter}\p{WB=Numeric}"), _of_plane_0(r"\p{WB=WSegSpace}")
#: In text without _ODD characters a word segment is a run of letters and digits, a run of blanks, CR LF or a character.
_ODD = re.compile(f"[{_of_plane_0(r'\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}\p{WB=Katakana}\p{WB=Regional_Indicator}')}\U00010000-\U0010ffff]")
_SEGMENT = re.compile(f"[{_LETTERS}]+|[{_BLANKS}]+|\r\n|(?s:.)")
#: Two characters of one segment.
_JOINED = re.compile(f"[{_LETTERS}]{{2}}|[{_BLANKS}]{{2}}|\r\n")
_HIGH = re.compile("[\U00010000-\U0010ffff]")


class _Stops:
    """What ends sentences, as patterns of `regex`, or of `re` for text without characters from U+10000 on."""

    def __init__(self, compiled, named):
        c = lambda *names: named("".join(rf"\p{{SB={x}}}" for x in names))
        para = r"\r\n|[\n\r\x85\u2028\u2029]"
        #: A terminator with what belongs to it (1 the terminator, 2 closing marks, 3 blanks, 4 a separator), or a paragraph separator.
        self.stop = compiled(f"{para}|([{c('ATerm', 'STerm')}])[{c('Extend', 'Format')}]*([{c('Close')}]*)([{c('Sp')}]*)({para})?")
        self.lower_ahead = compiled(f"[^{c('OLetter', 'Upper', 'Lower', 'Sep', 'CR', 'LF', 'STerm', 'ATerm')}]*[{c('Lower')}]")
        self.on = compiled(f"[{c('SContinue', 'STerm', 'ATerm')}]")
        self.dot, self.digit, self.upper = (compiled(f"[{c(x)}]") for x in ("ATerm", "Numeric", "Upper"))
        self.cased = compiled(f"[{c('Upper', 'Lower')}]")


_ANY, _PLANE_0 = _Stops(regex.compile, str), _Stops(re.compile, _of_plane_0)


def blanked(text: str) -> str:
    """Lone line breaks as spaces, byte for byte: what the boundaries are looked for in."""
    return _LONE.sub(lambda m: " " * len(m[0]), text)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans by the default rules of UAX #29."""
    by = _ANY if _HIGH.search(text) else _PLANE_0
    cuts = [0]
    for m in by.stop.finditer(text):
        end = m.end()
        term, close, space, sep = m.groups()
        if term and not sep:
            dot = by.dot.match(term) is not None
            if end == len(text):
                pass
            elif dot and not close and not space and by.digit.match(text, end):
                continue
            elif dot and not close and not space and m.start() and by.cased.match(text, m.start() - 1) and by.upper.match(text, end):
                continue
            elif dot and by.lower_ahead.match(text, end):
                continue
            elif by.on.match(text, end):
                continue
        if end > cuts[-1]:
            cuts.append(end)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:]))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Word segments that cover every character; characters that join words stand by themselves."""
    cuts = {0, len(text), *(m.start() for m in _WORD.finditer(text))}
    for m in _JOINER.finditer(text):
        cuts.update(m.span())
    cuts = sorted(cuts)
    return list(zip(cuts, cuts[1:]))


#: Words of at most 32 letters of Latin, Greek and Cyrillic script, graphemes each.
_ALONE = re.compile("[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u0377\u0386-\u03ff\u0400-\u0481\u048a-\u052f]{1,32}")
_SQUARE = re.compile(r"(?s:(..+)\1)")


def _graphemes(word: str) -> list[str]:
    return list(word) if word.isascii() and "\r" not in word else _GRAPHEME.findall(word)


def cut_up(text: str) -> tuple[str, list[tuple[int, int]], list[str] | None]:
    """The text with lone line breaks as blanks, its sentences, and its word segments, cut where sentences end. No segments: those of
    each sentence are what _SEGMENT finds in it."""
    shown = blanked(text)
    spans = sentences(shown)
    if not _ODD.search(shown) and not any(_JOINED.match(shown, end - 1) for _, end in spans[:-1]):
        return shown, spans, None
    cuts = sorted({x for span in (*word_spans(shown), *spans) for x in span})
    return shown, spans, [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _words_of(text: str, shown: str) -> list[str]:
    """The word segments of a sentence that has none of the _ODD characters."""
    words = _SEGMENT.findall(shown)
    if text == shown:
        return words
    cuts = [0, *accumulate(map(len, words))]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def words(text: str) -> list[str]:
    """The word segments in order."""
    shown, spans, found = cut_up(text)
    return [w for a, b in spans for w in _words_of(text[a:b], shown[a:b])] if found is None else found


def lengths(text: str) -> list[int]:
    """Lengths of the word segments in order, in bytes of UTF-8."""
    shown, spans, found = cut_up(text)
    if found is None:  # blanks are as long as the breaks they stand for
        found = [w for a, b in spans for w in _SEGMENT.findall(shown[a:b])]
    return list(map(len, found)) if text.isascii() else [len(w) if w.isascii() else len(encode(w)) for w in found]


#: Words of at most 32 letters of Latin, Greek and Cyrillic script, graphemes each.
_ALONE = re.compile("[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u0377\u0386-\u03ff\u0400-\u0481\u048a-\u052f]{1,32}")
_SQUARE = re.compile(r"(?s:(..+)\1)")


def _graphemes(word: str) -> list[str]:
    return list(word) if word.isascii() and "\r" not in word else _GRAPHEME.findall(word)


def cut_up(text: str) -> tuple[str, list[tuple[int, int]], list[str] | None]:
    """The text with lone line breaks as blanks, its sentences, and its word segments, cut where sentences end. No segments: those of
    each sentence are what _SEGMENT finds in it."""
    shown = blanked(text)
    spans = sentences(shown)
    if not _ODD.search(shown) and not any(_JOINED.match(shown, end - 1) for _, end in spans[:-1]):
        return shown, spans, None
    cuts = sorted({x for span in (*word_spans(shown), *spans) for x in span})
    return shown, spans, [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _words_of(text: str, shown: str) -> list[str]:
    """The word segments of a sentence that has none of the _ODD characters."""
    words = _SEGMENT.findall(shown)
    if text == shown:
        return words
    cuts = [0, *accumulate(map(len, words))]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def lengths(text: str) -> list[int]:
    """Lengths of the word segments in order, in bytes of UTF-8."""
    shown, spans, words = cut_up(text)
    if words is None:
        words = [w for a, b in spans for w in _SEGMENT.findall(shown[a:b])]  # breaks and blanks are as long
    return [len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words] if not text.isascii() else list(map(len, words))


def segment(word: str, store: Composer) -> int:
    """The node of a word segment."""
    if word in store.words:
        return store.words[word]
    if _ALONE.fullmatch(word):
        letters = tuple(map(store.number.get, word))
        if None in letters:
            letters = tuple(map(store.atom, word))
        # most words repeat nothing, which costs less to see in their letters
        if len(word) > 1 and not _SQUARE.search(word):
            node = store._put(letters, 1)
        else:
            node = store.made(list(letters))
    else:
        node = store.made([store.made([store.atom(c) for c in g]) for g in _graphemes(word)])
    store.words[word] = node
    return node


def decompose(text: str, store: Composer, visit=None) -> int:
    """The root of the text's tree in `store`. visit(offset, length, node) sees the word segments in order, in bytes of UTF-8."""
    shown, spans, words = cut_up(text)
    known, paragraphs, open_sentences = store.words, [], []
    at = k = 0
    ends = None if words is None else list(accumulate(map(len, words)))
    for n, (start, end) in enumerate(spans):
        own, own_shown = text[start:end], shown[start:end]
        if words is None:
            key = own if own == own_shown else (own, own_shown, None)
        else:
            first, k = k, bisect_left(ends, end, k) + 1
            inside = key = tuple(words[first:k])
        sentence = store.sentences.get(key)
        if sentence is None or visit is not None:
            if words is None:
                inside = _words_of(own, own_shown)
            segments = list(map(known.get, inside))
            if None in segments:
                segments = [segment(word, store) if node is None else node for word, node in zip(inside, segments)]
            if visit is not None:
                for word, node in zip(inside, segments):
                    size = len(word) if word.isascii() else len(encode(word))
                    visit(at, size, node)
                    at += size
            sentence = store.sentences[key] = store.made(segments)
        open_sentences.append(sentence)
        tail = start + len(own.rstrip(" \t\r\n"))
        if n == len(spans) - 1 or any(text[i] in "\r\n" and shown[i] != " " for i in range(tail, end)):
            paragraphs.append(store.made(open_sentences))
            open_sentences = []
    return store.made(paragraphs) if paragraphs else store.compose(())


def _kinds() -> np.ndarray:
    """Of the characters below U+10000: 1 letters and digits, 2 blanks, 0 others."""
    out = np.zeros(0x10000, np.int8)
    for kind, pattern in ((1, _LETTERS), (2, _BLANKS)):
        out[[ord(m[0]) for m in re.finditer(f"[{pattern}]", "".join(map(chr, range(0x10000))))]] = kind
    return out


_KIND = _kinds()
#: Characters below U+10000 that are graphemes wherever they stand in a word of their like.
_SIMPLE = np.zeros(0x10000, bool)
_SIMPLE[[c for c in range(0x530) if _ALONE.fullmatch(chr(c))]] = True
_SIMPLE[32] = True
#: Sentences of more segments, and words of more letters, are composed by themselves.
_BULK = 64


def _repeating(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the stretches, of _BULK items at most, may have a square of period two or more."""
    n, found = len(items), np.zeros(len(starts), bool)
    for p in range(2, int(sizes.max(initial=0)) // 2 + 1):
        same = np.concatenate([[0], np.cumsum(items[:-p] == items[p:], dtype=np.int32)])
        at = np.flatnonzero(same[p:] - same[:-p] == p)  # p items equal those p further on
        if len(at):
            own = np.searchsorted(starts, at, "right") - 1
            found[own[at + 2 * p <= starts[own] + sizes[own]]] = True
    return found


def _bulk(store: Composer, items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tiers: np.ndarray) -> np.ndarray:
    """Numbers of new nodes that are stretches of items; their ids are hashed at once."""
    first = len(store.parts)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    own = items[_stretches(starts, sizes)]
    digests = hash_rows(store.id_table()[own], offsets)
    store.add(own, offsets, tiers, digests)
    return np.arange(first, first + len(sizes))


def decompose_many(texts: list[str], store: Composer) -> list[int | None]:
    """decompose() of each text, None for null and empty ones; ids of all nodes are known afterwards.

    Words and sentences without repeats, nearly all, are cut, composed and hashed in arrays. Equal nodes of a store may have two
    numbers here, but not where they are neighbours.
    """
    # sentences once each
    known: dict = {}
    plain: list[tuple[str, str]] = []
    documents = []
    for text in texts:
        if not text:
            documents.append(None)
            continue
        shown, spans, words = cut_up(text)
        ends = None if words is None else list(accumulate(map(len, words)))
        k, own = 0, []
        for n, (start, end) in enumerate(spans):
            piece, as_shown = text[start:end], shown[start:end]
            if words is None:
                key = piece if piece == as_shown else (piece, as_shown, None)
                if key not in known:
                    known[key] = len(plain)
                    plain.append((piece, as_shown))
            else:
                first, k = k, bisect_left(ends, end, k) + 1
                key = tuple(words[first:k])
                known.setdefault(key, None)
            tail = start + len(piece.rstrip(" \t\r\n"))
            last = n == len(spans) - 1 or any(text[i] in "\r\n" and shown[i] != " " for i in range(tail, end))
            own.append((key, last))
        documents.append(own)
    numbers = _plain_sentences(plain, store)
    for key, at in known.items():
        known[key] = int(numbers[at]) if at is not None else store.made([segment(w, store) for w in key])
    ids = store.ids()
    # one number for each id, since one text may be a sentence in two ways
    one: dict[bytes, int] = {}
    for key, node in known.items():
        known[key] = one.setdefault(ids[node], node)
    roots = []
    for own in documents:
        if own is None:
            roots.append(None)
            continue
        paragraphs, open_sentences = [], []
        for key, last in own:
            open_sentences.append(known[key])
            if last:
                paragraphs.append(store.made(open_sentences))
                open_sentences = []
        roots.append(store.made(paragraphs))
    store.ids()
    return roots


def _plain_sentences(plain: list[tuple[str, str]], store: Composer) -> np.ndarray:
    """Nodes of sentences without _ODD characters, each with how it is shown."""
    if not plain:
        return np.zeros(0, np.int64)
    letters, shown = (np.frombuffer("".join(x).encode("utf-16-le", "surrogatepass"), "<u2") for x in zip(*plain))
    sentence_ends = np.cumsum([len(x) for x, _ in plain])
    kind = _KIND[shown]
    joined = (kind[1:] == kind[:-1]) & (kind[1:] > 0) | (shown[:-1] == 13) & (shown[1:] == 10)
    joined[sentence_ends[:-1] - 1] = False
    starts = np.flatnonzero(np.concatenate([[True], ~joined]))
    sizes = np.diff(np.append(starts, len(letters)))
    # words by their letters, told apart by their bytes
    offsets = np.append(starts, len(letters)) * 2
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters.tobytes())]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    firsts = np.full(len(coded.dictionary), -1, np.int64)
    firsts[codes[::-1]] = np.arange(len(codes))[::-1]
    word_starts, word_sizes = starts[firsts], sizes[firsts]
    alphabet, at = np.unique(letters, return_inverse=True)
    atoms = np.array([store.atom(chr(c)) for c in alphabet.tolist()])[at.reshape(-1)]
    store.ids()
    simple = _SIMPLE[letters]
    bad = np.concatenate([[0], np.cumsum(~simple, dtype=np.int64)])
    nodes = np.empty(len(firsts), np.int64)
    single = word_sizes == 1
    nodes[single] = atoms[word_starts[single]]
    bulk = ~single & (word_sizes <= _BULK) & (bad[word_starts + word_sizes] == bad[word_starts])
    order = np.flatnonzero(bulk)
    order = order[np.argsort(word_starts[order])]
    # repeats are looked for in the words by themselves
    at = _stretches(word_starts[order], word_sizes[order])
    own_starts = np.concatenate([[0], np.cumsum(word_sizes[order])])[:-1]
    repeats = _repeating(atoms[at], own_starts, word_sizes[order])
    bulk[order[repeats]] = False
    order = order[~repeats]
    nodes[order] = _bulk(store, atoms, word_starts[order], word_sizes[order], np.ones(len(order), np.int32))
    words = coded.dictionary
    for k in np.flatnonzero(~single & ~bulk).tolist():
        nodes[k] = segment(words[k].as_py().decode("utf-16-le", "surrogatepass"), store)
    store.ids()
    # sentences as stretches of words
    items = nodes[codes]
    bounds = np.concatenate([[0], np.searchsorted(starts, sentence_ends)])
    begin, count = bounds[:-1], np.diff(bounds)
    out = np.empty(len(plain), np.int64)
    out[count == 1] = items[begin[count == 1]]
    bulk = (count > 1) & (count <= _BULK)
    use = np.flatnonzero(bulk)
    at = _stretches(begin[use], count[use])
    repeats = _repeating(items[at], np.concatenate([[0], np.cumsum(count[use])])[:-1], count[use])
    bulk[use[repeats]] = False
    use = use[~repeats]
    tiers = np.array(store.tier, np.int32)[items]
    tops = np.maximum.reduceat(tiers, begin)[use] + 1 if len(use) else np.zeros(0, np.int32)
    out[use] = _bulk(store, items, begin[use], count[use], np.minimum(255, tops))
    for k in np.flatnonzero((count > 1) & ~bulk).tolist():
        out[k] = store.made(items[begin[k] : begin[k] + count[k]].tolist())
    return out


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the stretches, one after another."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(starts, sizes)


def realize(node: int, store: Composer) -> str:
    """The text of a tree, without recursion."""
    out, stack = [], [node]
    while stack:
        part = store.parts[stack.pop()]
        if isinstance(part, str):
            out.append(part)
        else:
            stack.extend(reversed(part))
    return "".join(out)


def integer(value: int, store: Composer) -> int:
    """A whole number as a composition of its digits; a negative one as a sign and that."""
    digits = store.made([store.atom(c) for c in str(abs(value))])
    return digits if value >= 0 else store.compose((store.atom("-"), digits))
