"""Edit-aware token counts: a segment tree over the pre-tokens of each document, updated where an edit touches it.

The pre-token rule reads left to right and never looks back, so it may be taken up again at any boundary. How it got to
a boundary depends on at most two characters behind it (white space gives back its last character, a contraction looks
at three from its start). An edit therefore concerns the pre-tokens it overlaps, those just before it that could see
it, and those after it until a boundary of the new text falls on one of the old text; from there on both are equal.

Trees are a column: plant() encodes each text once and makes them, apply() brings edits to stored trees and gives back the trees
as they are then, for the next edits. A stored tree is its text, the lengths and token counts of its pre-tokens, and how many of
these and how many tokens each leaf has; sums are added up from that, and leaves are cut out of the text when an edit comes to them. An edit encodes
the pre-tokens that it made anew and no others: those beside them keep their counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import bpe
from tesserae.llm.bpe_codec import TOKENIZER, _each_batch
from tesserae.llm.common import stored, table, whole_text

LEAF = 64
#: How many characters behind its end can change what a pre-token is.
SIGHT = 3

EDIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("remove", T.IntegerType()), T.StructField("insert", T.StringType())])
#: A stored tree. `lengths` and `counts` have a byte for each pre-token, its characters and its tokens; 255 stands for larger numbers,
#: which are in `long` and `many` in their order. `sizes` and `tokens` have the pre-tokens and the tokens of each leaf.
_LARGE = T.ArrayType(T.IntegerType())
TREE = T.StructType().add("text", T.StringType()).add("lengths", T.BinaryType()).add("long", _LARGE).add("counts", T.BinaryType()).add("many", _LARGE).add("sizes", _LARGE).add("tokens", _LARGE)


class _Leaves:
    """The leaves of a tree: lists of pre-tokens and of their token counts, cut out of the text when they are asked for."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, sizes: Sequence[int]):
        self.base, self.lengths, self.counts, self.own = text, lengths, counts, [None] * len(sizes)
        self.first = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        self.at = np.r_[0, np.cumsum(lengths, dtype=np.int64)]

    def __len__(self) -> int:
        return len(self.own)

    def __getitem__(self, i: int) -> tuple[list[str], list[int]]:
        if self.own[i] is None:
            a, b = self.first[i], self.first[i + 1]
            ends = self.at[a : b + 1].tolist()
            self.own[i] = [self.base[x:y] for x, y in zip(ends, ends[1:])], self.counts[a:b].tolist()
        return self.own[i]

    def __setitem__(self, i: int, leaf: tuple[list[str], list[int]]) -> None:
        self.own[i] = leaf

    def __iter__(self):
        """The pre-tokens of each leaf."""
        return (self[i][0] for i in range(len(self)))

    def sizes(self) -> list[int]:
        return [n if own is None else len(own[0]) for own, n in zip(self.own, np.diff(self.first).tolist())]

    def chars(self) -> list[int]:
        return np.diff(self.at[self.first]).tolist()

    def tokens(self) -> list[int]:
        return np.diff(np.r_[0, np.cumsum(self.counts, dtype=np.int64)][self.first]).tolist()

    def whole(self) -> tuple[str, np.ndarray, np.ndarray]:
        """(text, lengths, counts) of all leaves, without cutting those that nobody asked for."""
        texts, lengths, counts = [], [], []
        start = 0
        for i in [*(i for i, own in enumerate(self.own) if own is not None), len(self)]:
            a, b = self.first[start], self.first[i]
            texts.append(self.base[self.at[a] : self.at[b]])
            lengths.append(self.lengths[a:b])
            counts.append(self.counts[a:b])
            if i < len(self):
                pieces, known = self.own[i]
                texts.append("".join(pieces))
                lengths.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
                counts.append(np.array(known, np.int64))
            start = i + 1
        return "".join(texts), np.concatenate(lengths), np.concatenate(counts)


def _bytes_of(numbers: np.ndarray) -> tuple[bytes, list[int]]:
    """A byte for each number, 255 for those from 255 on, and these in their order."""
    return np.minimum(numbers, 255).astype(np.uint8).tobytes(), numbers[numbers >= 255].tolist()


def _of_bytes(data: bytes | None, large: list[int] | None) -> np.ndarray:
    numbers = np.frombuffer(data or b"", np.uint8).astype(np.int64)
    numbers[numbers == 255] = large or []
    return numbers


class TokenTree:
    """The pre-tokens of a text in leaves of about LEAF, each with its token count, and a binary tree of (characters, tokens) sums above them."""

    def __init__(self, text: str | list[str], encoder: bpe.Encoder):
        """text: whole, or as its pre-tokens."""
        self.kept, self.encoded = encoder.pretoken, 0
        pieces = self._pieces(text) if isinstance(text, str) else text
        lengths, counts = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(self._counts(pieces), np.int64)
        sizes = [min(LEAF, len(pieces) - i) for i in range(0, len(pieces), LEAF)] or [0]
        self.leaves = _Leaves("".join(pieces), lengths, counts, sizes)
        self._sum(self.leaves.chars(), self.leaves.tokens())
        self.encoded = 0  # counts what edits encode, not the first pass

    @classmethod
    def restored(cls, state: dict, encoder: bpe.Encoder) -> "TokenTree":
        """A stored tree, ready for edits; nothing is encoded or cut."""
        tree = cls.__new__(cls)
        tree.kept, tree.encoded = encoder.pretoken, 0
        lengths, counts = _of_bytes(state["lengths"], state["long"]), _of_bytes(state["counts"], state["many"])
        tree.leaves = _Leaves(state["text"] or "", lengths, counts, state["sizes"] or [0])
        tree._sum(tree.leaves.chars(), state["tokens"] or [0])
        return tree

    def state(self) -> tuple:
        """The tree as TREE stores it."""
        text, lengths, counts = self.leaves.whole()
        return text, *_bytes_of(lengths), *_bytes_of(counts), self.leaves.sizes(), self.tokens[self.width : self.width + len(self.leaves)]

    def _sum(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << (len(chars) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(chars)], self.tokens[self.width : self.width + len(chars)] = chars, tokens
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _pieces(self, text: str) -> list[str]:
        return bpe.PRETOKEN.findall(text)

    def _counts(self, pieces: Sequence[str]) -> list[int]:
        """How many tokens each is: the only place that encodes."""
        self.encoded += len(pieces)
        return [len(ids) // 4 for ids in map(self.kept.__getitem__, pieces)]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(self.leaves.sizes())

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = pieces, counts
        i = self.width + leaf
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(counts)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf with this character, and the offset of the leaf's first one."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if char - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.width, len(self.leaves) - 1), before

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace `remove` characters at `at` by `insert`; places beyond the text count as its end."""
        at = min(max(at, 0), self.n_chars)
        remove = min(max(remove, 0), self.n_chars - at)
        first, start = self._find(max(at - 1, 0))
        # to the left: pre-tokens that can see the edit, and a place that surely is a boundary before them
        while True:
            (pieces, known), pos, keep, edge = self.leaves[first], start, 0, start
            for n, piece in enumerate(pieces):
                if max(pos + len(piece) + SIGHT, pos + SIGHT) > at:
                    break
                pos += len(piece)
                keep, edge = n + 1, pos
            if edge > start or start == 0:
                break
            first -= 1
            while first > 0 and not self.leaves[first][0]:
                first -= 1
            start -= self.chars[self.width + first]
        head, counts = pieces[:keep], known[:keep]
        # to the right: leaf by leaf, until a new boundary falls on an old one behind the edit
        last, old, stays, drop = first, pieces[keep:], known[keep:], at - edge
        while True:
            seen = "".join(old)
            whole = last == len(self.leaves) - 1
            if len(seen) >= drop + remove + SIGHT or whole:
                new = seen[:drop] + insert + seen[drop + remove :]
                made, shift = self._pieces(new), len(insert) - remove
                if whole:
                    taken, fresh = len(old), made
                    break
                ends, total = {}, 0
                for n, piece in enumerate(old):
                    if total >= drop + remove:
                        ends[total + shift] = n
                    total += len(piece)
                pos, fresh, taken = 0, [], None
                for piece in made:
                    # a new boundary is certain only if what it depends on has been read
                    if pos >= drop + len(insert) and pos in ends and pos + SIGHT <= len(new):
                        taken = ends[pos]
                        break
                    fresh.append(piece)
                    pos += len(piece)
                if taken is not None:
                    break
            last += 1
            old, stays = old + self.leaves[last][0], stays + self.leaves[last][1]
        made = self._counts(fresh)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf][0]:
                self._set(leaf, [], [])
        self._set(first, head + fresh + old[taken:], counts + made + stays[taken:])
        if len(self.leaves[first][0]) > 8 * LEAF:
            self._split(first)

    def _split(self, leaf: int) -> None:
        """Make leaves of the usual size of one that has grown; nothing is encoded for it."""
        sizes = self.leaves.sizes()
        sizes[leaf : leaf + 1] = [min(LEAF, sizes[leaf] - i) for i in range(0, sizes[leaf], LEAF)]
        self.leaves = _Leaves(*self.leaves.whole(), sizes)
        self._sum(self.leaves.chars(), self.leaves.tokens())

    def text(self) -> str:
        return self.leaves.whole()[0]


def _tree_array(trees: list[TokenTree]) -> pa.Array:
    columns = zip(*(t.state() for t in trees)) if trees else [()] * 7
    large = pa.list_(pa.int32())
    types = [pa.string(), pa.binary(), large, pa.binary(), large, large, large]
    return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=TREE.fieldNames())


def plant(df: DataFrame, text: str = "text", out: str = "tree", tokenizer: str | None = None) -> DataFrame:
    """Add `out`: the tree of each text, to be stored. Null texts count as empty. Every row stays; a column of that name is replaced."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def work(texts):
        encoder = bpe.encoder(path)
        split = [bpe.PRETOKEN.findall(x or "") for x in texts.to_pylist()]
        encoder.learn_pieces(set().union(*split))
        return [_tree_array([TokenTree(pieces, encoder) for pieces in split])]

    return _each_batch(df, [(out, TREE)], [text], work)


def gathered(edits: DataFrame, key: str, order: str) -> DataFrame:
    """(key, edits) from a table of edits (key, order, at, remove, insert): each document's edits in their order, for apply()."""
    one = F.struct(F.col(order).alias("order"), *(F.col(c).cast(EDIT[c].dataType).alias(c) for c in EDIT.fieldNames()))
    return edits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*(x[c].alias(c) for c in EDIT.fieldNames()))).alias("edits"))


def apply(df: DataFrame, edits: str = "edits", tree: str = "tree", tokenizer: str | None = None) -> DataFrame:
    """Bring `edits`, an array of (at, remove, insert) in order, to stored trees; `tree` is then the tree after them.

    Adds tokens_before, tokens_after, n_pretokens (after) and n_reencoded (pre-tokens given to the encoder, all that is encoded here). A
    null tree is that of an empty text, null edits or null members change nothing, places outside the text are moved to
    its end. Rows are independent: repeated rows give repeated results, no rows none. Columns of the new names are replaced.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    columns = [("tokens_before", T.LongType()), ("tokens_after", T.LongType()), ("n_pretokens", T.LongType()), ("n_reencoded", T.LongType()), (tree, TREE)]

    def work(states, changes):
        encoder, out, trees = bpe.encoder(path), [], []
        for state, wanted in zip(states, changes.to_pylist()):
            made = TokenTree.restored(dict.fromkeys(TREE.fieldNames()) if not state.is_valid else state.as_py(), encoder)
            before = made.n_tokens
            for c in wanted or ():
                if c is not None:
                    made.edit(c["at"] or 0, c["remove"] or 0, c["insert"] or "")
            trees.append(made)
            out.append((before, made.n_tokens, made.n_pretokens, made.encoded))
        return [*(pa.array([x[i] for x in out], pa.int64()) for i in range(4)), _tree_array(trees)]

    return _each_batch(df, columns, [tree, edits], work)


def count_with_edits(df: DataFrame, edits: str = "edits", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """plant() and apply() one after the other: the counts of apply(), and edited (the text after the edits).

    Special tokens' strings are ordinary text here. Null, repeated and empty rows and clashing names as for these.
    """
    done = apply(plant(df, text, "tree", tokenizer), edits, "tree", tokenizer)
    return done.withColumn("edited", F.col("tree.text")).drop("tree")


def revision(n: Column) -> Column:
    """The edits that the query makes in a text of n characters: a sentence put in at a third, forty characters taken out at the middle, a word changed near the end."""

    def one(at: Column, remove: Column | int, insert: str) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(remove).cast("int").alias("remove"), F.lit(insert).alias("insert"))

    return F.array(one(n / 3, 0, " It's revised: see note 12."), one(n / 2, 40, ""), one(n - 9, 5, "edited"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, stored; then the edits of revision() brought to the stored trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text("text").alias("text"))
    trees = stored(plant(docs).drop("text"))
    counted = apply(trees.withColumn("edits", revision(F.length("tree.text"))))
    return counted.select("doc_id", F.length("tree.text").cast("bigint").alias("n_chars"), "tokens_before", "tokens_after", "n_pretokens", "n_reencoded")
