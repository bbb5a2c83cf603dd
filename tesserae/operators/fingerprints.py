"""BLAKE3-256 of artifacts that lie in parts: every task hashes the bytes it holds, and the tree's nodes are merged after that.

A chunk of 1,024 bytes has one place in BLAKE3's tree, whatever task reads it. So a task needs to know only at which byte of its
artifact it begins. It folds its whole chunks into the few aligned subtrees that cover them; chunks that it holds in part go on
as bytes. Subtrees then meet by gigabytes of the artifact, and last of all by artifact. The digest is the published one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tesserae.functions.identity import CHUNK, blake3_chunks, blake3_parents
from tesserae.operators.checkpoints import written

#: Bytes that a task hashes together.
TOGETHER = 1 << 22
#: Chunks whose subtrees meet in one group: 2^20 chunks are a gigabyte.
REACH = 20
#: The digest of no bytes. (Fixed value.)
NOTHING = "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
#: A node: the chunk and the byte in it where it begins, its level (null: bytes of a chunk not yet hashed), its value or bytes.
NODE = "chunk bigint, start int, level int, value binary"


class _Tree:
    """Nodes of one artifact from left to right: subtrees that lie side by side are merged, the last chunk is held back.

    Only the end of the artifact tells if its last chunk is whole and if a merge is the root, so the last one is never hashed here.
    """

    def __init__(self):
        self.nodes: list[tuple[int, int, bytes]] = []  # (chunk, level, value)
        self.edges: list[tuple[int, int, bytes]] = []  # (chunk, start, bytes) of chunks whose start another task holds
        self.data, self.at = bytearray(), 0  # bytes not yet hashed, and where in the artifact they begin

    def add(self, at: int, data: bytes) -> None:
        """Bytes that begin at byte `at`, which follows what came before."""
        if not self.data:
            self.at = at
        self.data += data
        if len(self.data) > TOGETHER:
            self._hash()

    def _hash(self) -> None:
        """Whole chunks become nodes, but for the last bytes; what belongs to a chunk that began elsewhere becomes an edge."""
        skip = min(-self.at % CHUNK, len(self.data))
        if skip:
            self.edges.append((self.at // CHUNK, self.at % CHUNK, bytes(self.data[:skip])))
        n = max(len(self.data) - skip - 1, 0) // CHUNK
        if n:
            first, view = (self.at + skip) // CHUNK, bytes(self.data[skip : skip + n * CHUNK])
            self.put(first, 0, blake3_chunks([view[i : i + CHUNK] for i in range(0, len(view), CHUNK)], np.arange(first, first + n)))
        self.at += skip + n * CHUNK
        del self.data[: skip + n * CHUNK]

    def put(self, chunk: int, level: int, values: list[bytes]) -> None:
        """Subtrees of one level side by side, the first at `chunk`: merged among themselves as far as they go, then with those before."""
        width = 1 << level
        if len(values) > 1 and chunk & width:
            self._push(chunk, level, values[0])
            chunk, values = chunk + width, values[1:]
        if len(values) > 1:
            even = len(values) & ~1
            self.put(chunk, level + 1, blake3_parents(values[:even:2], values[1:even:2]))
            chunk, values = chunk + even * width, values[even:]
        for value in values:
            self._push(chunk, level, value)

    def _push(self, chunk: int, level: int, value: bytes) -> None:
        while self.nodes and self.nodes[-1][1] == level and chunk >> level & 1 and self.nodes[-1][0] == chunk - (1 << level):
            chunk, level, value = chunk - (1 << level), level + 1, blake3_parents([self.nodes.pop()[2]], [value])[0]
        self.nodes.append((chunk, level, value))

    def meet(self, chunk: int, start: int, level: int | None, value: bytes) -> None:
        """A node or bytes from another task, in order of (chunk, start)."""
        if level is None:
            self.add(chunk * CHUNK + start, value)
            return
        self._complete()
        self._push(chunk, level, value)

    def _complete(self) -> None:
        """Something follows the bytes held: they are a whole chunk, or an edge."""
        if not self.data:
            return
        if self.at % CHUNK == 0 and len(self.data) == CHUNK:
            self._push(self.at // CHUNK, 0, blake3_chunks([bytes(self.data)], np.array([self.at // CHUNK]))[0])
            self.data.clear()
        else:
            self._hash()
            if self.data:
                self.edges.append((self.at // CHUNK, self.at % CHUNK, bytes(self.data)))
                self.data.clear()

    def rows(self) -> Iterator[tuple[int, int, int | None, bytes]]:
        """What goes on to where the tree's other parts are."""
        self._hash()
        last = [(self.at // CHUNK, self.at % CHUNK, bytes(self.data))] if self.data else []
        yield from ((chunk, 0, level, value) for chunk, level, value in self.nodes)
        yield from ((chunk, start, None, value) for chunk, start, value in self.edges + last)

    def digest(self) -> bytes:
        """The root: all parts have met, from the first byte on."""
        self._hash()
        number, root = np.array([self.at // CHUNK]), not self.nodes
        value = blake3_chunks([bytes(self.data)], number, root)[0]
        for i, (_, _, left) in enumerate(reversed(self.nodes)):
            value = blake3_parents([left], [value], i == len(self.nodes) - 1)[0]
        return value


def _rows(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def _finished(rows, group, take, finish) -> Iterator[list[tuple]]:
    """Sorted rows, each with its artifact's key first, as lists of (key, ...): take(tree, row) for each row, finish(tree) where group(row) changes."""
    tree, now, key, out = None, None, None, []
    for row in rows:
        here = group(row)
        if tree is None or here != now:
            if tree is not None:
                out += [(key, *x) for x in finish(tree)]
            tree, now, key = _Tree(), here, row[0]
        take(tree, row)
        if len(out) > 10_000:
            yield out
            out = []
    if tree is not None:
        out += [(key, *x) for x in finish(tree)]
    yield out


def fingerprints(parts: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, n_bytes, digest): the lower-case hex of BLAKE3-256 of each artifact, its parts' bytes one after the other in `order`.

    `data` is binary or a string (its UTF-8 bytes). Parts of one `order` are taken in the order of their bytes, those of null order first.
    Null data are no bytes; null is an artifact's key like any other; an artifact without bytes has the digest of none. How parts are dealt
    or cut does not matter. A task holds some megabytes, however large an artifact or a part's neighbours are.
    """
    kind = parts.schema[key].dataType
    arrow, named = to_arrow_type(kind), f"_key {kind.simpleString()}"
    fields = [pa.field("chunk", pa.int64()), pa.field("start", pa.int32()), pa.field("level", pa.int32()), pa.field("value", pa.binary())]

    def table(out, end):
        schema = pa.schema([pa.field("_key", arrow), *end])
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def offsets(batches):
        """Where each part begins, counted from the first one of its artifact in this partition."""
        now, at = None, 0
        for batch in batches:
            starts = []
            for k, size in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_key", "_size"))):
                now, at = (k,), at if now == (k,) else 0
                starts.append(at)
                at += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=[*batch.schema.names, "_at"])

    def leaves(batches):
        def known():
            # what doesn't follow the row before it, as files are cut, starts a tree of its own
            end, run = None, 0
            for k, at, piece in _rows(batches, ["_key", "_at", "_data"]):
                run += (k, at) != end
                end = (k, at + len(piece))
                yield k, run, at, piece

        for out in _finished(known(), lambda r: r[1], lambda tree, r: tree.add(*r[2:]), _Tree.rows):
            yield table(out, fields)

    def merged(batches):
        for out in _finished(_rows(batches, ["_key", "_reach", "chunk", "start", "level", "value"]), lambda r: r[:2], lambda tree, r: tree.meet(*r[2:]), _Tree.rows):
            yield table(out, fields)

    def roots(batches):
        for out in _finished(_rows(batches, ["_key", "chunk", "start", "level", "value"]), lambda r: r[:1], lambda tree, r: tree.meet(*r[1:]), lambda tree: [(tree.digest().hex(),)]):
            yield table(out, [pa.field("digest", pa.string())])

    rows = parts.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("_data"))
    dealt = rows.repartitionByRange("_key", "_order").sortWithinPartitions("_key", "_order", "_data")
    sized = dealt.select("_key", F.spark_partition_id().alias("_part"), F.octet_length("_data").cast("bigint").alias("_size"), "_data")
    laid = written(sized.mapInArrow(offsets, f"{named}, _part int, _size bigint, _data binary, _at bigint"))
    sizes = laid.groupBy("_key", "_part").agg(F.sum("_size").alias("_bytes"))
    totals = sizes.groupBy("_key").agg(F.sum("_bytes").alias("n_bytes"))
    # only the first artifact of a partition can have begun before it: one row for each partition
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("_from", F.sum("_bytes").over(before)).where("_from is not null").select("_part", F.col("_key").alias("_begun"), "_from")
    placed = laid.join(F.broadcast(begun), (laid["_part"] == begun["_part"]) & F.col("_key").eqNullSafe(F.col("_begun")), "left")
    placed = placed.select("_key", (F.col("_at") + F.coalesce("_from", F.lit(0))).alias("_at"), "_data")
    nodes = placed.mapInArrow(leaves, f"{named}, {NODE}").withColumn("_reach", F.shiftright("chunk", REACH))
    nodes = nodes.repartition("_key", "_reach").sortWithinPartitions("_key", "_reach", "chunk", "start").mapInArrow(merged, f"{named}, {NODE}")
    found = nodes.repartition("_key").sortWithinPartitions("_key", "chunk", "start").mapInArrow(roots, f"{named}, digest string").withColumnRenamed("_key", "_found")
    out = totals.join(found, F.col("_key").eqNullSafe(F.col("_found")), "left")
    return out.select(F.col("_key").alias(key), "n_bytes", F.coalesce("digest", F.lit(NOTHING)).alias("digest"))
