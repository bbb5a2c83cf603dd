"""Exact top-k by inner product, block at a time.

Vectors stand in blocks of consecutive ids. A block knows each component's largest and smallest value, so the sum over
components of the larger of query * largest and query * smallest bounds every score in it. A query takes the blocks by
falling bounds, scores all vectors of a block from its forward index, the matrix, and stops at the first block whose
bound is below its k-th score.

Blocks are dealt to lanes. Each query first searches the lane with the highest bound; its k-th score there goes with it to the
other lanes, and only to those whose bound reaches it, where search goes on from that score. The table stays where its
lanes are: queries travel to them, in packs, and are worked on as they come. A query's best of all lanes are then ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserae.llm.common import cut, table

SCALE = 1024
BLOCK = 1024
#: Vectors to a lane, about: the least, as long as there are no more than LANES lanes, and the most, which a task holds at a time.
LANE, LANES, WIDEST = 8192, 4096, 131072
#: Queries of a pack, and queries to a lane for which it is copied once.
PACK, QUERIES = 256, 1 << 20

_PACKED = T.StructType(
    [T.StructField("dim", T.IntegerType()), T.StructField("part", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("ids", "rows", "matrix")]
)


def _pack(size: int):
    """Rows (dim, id, row, vector), sorted by dim and id, to packed blocks of `size`."""

    def run(batches):
        held, part = [], 0

        def out(rows):
            nonlocal part
            part += 1
            matrix = np.stack([r[2] for r in rows])
            cell = lambda x: pa.array([x.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([matrix.shape[1]], pa.int32()), pa.array([part], pa.int64()), cell(np.array([r[0] for r in rows], np.int64)), cell(np.array([r[1] for r in rows], np.int64)), cell(matrix)],
                names=[f.name for f in _PACKED],
            )

        for batch in batches:
            vectors = batch.column(2)
            for i, (name, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                whole = vectors[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                if held and len(held[-1][2]) != len(whole):
                    yield out(held)
                    held = []
                held.append((name, row, whole))
                if len(held) == size:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return run


class Block:
    def __init__(self, ids: bytes, rows: bytes, matrix: bytes, dim: int):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.matrix = np.frombuffer(matrix, np.int64).reshape(-1, dim)
        self.high, self.low = self.matrix.max(axis=0), self.matrix.min(axis=0)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by way of doubles where those are exact."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if size < 2**53 else a @ b.T


def search(queries: Block, blocks: list[Block], k: int, floors: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query the ids and scores of its k best vectors, itself left out; and how many (query, block) were scored.

    `floors`: scores that k vectors elsewhere have; what is below needn't be found.
    """
    n, q = len(queries.ids), queries.matrix
    high, low = np.stack([b.high for b in blocks]), np.stack([b.low for b in blocks])
    bounds = _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ids, scores = [np.zeros(0, np.int64) for _ in range(n)], [np.zeros(0, np.int64) for _ in range(n)]
    live, scored = np.arange(n), 0
    for turn in range(len(blocks)):
        upcoming = bounds[live, order[live, turn]]
        kth = np.array([scores[i][k - 1] if len(scores[i]) >= k else np.iinfo(np.int64).min for i in live], np.int64)
        if floors is not None:
            kth = np.maximum(kth, floors[live])
        live = live[upcoming >= kth]  # an equal score may still have a smaller id
        if not len(live):
            break
        mine = order[live, turn]
        for at in np.unique(mine):
            some, block = live[mine == at], blocks[at]
            found = _product(q[some], block.matrix)
            scored += len(some)
            for i, values in zip(some.tolist(), found):
                other = block.rows != queries.rows[i]
                s, d = np.r_[scores[i], values[other]], np.r_[ids[i], block.ids[other]]
                if len(s) > k:
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    s, d = s[s >= edge], d[s >= edge]
                best = np.lexsort((d, -s))[:k]
                scores[i], ids[i] = s[best], d[best]
    return ids, scores, scored


_LEAST = np.iinfo(np.int64).min
_LISTS = ("query_id", "query_row", "vec_id", "score")
#: Packs of queries on their way to a lane (kind 1) and blocks in it (kind 0).
_SENT = T.StructType(
    [T.StructField("dim", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("lane", "copy")]
    + [T.StructField("kind", T.IntegerType())]
    + [T.StructField(c, T.BinaryType()) for c in ("ids", "rows", "matrix", "floors")]
)
#: Packs of queries after a lane: with the scores of their k-th best, and what they found.
_BACK = T.StructType([T.StructField("dim", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("ids", "rows", "matrix", "floors")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in _LISTS])


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _senders(lanes, copies: int, first: bool):
    """Packs of queries to the lane with the highest bound; or, if not `first`, to all others whose bound reaches their k-th score."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                names, high, low = lanes.value[dim]
                ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
                q = np.frombuffer(row["matrix"], np.int64).reshape(-1, dim)
                bounds = _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)
                home = bounds.argmax(axis=1)
                floors = np.full(len(ids), _LEAST) if first else np.frombuffer(row["floors"], np.int64)
                goes = np.zeros(bounds.shape, bool) if first else bounds >= floors[:, None]
                goes[np.arange(len(ids)), home] = first
                out = [(dim, names[lane], int(rows[0]) % copies, 1, *(x[use].tobytes() for x in (ids, rows, q, floors))) for lane in np.flatnonzero(goes.any(axis=0)) for use in [goes[:, lane]]]
                for i in range(0, len(out), 1024):
                    yield _batch(_SENT, out[i : i + 1024])

    return run


def _searchers(k: int):
    """Sorted by lane, blocks first: a lane's blocks are held, queries pass by."""

    def run(batches):
        key, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if key != (here := (r["dim"], r["lane"], r["copy"])):
                    key, held = here, []
                block = Block(r["ids"], r["rows"], r["matrix"], r["dim"])
                if r["kind"] == 0:
                    held.append(block)
                    continue
                floors = np.frombuffer(r["floors"], np.int64)
                ids, scores, _ = search(block, held, k, floors)
                kth = np.array([s[k - 1] if len(s) >= k else _LEAST for s in scores], np.int64)
                sizes = [len(x) for x in ids]
                lists = np.repeat(block.ids, sizes), np.repeat(block.rows, sizes), np.concatenate(ids), np.concatenate(scores)
                above = lists[3] >= np.repeat(floors, sizes)
                yield _batch(_BACK, [(r["dim"], r["ids"], r["rows"], r["matrix"], np.maximum(kth, floors).tobytes(), *(x[above] for x in lists))])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` names its k best other rows of equal length.

    Components become floor(scale * x), scores are whole inner products, ties go to the smaller id. Rows with a null id,
    a null or empty vector, or null or non-finite components take no part. Ids are whole numbers; other columns are not
    looked at. Rows with equal ids are different rows: each is asked for and found by itself. An empty table gives no
    rows. What each task gets of all lanes is their largest and smallest components: 1 KB for 131,072 vectors of 64.
    """
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & good)
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = cut(rows.select(F.col(vec_id).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), whole.alias("v"), is_query.alias("asked"), F.size(embedding).alias("dim")))
    n, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asked").cast("bigint")), F.lit(0))).first()

    def packed(some: DataFrame, size: int, count: int) -> DataFrame:
        width = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // size)))
        dealt = some.repartitionByRange(width, "dim", "id", "row").sortWithinPartitions("dim", "id", "row")
        return dealt.select("id", "row", "v").mapInArrow(_pack(size), _PACKED)

    count, copies = max(1, min(-(-n // LANE), max(LANES, -(-n // WIDEST)))), max(1, -(-asked // QUERIES))
    nothing = F.lit(None).cast("binary")
    blocks = cut(packed(rows, BLOCK, n).withColumn("lane", F.pmod(F.xxhash64("ids", "rows"), F.lit(count))))
    queries = packed(rows.where("asked"), PACK, asked).select("dim", "ids", "rows", "matrix", nothing.alias("floors"))

    def extremes(table: pa.Table) -> pa.Table:
        m = [Block(r["ids"], r["rows"], r["matrix"], r["dim"]) for r in table.to_pylist()]
        row = table["dim"][0].as_py(), table["lane"][0].as_py(), np.max([b.high for b in m], axis=0), np.min([b.low for b in m], axis=0)
        return pa.Table.from_batches([_batch(summary, [row])])

    summary = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("lane", T.LongType()), T.StructField("high", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType()))])
    known: dict[int, list] = {}
    for r in blocks.groupBy("dim", "lane").applyInArrow(extremes, summary).toLocalIterator():
        known.setdefault(r.dim, []).append((r.lane, r.high, r.low))
    lanes = df.sparkSession.sparkContext.broadcast({d: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for d, v in known.items()})
    laid = blocks.select("dim", "lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))).alias("copy"), F.lit(0).alias("kind"), "ids", "rows", "matrix", nothing.alias("floors"))

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        keys = ["dim", "lane", "copy"]
        both = laid.union(asking.mapInArrow(_senders(lanes, copies, first), _SENT)).repartition(*keys).sortWithinPartitions(*keys, "kind")
        return both.mapInArrow(_searchers(k), _BACK)

    near = cut(searched(queries, True))
    far = searched(near.select("dim", "ids", "rows", "matrix", "floors"), False)
    found = near.select(*_LISTS).union(far.select(*_LISTS)).select(F.explode(F.arrays_zip(*_LISTS)).alias("x")).select("x.*")
    ranked = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.w, v.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM q) WHERE rank <= 10
"""
