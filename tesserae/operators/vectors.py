"""Exact k-NN, row significance and dot products over packed blocks of vectors; small dense linear algebra."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.checkpoints import written

BLOCK = 1024
#: Blocks of queries whose nearest a task keeps at once.
HELD = 64


def dot_i8(a: Column, b: Column) -> Column:
    """Dot product of whole numbers, wrapped to 32 bits."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return (F.pmod(total + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def packed(df: DataFrame, ids: str, vector: str, extra: list[str] | None = None) -> DataFrame:
    """(block, ids, matrix, ...): BLOCK vectors of one length to a row, so that blocks and not single rows meet in joins."""
    extra = extra or []

    def run(batches):
        for pdf in batches:
            for dim, same in pdf.groupby(pdf[vector].map(len)):
                for at in range(0, len(same), BLOCK):
                    part = same.iloc[at : at + BLOCK]
                    matrix = np.array([np.asarray(v, np.float64) for v in part[vector]])
                    row = {"dim": [dim], "ids": [part[ids].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]}
                    yield pd.DataFrame(row | {c: [part[c].to_numpy(np.float64).tobytes()] for c in extra})

    schema = "dim int, ids binary, matrix binary" + "".join(f", {c} binary" for c in extra)
    return df.select(ids, vector, *extra).mapInPandas(run, schema)


def _pairs(queries: DataFrame, base: DataFrame) -> DataFrame:
    """Every block of queries with every block of base vectors: an equi-join on dealt lanes, never row by row."""
    lanes = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = queries.select(*(F.col(c).alias("q_" + c) for c in queries.columns)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = base.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    return left.join(right, "lane").where("q_dim = dim")


def _of(row, name: str, kind=np.float64) -> np.ndarray:
    return np.frombuffer(bytes(getattr(row, name)), kind)


def squared_distances(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed in order of dimensions, as the definition has it."""
    out = np.zeros((len(q), len(b)))
    for d in range(q.shape[1]):
        gap = q[:, d, None] - b[None, :, d]
        out += gap * gap
    return out


class Nearest:
    """The k nearest of all base blocks seen, for one block of queries: squared distances estimated by a matrix product, then made exact.

    With u = 2^-53, n dimensions and r = |q| + |b|, the product's estimate |q|^2 + |b|^2 - 2qb and the sum in order of dimensions
    are both within (n + 3) u r^2 or so of the true value, so they differ by less than 4 (n + 4) u r^2. Only pairs whose estimate could
    then be among the k least, of this block and of those before, are summed exactly; the rest can't be. Where an estimate
    isn't finite, all pairs of the block are.
    """

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.rows, self.found, self.d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: The k-th distance so far, and how many pairs were summed exactly.
        self.bound, self.rescored = np.full(len(queries), np.inf), 0

    def meet(self, base: np.ndarray, ids: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.einsum("ij,ij->i", base, base)
            estimate = self.norms[:, None] + norms - 2.0 * (self.queries @ base.T)
            off = 4.0 * (base.shape[1] + 4) * 2.0**-53 * (np.sqrt(self.norms) + np.sqrt(norms.max(initial=0.0))) ** 2
            least = np.partition(estimate, self.k - 1, axis=1)[:, self.k - 1] if self.k <= len(base) else np.full(len(self.queries), np.inf)
            close = estimate <= np.minimum(least + 2.0 * off, self.bound + off)[:, None]
        if not np.isfinite(estimate).all():
            close = np.ones(estimate.shape, bool)
        rows, columns = np.nonzero(close)
        exact = np.zeros(len(rows))
        with np.errstate(over="ignore", invalid="ignore"):
            for x, y in zip(np.ascontiguousarray(self.queries.T), np.ascontiguousarray(base.T)):
                gap = x[rows] - y[columns]
                exact += gap * gap
        self.rescored += len(rows)
        rows, found, d2 = np.r_[self.rows, rows], np.r_[self.found, ids[columns]], np.r_[self.d2, exact]
        order = np.lexsort((found, d2, rows))
        rows, found, d2 = rows[order], found[order], d2[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        full = place == self.k - 1
        self.bound[rows[full]] = np.where(np.isnan(d2[full]), np.inf, d2[full])
        self.rows, self.found, self.d2 = (x[place < self.k] for x in (rows, found, d2))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query": self.ids[self.rows], "id": self.found, "d2": self.d2})


def knn(queries: DataFrame, base: DataFrame, k: int, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, rank, id, d2): the k nearest base vectors by squared Euclidean distance, summed in order of dimensions, ties to the smaller id.

    A task keeps the k nearest so far of up to HELD blocks of queries, so that it gives k rows for a query and not for each block.
    """
    if k < 1:
        raise ValueError("k must be positive")

    def run(batches):
        standing: dict[bytes, Nearest] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                q, b = (_of(r, c).reshape(-1, r.dim) for c in ("q_matrix", "matrix"))
                name = bytes(r.q_ids) + bytes(r.q_matrix)
                if name not in standing and len(standing) == HELD:
                    yield standing.pop(next(iter(standing))).frame()
                block = standing.pop(name, None) or Nearest(q, _of(r, "q_ids", np.int64), k)
                block.meet(b, _of(r, "ids", np.int64))
                standing[name] = block  # the last used comes last
        for block in standing.values():
            yield block.frame()

    found = _pairs(packed(queries, ids, vector), packed(base, ids, vector)).mapInPandas(run, "query bigint, id bigint, d2 double")
    w = Window.partitionBy("query").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "d2")


def moments(base: DataFrame, vector: str = "embedding") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: how many there are, their sum, and the sum of their outer products.

    A task sums what it reads; then each line of the matrix is summed by itself, so nothing grows with the table but the number
    of lines shuffled: one for each task and dimension. What comes to the driver is a matrix, bounded by the dimension.
    """

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            by_dim: dict[int, list] = {}
            for v in batch.column(0).to_pylist():
                by_dim.setdefault(len(v), []).append(v)
            for dim, rows in by_dim.items():
                # a line of ones gives the sum and the count in the same product
                m = np.column_stack([np.ones(len(rows)), np.array(rows, np.float64).reshape(len(rows), dim)])
                sums[dim] = sums.get(dim, 0.0) + m.T @ m
        for dim, m in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(m), pa.int32()), "line": pa.array(range(len(m)), pa.int32()), "numbers": pa.array([x.tobytes() for x in m], pa.binary())})

    def merge(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, line, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                sums[dim, line] = sums.get((dim, line), 0.0) + np.frombuffer(numbers)
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"dim": pa.array([k[0] for k in keys], pa.int32()), "line": pa.array([k[1] for k in keys], pa.int32()), "numbers": pa.array([sums[k].tobytes() for k in keys], pa.binary())})

    schema = "dim int, line int, numbers binary"
    lines = base.where(F.col(vector).isNotNull()).select(vector).mapInArrow(partial, schema).repartition("dim", "line").mapInArrow(merge, schema)
    matrices: dict[int, dict[int, np.ndarray]] = {}
    for r in lines.collect():
        matrices.setdefault(r.dim, {})[r.line] = np.frombuffer(bytes(r.numbers))
    whole = {dim: np.stack([rows[k] for k in range(dim + 1)]) for dim, rows in matrices.items()}
    return {dim: (round(m[0, 0]), m[0, 1:], m[1:, 1:]) for dim, m in whole.items()}


def row_stats(queries: DataFrame, base: DataFrame, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vector, n, mean, sd) of each row's dot products with all candidates of its length; a spread of 0 is 1e-12.

    The mean and the mean square of q.b over all b are q's products with b's moments, so no pair is scored for them.
    """
    known = moments(base, vector)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                n, total, square = known.get(len(v), (0, None, None))
                if not n:
                    out.append((0, None, None))
                    continue
                q = np.array(v, np.float64)
                mean = float(q @ total) / n
                sd = max(float(q @ square @ q) / n - mean * mean, 0.0) ** 0.5
                out.append((n, mean, sd if sd > 0 else 1e-12))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["row", "vector", "n", "mean", "sd"])

    rows = queries.where(F.col(vector).isNotNull()).select(F.col(ids).cast("bigint").alias("row"), F.col(vector).alias("vector"))
    return rows.mapInArrow(run, f"row bigint, vector {rows.schema['vector'].dataType.simpleString()}, n bigint, mean double, sd double")


def _hits(stats: DataFrame, base: DataFrame, zmin: float, cap: int, ids: str, vector: str) -> DataFrame:
    """(row, id, score, z, above, above4, above5): a block's `cap` best hits of each row; the first carries the block's counts, the rest 0."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                s = _of(r, "q_matrix").reshape(-1, r.dim) @ _of(r, "matrix").reshape(-1, r.dim).T
                mean, sd, own, rows = _of(r, "q_mean"), _of(r, "q_sd"), _of(r, "ids", np.int64), _of(r, "q_ids", np.int64)
                i, j = np.nonzero(s > (mean + zmin * sd)[:, None])
                order = np.lexsort((own[j], -s[i, j], i))
                i, j = i[order], j[order]
                score = s[i, j]
                first = np.searchsorted(i, i)  # where a row's hits begin
                counts = {"above": np.ones(len(i)), "above4": score > (mean + 4 * sd)[i], "above5": score > (mean + 5 * sd)[i]}
                counts = {c: np.where(first == np.arange(len(i)), np.bincount(i, x, len(rows))[i], 0).astype(np.int64) for c, x in counts.items()}
                keep = np.arange(len(i)) - first < cap
                out = {"row": rows[i], "id": own[j], "score": score, "z": (score - mean[i]) / sd[i], **counts}
                yield pd.DataFrame({c: x[keep] for c, x in out.items()})

    pairs = _pairs(packed(stats.where("n > 0"), "row", "vector", ["mean", "sd"]), packed(base.where(F.col(vector).isNotNull()), ids, vector))
    return pairs.mapInPandas(run, "row bigint, id bigint, score double, z double, above bigint, above4 bigint, above5 bigint")


def _best(hits: DataFrame, cap: int) -> DataFrame:
    w = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("row", "rank", "id", "score", "z")


def rowsig(queries: DataFrame, base: DataFrame, zmin: float = 3.0, cap: int = 8, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, rank, id, score, z): each row's candidates above mean + zmin * sd, the `cap` highest, ties to the smaller id.

    Every pair is scored once. Null vectors take no part; a row without hits has no row here, but has one in signatures().
    """
    return _best(_hits(row_stats(queries, base, ids, vector), base, zmin, cap, ids, vector), cap)


def signatures(queries: DataFrame, base: DataFrame, zmin: float = 3.0, cap: int = 8, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, n, mean, sd, above, above4, above5, hits): a row for each query, also for those that nothing stands out from.

    above counts the candidates above mean + zmin * sd, above4 and above5 those of them above 4 and 5 spreads, all of them,
    however many `hits` holds: array<struct<rank, id, score, z>>, the `cap` highest in order. No candidates: n is 0, the rest
    null or 0. Ids of queries must be unique.
    """
    stats = row_stats(queries, base, ids, vector)
    hits = written(_hits(stats, base, zmin, cap, ids, vector))
    counts = hits.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("above", "above4", "above5")))
    best = _best(hits, cap).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "z"))).alias("hits"))
    out = stats.drop("vector").join(counts.join(best, "row"), "row", "left")
    none = F.array().cast("array<struct<rank:int,id:bigint,score:double,z:double>>")
    return out.select("row", "n", "mean", "sd", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("above", "above4", "above5")), F.coalesce("hits", none).alias("hits"))


def canonical_sign(v: np.ndarray) -> np.ndarray:
    """Columns flipped so that the first non-zero entry of each is positive."""
    lead = np.array([next((x for x in c if abs(x) > 1e-12), 1.0) for c in v.T])
    return v * np.sign(lead)


def eigenmap(weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Laplacian eigenmap: the k smallest non-trivial eigenvalues of the normalised Laplacian and scaled coordinates."""
    w = np.maximum(weights, 0.0)
    w = (w + w.T) / 2.0
    degree = w.sum(axis=1)
    scale = np.where(degree > 0, 1.0 / np.sqrt(np.where(degree > 0, degree, 1.0)), 0.0)
    values, vectors = np.linalg.eigh(np.eye(len(w)) - scale[:, None] * w * scale[None, :])
    return values[1 : k + 1], canonical_sign(scale[:, None] * vectors[:, 1 : k + 1])


def procrustes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The rotation (determinant 1) and scale that take a nearest to b."""
    u, s, vt = np.linalg.svd(a.T @ b)
    flip = np.ones(len(s))
    flip[-1] = np.sign(np.linalg.det(u @ vt))
    return u @ np.diag(flip) @ vt, float((s * flip).sum() / (a * a).sum())


def orthonormal_rows(a: np.ndarray) -> np.ndarray | None:
    """Orthonormal rows that span a's in order, each with a positive share of its own row; null if they depend."""
    q, r = np.linalg.qr(a.T)
    d = np.diag(r)
    if (np.abs(d) <= 1e-12 * max(1.0, np.abs(d).max(initial=0))).any():
        return None
    return (q * np.sign(d)).T
