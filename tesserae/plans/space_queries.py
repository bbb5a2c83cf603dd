"""Queries over coordinates, shapes, directions and vectors, from the embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tesserae.functions import coords as C
from tesserae.functions import shapes, sphere
from tesserae.operators import directions as D
from tesserae.operators import vectors as V
from tesserae.plans.catalogue import register
from tesserae.sources.tables import table, trajectories

_M = "CAST(trunc(greatest(-1.0, least(1.0, CAST(embedding[{i}] AS DOUBLE))) * 9007199254740992) AS BIGINT)"
_COORDS = "SELECT vec_id, label, " + ", ".join(f"{_M.format(i=d + 1)} AS m{d}" for d in range(4)) + " FROM embeddings"
_GRID = ", ".join(f"CAST(least(65535, (m{d} + 9007199254740992) >> 38) AS INT) AS g{d}" for d in range(4))


def _coords(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(C.truncated(F.col("embedding")[d]).alias(f"m{d}") for d in range(4)))


def _keyed(spark, sf_dir):
    c = _coords(spark, sf_dir)
    gridded = c.withColumns({f"g{d}": C.grid(F.col(f"m{d}")) for d in range(4)})
    return gridded.withColumn("hkey", C.hilbert_key("g0", "g1", "g2", "g3"))


_SUM = "CAST(sum(m{d}) AS HUGEINT)"


@register("coord_mean", f"WITH c AS ({_COORDS}) SELECT label, " + ", ".join(f"CAST(sign({_SUM.format(d=d)}) * (abs({_SUM.format(d=d)}) // count(*)) AS BIGINT) AS m{d}" for d in range(4)) + " FROM c GROUP BY label")
def coord_mean(spark, sf_dir):
    return _coords(spark, sf_dir).groupBy("label").agg(*(C.mean(F.col(f"m{d}")).alias(f"m{d}") for d in range(4)))


@register("coord_inside", f"WITH c AS ({_COORDS}) SELECT vec_id, m0, CAST(m0 AS DOUBLE) / 9007199254740992 AS x0, " + " + ".join(f"CAST(3 * m{d} AS HUGEINT) * (3 * m{d})" for d in range(4)) + " <= CAST(9007199254740992 AS HUGEINT) * 9007199254740992 AND greatest(abs(m0), abs(m1), abs(m2), abs(m3)) * 3 <= 9007199254740992 AS inside FROM c")
def coord_inside(spark, sf_dir):
    wide = _coords(spark, sf_dir)
    return wide.select("vec_id", "m0", C.as_double(F.col("m0")).alias("x0"), C.inside([3 * F.col(f"m{d}") for d in range(4)]).alias("inside"))


@register("hilbert_grid", f"WITH c AS ({_COORDS}) SELECT vec_id, {_GRID}, true AS returns FROM c")
def hilbert_grid(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    back = C.hilbert_grid(F.col("hkey"))
    return k.select("vec_id", "g0", "g1", "g2", "g3", (back == F.array("g0", "g1", "g2", "g3")).alias("returns"))


@register("hilbert_axis", "SELECT vec_id, CAST(CASE WHEN NOT (x > -1) THEN 0 WHEN x >= 1 THEN 65535 ELSE 32768 + floor(x * 32768) END AS INT) AS g FROM (SELECT vec_id, CAST(embedding[5] AS DOUBLE) * 4 AS x FROM embeddings)")
def hilbert_axis(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", C.grid_of(F.col("embedding")[4].cast("double") * 4).alias("g"))


BOX = ([30000, 28000, 30000, 26000], [36000, 40000, 34000, 39000])


@register("hilbert_box", f"WITH c AS ({_COORDS}), g AS (SELECT vec_id, {_GRID} FROM c) SELECT vec_id FROM g WHERE " + " AND ".join(f"g{d} BETWEEN {BOX[0][d]} AND {BOX[1][d]}" for d in range(4)))
def hilbert_box(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    exact = F.lit(True)
    for d in range(4):
        exact = exact & F.col(f"g{d}").between(BOX[0][d], BOX[1][d])
    return k.where(C.in_ranges(F.col("hkey"), C.box_ranges(*BOX))).where(exact).select("vec_id")


BALL = ([0.05, -0.02, 0.0, 0.1], 0.2)


@register("hilbert_ball", f"WITH c AS ({_COORDS}) SELECT vec_id FROM c WHERE sqrt(" + " + ".join(f"(m{d} / 9007199254740992.0 - ({BALL[0][d]})) * (m{d} / 9007199254740992.0 - ({BALL[0][d]}))" for d in range(4)) + f") <= {BALL[1]}")
def hilbert_ball(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    near = sphere.distance([C.as_double(F.col(f"m{d}")) for d in range(4)], [F.lit(x) for x in BALL[0]]) <= BALL[1]
    return k.where(C.in_ranges(F.col("hkey"), C.ball_ranges(*BALL))).where(near).select("vec_id")


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[d].cast("double").alias(f"a{d}") for d in range(4)), *(F.col("embedding")[4 + d].cast("double").alias(f"b{d}") for d in range(4)))


_AB = "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{d + 1}] AS DOUBLE) AS a{d}, CAST(embedding[{d + 5}] AS DOUBLE) AS b{d}" for d in range(4)) + " FROM embeddings"
_NA, _NB = ("sqrt(" + " + ".join(f"{x}{d} * {x}{d}" for d in range(4)) + ")" for x in "ab")
_CHORD = "sqrt(" + " + ".join(f"(a{d} / na - b{d} / nb) * (a{d} / na - b{d} / nb)" for d in range(4)) + ")"


@register("distance4", f"WITH p AS ({_AB}) SELECT vec_id, round(sqrt(" + " + ".join(f"(a{d} - b{d}) * (a{d} - b{d})" for d in range(4)) + "), 9) AS dist FROM p")
def distance4(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("vec_id", F.round(sphere.distance([p[f"a{d}"] for d in range(4)], [p[f"b{d}"] for d in range(4)]), 9).alias("dist"))


@register("angle4", f"WITH p AS (SELECT *, {_NA} AS na, {_NB} AS nb FROM ({_AB})) SELECT vec_id, round(2 * asin(least(1.0, {_CHORD} / 2)), 9) AS angle FROM p")
def angle4(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("vec_id", F.round(sphere.angle([p[f"a{d}"] for d in range(4)], [p[f"b{d}"] for d in range(4)]), 9).alias("angle"))


_DOT = " + ".join(f"a{d} / na * b{d} / nb" for d in range(4))


@register("sphere_maps", f"WITH p AS (SELECT *, {_NA} AS na, {_NB} AS nb FROM ({_AB})), q AS (SELECT *, acos(greatest(-1.0, least(1.0, {_DOT}))) AS th FROM p) SELECT vec_id, " + ", ".join(f"round((b{d} / nb - cos(th) * a{d} / na) * th / sin(th), 6) AS t{d}, round(sin(0.7 * th) / sin(th) * a{d} / na + sin(0.3 * th) / sin(th) * b{d} / nb, 6) AS s{d}, round(b{d} / nb, 6) AS e{d}" for d in range(4)) + " FROM q")
def sphere_maps(spark, sf_dir):
    """log at one point of another, what exp makes of it, and the point three tenths along the arc."""
    p = _points(spark, sf_dir)
    u = p.select("vec_id", F.array(*sphere.unit([p[f"a{d}"] for d in range(4)])).alias("u"), F.array(*sphere.unit([p[f"b{d}"] for d in range(4)])).alias("v"))
    a, b = sphere.point(F.col("u")), sphere.point(F.col("v"))
    t = u.select("vec_id", "u", F.array(*sphere.log(a, b)).alias("t"), F.array(*sphere.slerp(a, b, F.lit(0.3))).alias("s"))
    e = t.select("vec_id", "t", "s", F.array(*sphere.exp(a, sphere.point(F.col("t")))).alias("e"))
    return e.select("vec_id", *(F.round(F.col(c)[d], 6).alias(f"{c}{d}") for d in range(4) for c in "tse"))


@register("direction_means", None)
def direction_means(spark, sf_dir):
    """Karcher mean and dominant direction of each label's points."""
    p, at = _points(spark, sf_dir), ["a0", "a1", "a2", "a3"]
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 9))
    axes = D.dominant_directions(p, "label", at).withColumnRenamed("label", "of")
    both = D.karcher_means(p, "label", at).join(axes, F.col("label").eqNullSafe(F.col("of")))
    return both.select("label", rounded("karcher").alias("karcher"), rounded("eigen").alias("eigen"))


def _pairs(spark, sf_dir):
    """Each trajectory with the next one's."""
    t = trajectories(spark, sf_dir)
    return t.select("vec_id", F.col("path").alias("a")).join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("path").alias("b")), "vec_id")


_TRAJ = """t AS (SELECT vec_id, i, CAST(embedding[4 * i + 1] AS DOUBLE) AS x, CAST(embedding[4 * i + 2] AS DOUBLE) AS y, CAST(embedding[4 * i + 3] AS DOUBLE) AS z, CAST(embedding[4 * i + 4] AS DOUBLE) AS m FROM embeddings, range(0, 16) r(i)),
d AS (SELECT a.vec_id, a.i, b.i AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) + (a.m - b.m) * (a.m - b.m)) AS gap FROM t a JOIN t b ON b.vec_id = a.vec_id + 1)"""


@register("hausdorff4", f"WITH {_TRAJ}, h AS (SELECT vec_id, min(gap) AS g FROM d GROUP BY vec_id, i UNION ALL SELECT vec_id, min(gap) FROM d GROUP BY vec_id, j) SELECT vec_id, round(max(g), 9) AS dist FROM h GROUP BY vec_id")
def hausdorff4(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(shapes.hausdorff_column(F.col("a"), F.col("b")), 9).alias("dist"))


# the three dynamic programs row by row, each row a list that grows from left to right


@register("trajectory_measures", f"""WITH RECURSIVE {_TRAJ}, g AS (SELECT vec_id, i, list(gap ORDER BY j) AS gap FROM d GROUP BY vec_id, i),
w AS (SELECT DISTINCT vec_id, -1 AS i, list_prepend(0.0, list_transform(range(16), lambda x: CAST('inf' AS DOUBLE))) AS f, list_prepend(0.0, list_transform(range(16), lambda x: CAST('inf' AS DOUBLE))) AS t, list_transform(range(17), lambda x: CAST(x AS DOUBLE)) AS e FROM g
UNION ALL SELECT w.vec_id, w.i + 1, list_reduce(list_transform(range(1, 17), lambda j: [CAST(j AS DOUBLE)]), lambda acc, j: list_append(acc, greatest(g.gap[CAST(j[1] AS INT)], least(f[CAST(j[1] AS INT)], f[CAST(j[1] AS INT) + 1], acc[-1]))), [CAST('inf' AS DOUBLE)]),
 list_reduce(list_transform(range(1, 17), lambda j: [CAST(j AS DOUBLE)]), lambda acc, j: list_append(acc, g.gap[CAST(j[1] AS INT)] + least(t[CAST(j[1] AS INT)], t[CAST(j[1] AS INT) + 1], acc[-1])), [CAST('inf' AS DOUBLE)]),
 list_reduce(list_transform(range(1, 17), lambda j: [CAST(j AS DOUBLE)]), lambda acc, j: list_append(acc, least(e[CAST(j[1] AS INT) + 1] + 1, acc[-1] + 1, e[CAST(j[1] AS INT)] + CASE WHEN g.gap[CAST(j[1] AS INT)] <= 0.3 THEN 0 ELSE 1 END)), [CAST(w.i + 2 AS DOUBLE)])
 FROM w JOIN g ON g.vec_id = w.vec_id AND g.i = w.i + 1)
SELECT vec_id, round(f[17], 9) AS frechet, round(t[17], 9) AS dtw, CAST(e[17] AS BIGINT) AS edr FROM w WHERE i = 15""")
def trajectory_measures(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("vec_id", shapes.measures_column(F.col("a"), F.col("b"), 0.3).alias("s"))
    return p.select("vec_id", F.round("s.frechet", 9).alias("frechet"), F.round("s.dtw", 9).alias("dtw"), F.col("s.edr").alias("edr"))


@register("trajectory_skips", None)
def trajectory_skips(spark, sf_dir):
    """The Frechet distance with one vertex of each side passed over, and the length of the warping walk."""
    p = _pairs(spark, sf_dir).select("vec_id", shapes.measures_column(F.col("a"), F.col("b"), 0.3).alias("s"))
    return p.select("vec_id", F.round("s.frechet_skips", 9).alias("frechet_skip1"), F.col("s.dtw_steps").alias("dtw_steps"))


_I8 = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 127) AS INT))"


@register("dot_i8", f"SELECT a.vec_id, CAST(list_sum(list_transform(list_zip({_I8.replace('embedding', 'a.embedding')}, {_I8.replace('embedding', 'b.embedding')}), lambda p: p[1] * p[2])) AS INT) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_i8(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 127).cast("int")).alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", V.dot_i8(F.col("v"), F.col("w")).alias("dot"))


_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


@register("knn", f"SELECT query, CAST(rank AS INT) AS rank, id, round(d2, 9) AS d2 FROM (SELECT query, id, d2, row_number() OVER (PARTITION BY query ORDER BY d2, id) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_D2} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id % 25 = 0)) WHERE rank <= 8")
def knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.knn(e.where("vec_id % 25 = 0"), e, 8).withColumn("d2", F.round("d2", 9))


@register("rowsig", "WITH s AS (SELECT a.vec_id AS row, b.vec_id AS id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = 0), m AS (SELECT row, avg(score) AS mean, stddev_pop(score) AS sd FROM s GROUP BY row), z AS (SELECT s.row, id, score, (score - mean) / sd AS z, row_number() OVER (PARTITION BY s.row ORDER BY score DESC, id) AS rank FROM s JOIN m ON s.row = m.row WHERE score > mean + 2.5 * sd) SELECT row, CAST(rank AS INT) AS rank, id, round(score, 6) AS score, round(z, 6) AS z FROM z WHERE rank <= 4")
def rowsig(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.rowsig(e.where("vec_id % 10 = 0"), e, 2.5, 4).withColumns({"score": F.round("score", 6), "z": F.round("z", 6)})


@register("rowsig_counts", "WITH s AS (SELECT a.vec_id AS row, b.vec_id AS id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = 0), m AS (SELECT row, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd FROM s GROUP BY row), z AS (SELECT s.row, id, score, n, mean, sd, score > mean + 2.5 * sd AS hit, row_number() OVER (PARTITION BY s.row ORDER BY score DESC, id) AS rank FROM s JOIN m ON s.row = m.row) SELECT row, max(n) AS n, round(max(mean), 6) AS mean, round(max(sd), 6) AS sd, count(CASE WHEN hit THEN 1 END) AS above, count(CASE WHEN hit AND score > mean + 4 * sd THEN 1 END) AS above4, count(CASE WHEN hit AND score > mean + 5 * sd THEN 1 END) AS above5, coalesce(string_agg(CASE WHEN hit AND rank <= 4 THEN CAST(id AS VARCHAR) END, ' ' ORDER BY rank), '') AS ids FROM z GROUP BY row")
def rowsig_counts(spark, sf_dir):
    """Every row's spread, how many stand out from it, and the ids that do, best first; rows without any included."""
    e = table(spark, sf_dir, "embeddings")
    s = V.signatures(e.where("vec_id % 10 = 0"), e, 2.5, 4)
    ids = F.array_join(F.transform("hits", lambda h: h["id"].cast("string")), " ")
    return s.select("row", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "above", "above4", "above5", ids.alias("ids"))


@register("label_eigenmap", None)
def label_eigenmap(spark, sf_dir):
    """A map of the labels from how alike their mean vectors are: the matrix is labels by labels, whatever the rows."""
    means = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))

    def run(pdf):
        m = pdf.pivot(index="label", columns="d", values="x").sort_index()
        u = m.to_numpy() / np.sqrt((m.to_numpy() ** 2).sum(axis=1))[:, None]
        values, at = V.eigenmap(1 + u @ u.T - 2 * np.eye(len(u)), 2)
        return pd.DataFrame({"label": m.index, "e1": np.round(at[:, 0], 6), "e2": np.round(at[:, 1], 6), "value1": round(float(values[0]), 6)})

    # labels x dimensions rows, few by construction of the table
    return means.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: run(pdf), "label int, e1 double, e2 double, value1 double")
