"""Queries over run-length sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import vertex
from tesserae.operators import paths as P
from tesserae.plans.catalogue import register
from tesserae.sources.tables import event_sequences, table, trajectories  # noqa: F401

POS = "SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS id FROM events"
RUNS = f"""
p AS ({POS}),
f AS (SELECT *, CASE WHEN id IS NOT DISTINCT FROM lag(id) OVER (PARTITION BY seq ORDER BY pos) AND pos > 0 THEN 0 ELSE 1 END AS fresh FROM p),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) AS vertex FROM f),
r AS (SELECT seq, CAST(vertex AS BIGINT) AS vertex, CAST(min(pos) AS BIGINT) AS start, any_value(id) AS id, count(*) AS run FROM v GROUP BY seq, vertex)"""


def _runs(spark, sf_dir):
    return P.runs(event_sequences(spark, sf_dir))


@register("path_runs", f"WITH {RUNS} SELECT * FROM r")
def path_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@register("path_expand", POS)
def path_expand(spark, sf_dir):
    return P.expand_rows(_runs(spark, sf_dir))


@register("path_length", "SELECT user_id AS seq, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS written FROM events GROUP BY user_id")
def path_length(spark, sf_dir):
    paths = P.paths(_runs(spark, sf_dir))
    return paths.select("seq", P.length(F.col("path")).alias("n"), F.array_join(P.expand(F.col("path")), ",").alias("written"))


@register("path_keys", "SELECT user_id AS seq, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS keys FROM events GROUP BY user_id")
def path_keys(spark, sf_dir):
    return P.paths(_runs(spark, sf_dir)).select("seq", F.array_join(P.keys(F.col("path")), ",").alias("keys"))


@register("inverted_index", "SELECT event_type AS key, CAST(count(DISTINCT user_id) AS BIGINT) AS paths FROM events GROUP BY event_type")
def inverted_index(spark, sf_dir):
    return _runs(spark, sf_dir).select("seq", F.col("id").alias("key")).dropDuplicates().groupBy("key").agg(F.count("*").alias("paths"))


SOME = ["purchase", "signup"]
_SOME = ", ".join(f"'{x}'" for x in SOME)


@register("path_holds", f"SELECT user_id AS seq, count(DISTINCT event_type) FILTER (event_type IN ({_SOME})) = {len(SOME)} AS every, count(*) FILTER (event_type IN ({_SOME})) > 0 AS some FROM events GROUP BY user_id")
def path_holds(spark, sf_dir):
    return P.paths(_runs(spark, sf_dir)).select("seq", P.holds(F.col("path"), SOME, True).alias("every"), P.holds(F.col("path"), SOME, False).alias("some"))


@register("path_times", f"SELECT u.user_id AS seq, t.id, count(e.event_id) AS times FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest([{_SOME}]) AS id) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.id GROUP BY 1, 2")
def path_times(spark, sf_dir):
    return P.times(_runs(spark, sf_dir), SOME)


@register("path_middle_any", f"WITH p AS ({POS}), n AS (SELECT seq, count(*) AS n FROM p GROUP BY seq) SELECT n.seq, coalesce(bool_or(id IN ({_SOME}) AND pos > 0 AND pos < n - 1), false) AS middle FROM n JOIN p ON p.seq = n.seq GROUP BY n.seq")
def path_middle_any(spark, sf_dir):
    return P.paths(_runs(spark, sf_dir)).select("seq", P.middle_any(F.col("path"), SOME).alias("middle"))


PHRASE = ["click", "view"]


def _phrase_sql(before: bool) -> str:
    beside = "lag(id) OVER w" if before else "lead(id, 2) OVER w"
    return f"WITH p AS ({POS}), n AS (SELECT *, lead(id) OVER w AS second, {beside} AS beside FROM p WINDOW w AS (PARTITION BY seq ORDER BY pos)) SELECT seq, pos, beside AS id FROM n WHERE id = '{PHRASE[0]}' AND second = '{PHRASE[1]}' AND beside IS NOT NULL"


@register("path_follows", _phrase_sql(False))
def path_follows(spark, sf_dir):
    return P.neighbours(P.positions(event_sequences(spark, sf_dir)), PHRASE)


@register("path_precedes", _phrase_sql(True))
def path_precedes(spark, sf_dir):
    return P.neighbours(P.positions(event_sequences(spark, sf_dir)), PHRASE, before=True)


@register("run_pairs", f"WITH p AS ({POS}) SELECT x.id AS a, y.id AS b, CAST(g AS INT) AS gap, count(*) AS times FROM p x CROSS JOIN range(1, 5) r(g) JOIN p y ON y.seq = x.seq AND y.pos = x.pos + g GROUP BY 1, 2, 3")
def run_pairs(spark, sf_dir):
    return P.run_pairs(_runs(spark, sf_dir), 1, 4)


@register("path_enrich", f"WITH p AS ({POS}) SELECT seq, pos, id, CAST(CASE WHEN pos % 3 = 0 THEN pos % 7 WHEN pos % 5 = 0 THEN seq % 4 ELSE 0 END AS BIGINT) AS said FROM p WHERE seq NOT IN (SELECT seq FROM p WHERE pos % 15 = 0 AND pos % 7 <> 0 AND seq % 4 <> 0 AND pos % 7 <> seq % 4)")
def path_enrich(spark, sf_dir):
    p = P.positions(event_sequences(spark, sf_dir))
    left = p.withColumn("said", F.when(F.col("pos") % 3 == 0, F.col("pos") % 7).otherwise(0))
    right = p.withColumn("said", F.when((F.col("pos") % 5 == 0), F.when((F.col("pos") % 3 == 0) & (F.col("pos") % 7 == 0), 0).otherwise(F.col("seq") % 4)).otherwise(0))
    return P.enrich(left, right)


@register("tuple_ends", "WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS part FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(CASE WHEN len(part) < 2 OR (part[1] = 'user') = (part[len(part)] = 'user') THEN -1 WHEN part[1] = 'user' THEN len(part) - 1 ELSE 0 END AS INT) AS other, len(part) > 2 AND list_contains(part[2:len(part) - 1], 'system') AS middle FROM t")
def tuple_ends(spark, sf_dir):
    part = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    tuples = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(part.alias("part"))
    return tuples.select("conv_id", P.other_end(F.col("part"), F.lit("user")).alias("other"), P.middle_of_tuple(F.col("part"), ["system"]).alias("middle"))


@register("vertex_metadata", f"WITH {RUNS}, m AS (SELECT seq, vertex, (least(start, 262143) << 35) | ((start % 4) << 33) | ((seq % 8) << 30) | run AS m FROM r) SELECT seq, vertex, m, m & 1073741823 AS run, (m >> 30) & 7 AS said, (m >> 33) & 3 AS outcome, (m >> 35) & 262143 AS position FROM m")
def vertex_metadata(spark, sf_dir):
    r = _runs(spark, sf_dir)
    m = r.select("seq", "vertex", vertex.pack(F.col("run"), F.col("seq") % 8, F.col("start") % 4, F.col("start")).alias("m"))
    d = F.col("m").cast("double")
    return m.select("seq", "vertex", "m", vertex.run(d).alias("run"), vertex.said(d).alias("said"), vertex.outcome(d).alias("outcome"), vertex.position(d).alias("position"))


@register("outcome_scores", "WITH s AS (SELECT event_id, greatest(0.0, least(1.0, value / 100.0)) AS score FROM events WHERE value IS NOT NULL) SELECT event_id, CAST(CASE WHEN score >= 1 THEN 0 WHEN score = 0.5 THEN 1 WHEN score <= 0 THEN 2 ELSE 3 END AS INT) AS outcome, CASE WHEN score >= 1 THEN 1.0 WHEN score = 0.5 THEN 0.5 WHEN score <= 0 THEN 0.0 ELSE greatest(1, least(16777215, CAST(floor(score * 16777216 + 0.5) AS BIGINT))) / 16777216.0 END AS carried FROM s")
def outcome_scores(spark, sf_dir):
    s = table(spark, sf_dir, "events").where("value is not null").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100.0)).alias("score"))
    return s.select("event_id", vertex.outcome_of(F.col("score"))["outcome"].alias("outcome"), vertex.score_carried(F.col("score")).alias("carried"))
