"""Queries over claims, witnesses, graphs and budgets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import envelope as E
from tesserae.functions import ratings as R
from tesserae.operators import consensus as K
from tesserae.operators import graphs as G
from tesserae.operators import series as S
from tesserae.operators.checkpoints import cut
from tesserae.operators.quantiles import medians
from tesserae.plans.catalogue import register
from tesserae.sources.tables import table

_PRIORS = "CAST([" + ", ".join(str(p) for _, p in R.TRUST_CLASSES) + "] AS DOUBLE[])"
_WITNESS = f"""m AS (SELECT event_type, median(value) AS mid FROM events GROUP BY event_type),
e AS (SELECT e.event_type AS claim, user_id AS root, user_id AS witness, event_id, ts, ({_PRIORS})[CAST(user_id % 16 AS INT) + 1] AS trust, CAST(CASE WHEN value > mid THEN 1 ELSE 0 END AS DOUBLE) AS win FROM events e JOIN m ON m.event_type = e.event_type WHERE value IS NOT NULL)"""


def _witnesses(spark, sf_dir):
    """(claim, root, witness, event_id, ts, trust, win): each event is a game for its type, won above the type's median."""
    e = table(spark, sf_dir, "events").where("value is not null")
    mid = cut(medians(e, "event_type", "value", "mid"))
    priors = F.array(*(F.lit(p) for _, p in R.TRUST_CLASSES))
    out = e.join(F.broadcast(mid) if mid.count() <= 100_000 else mid, "event_type")
    return out.select(F.col("event_type").alias("claim"), F.col("user_id").alias("root"), F.col("user_id").alias("witness"), "event_id", "ts", F.get(priors, (F.col("user_id") % 16).cast("int")).alias("trust"), (F.col("value") > F.col("mid")).cast("double").alias("win"))


def _entries(spark, sf_dir):
    return _witnesses(spark, sf_dir).select("claim", "root", "witness", F.lit(1).cast("bigint").alias("games"), F.col("win").alias("wins"), "trust")


@register("fold_by_root", f"WITH {_WITNESS} SELECT claim, root, count(*) AS games, sum(win) AS wins, max(trust) AS trust FROM e GROUP BY claim, root")
def fold_by_root(spark, sf_dir):
    return K.fold(_entries(spark, sf_dir))


_CAP = "(173.7178 / 30) * (173.7178 / 30)"
_PHI2 = "(350.0 / 173.7178) * (350.0 / 173.7178)"
# a root's own strength, given its claim's at m: halve the bracket of the most that its games can pull
_OWN = """list_reduce(range(90), lambda a, k: CASE WHEN p * (m - (a[1] + a[2]) / 2) + n * (score - 1 / (1 + exp(-(a[1] + a[2]) / 2))) > 0 THEN [(a[1] + a[2]) / 2, a[2]] ELSE [a[1], (a[1] + a[2]) / 2] END, [m - n / p, m + n / p])[1]"""


_VOLATILITY = f"""list_reduce(range(100), lambda a, k: CASE WHEN exp((a[1] + a[2]) / 2) * (d * d - {_PHI2} - v - exp((a[1] + a[2]) / 2)) / (2 * ({_PHI2} + v + exp((a[1] + a[2]) / 2)) * ({_PHI2} + v + exp((a[1] + a[2]) / 2))) - ((a[1] + a[2]) / 2 - 2 * ln({R.VOLATILITY})) / ({R.TAU} * {R.TAU}) > 0 THEN [(a[1] + a[2]) / 2, a[2]] ELSE [a[1], (a[1] + a[2]) / 2] END, [CAST(-60 AS DOUBLE), CAST(20 AS DOUBLE)])[1]"""


def _posterior_sql(where: str, out: str) -> str:
    """SQL that halves each claim's bracket by the sign of its roots' sum, then gives the roots' information and the claim's."""
    return f"""WITH RECURSIVE {_WITNESS}, f AS (SELECT claim, root, CAST(count(*) AS DOUBLE) AS games, sum(win) AS wins, max(trust) AS trust FROM e{where} GROUP BY claim, root),
r AS (SELECT claim, root, games AS n, 0.5 + trust * (wins / games - 0.5) AS score, CASE WHEN trust >= 1 THEN {_CAP} ELSE least({_CAP}, 3 * trust * trust / ({math.pi} * {math.pi} * (1 - trust * trust))) END AS p FROM f WHERE trust > 0),
h AS (SELECT claim, CAST(-1000 AS DOUBLE) AS lo, CAST(1000 AS DOUBLE) AS hi, 0 AS k FROM r GROUP BY claim UNION ALL
SELECT claim, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (
SELECT claim, max(lo) AS lo, max(hi) AS hi, max(k) AS k, sum(p * ({_OWN} - m)) - max(m) / ({_PHI2}) > 0 AS up FROM (SELECT r.*, lo, hi, k, (lo + hi) / 2 AS m FROM h JOIN r ON r.claim = h.claim WHERE k < 70) GROUP BY claim)),
x AS (SELECT *, {_OWN} AS x FROM (SELECT r.*, (lo + hi) / 2 AS m FROM h JOIN r ON r.claim = h.claim WHERE k = 70)),
i AS (SELECT claim, root, m, p * (x - m) AS gain, 1 / (1 / (n * exp(-abs(x)) / ((1 + exp(-abs(x))) * (1 + exp(-abs(x))))) + 1 / p) AS information FROM x),
t AS (SELECT claim, max(m) AS m, sum(gain) AS gain, sum(information) AS info FROM i GROUP BY claim),
u AS (SELECT *, 1 / info AS v, gain / info AS d FROM t),
w AS (SELECT *, {_VOLATILITY} AS s FROM u),
c AS (SELECT f.claim, CAST(sum(f.games) AS BIGINT) AS matches, count(CASE WHEN f.trust > 0 THEN 1 END) AS witnesses FROM f GROUP BY f.claim)
{out}"""


_STANDING_SQL = f"SELECT c.claim, round(coalesce(1500 + 173.7178 * m, 1500.0), 6) AS rating, round(coalesce(173.7178 / sqrt(1 / ({_PHI2} + exp(s)) + info), 350.0), 6) AS deviation, round(coalesce(exp(s / 2), {R.VOLATILITY}), 6) AS volatility, matches, witnesses FROM c LEFT JOIN w ON w.claim = c.claim"


def _rounded(standings):
    return standings.select("claim", *(F.round(c, 6).alias(c) for c in ("rating", "deviation", "volatility")), "matches", "witnesses")


@register("series", _posterior_sql("", _STANDING_SQL))
def series(spark, sf_dir):
    return _rounded(S.standings(K.fold(_entries(spark, sf_dir))))


@register("series_scoped", _posterior_sql(" WHERE trust >= 0.5 AND witness % 3 = 0", _STANDING_SQL))
def series_scoped(spark, sf_dir):
    e = _entries(spark, sf_dir)
    allowed = e.select("witness").where("witness % 3 = 0")
    return _rounded(S.standings(K.fold(K.scoped(e, allowed, 0.5))))


@register("root_information", _posterior_sql("", "SELECT claim, root, round(information, 9) AS information FROM i"))
def root_information(spark, sf_dir):
    return S.information(K.fold(_entries(spark, sf_dir))).withColumn("information", F.round("information", 9))


@register("matchup_replay", None)
def matchup_replay(spark, sf_dir):
    w = _witnesses(spark, sf_dir)
    games = w.select("claim", F.row_number().over(Window.partitionBy("claim").orderBy("ts", "event_id")).alias("ord"), "trust", F.col("win").alias("score"))
    out = K.replay(games)
    return out.select("claim", *(F.round(c, 6).alias(c) for c in ("rating", "deviation", "volatility")))


@register("glicko2_period", f"""WITH {_WITNESS}, g AS (SELECT claim AS player, win, 1 / sqrt(1 + 3 * d * d / ({math.pi} * {math.pi})) AS g FROM (SELECT claim, win, CASE WHEN trust >= 1 THEN 0.0 ELSE {math.pi} / sqrt(3.0) * sqrt(1 / (trust * trust) - 1) END AS d FROM e WHERE trust > 0)),
s AS (SELECT player, sum(g * (win - 0.5)) AS gain, sum(g * g * 0.25) AS info FROM g GROUP BY player), u AS (SELECT *, 1 / info AS v, gain / info AS d FROM s), w AS (SELECT *, {_VOLATILITY} AS x FROM u)
SELECT player, round(1500 + 173.7178 * gain / (1 / ({_PHI2} + exp(x)) + info), 6) AS rating, round(173.7178 / sqrt(1 / ({_PHI2} + exp(x)) + info), 6) AS deviation, round(exp(x / 2), 6) AS volatility FROM w""")
def glicko2_period(spark, sf_dir):
    w = _witnesses(spark, sf_dir).where("trust > 0")
    games = w.select(F.col("claim").alias("player"), F.lit(R.RATING).alias("opponent"), R.trust_deviation(F.col("trust")).alias("opponent_deviation"), F.col("win").alias("score"))
    return K.periods(games).select("player", *(F.round(c, 6).alias(c) for c in ("rating", "deviation", "volatility")))


_HALVE = """i AS (SELECT claim, root, 0.5 + trust * (wins / games - 0.5) AS vote, trust, CAST(games AS DOUBLE) AS n, 350.0 / 173.7178 AS phi FROM f WHERE trust > 0),
b AS (SELECT *, CASE WHEN vote > 0.5 THEN 0.0 ELSE greatest(CASE WHEN vote <= 0 THEN -1e300 ELSE ln(vote / (1 - vote)) END, -n * phi * phi) END AS lo, CASE WHEN vote > 0.5 THEN least(CASE WHEN vote >= 1 THEN 1e300 ELSE ln(vote / (1 - vote)) END, n * phi * phi) ELSE 0.0 END AS hi FROM i)"""


@register("attest_series", f"""WITH RECURSIVE {_WITNESS}, f AS (SELECT claim, root, count(*) AS games, sum(win) AS wins, max(trust) AS trust FROM e GROUP BY claim, root), {_HALVE},
h AS (SELECT claim, root, trust, vote, n, phi, lo, hi, 0 AS k FROM b UNION ALL
SELECT claim, root, trust, vote, n, phi, CASE WHEN -(lo + hi) / 2 / (phi * phi) + n * (vote - 1 / (1 + exp(-(lo + hi) / 2))) > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN -(lo + hi) / 2 / (phi * phi) + n * (vote - 1 / (1 + exp(-(lo + hi) / 2))) > 0 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM h WHERE k < 80),
z AS (SELECT *, (lo + hi) / 2 AS mu, 1 / (1 + exp(-(lo + hi) / 2)) AS x FROM h WHERE k = 80)
SELECT claim, root, round(1500 + 173.7178 * mu, 6) AS rating, round(least(350.0, greatest(173.7178 / sqrt(1 / (phi * phi) + n * x * (1 - x)), least(350.0, greatest(30.0, CASE WHEN trust >= 1 THEN 0.0 ELSE 173.7178 * pi() / sqrt(3.0) * sqrt(1 / (trust * trust) - 1) END)))), 6) AS deviation FROM z""")
def attest_series(spark, sf_dir):
    f = K.fold(_entries(spark, sf_dir)).where("trust > 0")
    s = R.attest_series(F.lit(R.RATING), F.lit(R.DEVIATION), F.col("trust"), F.col("games"), F.col("wins") / F.col("games"))
    out = f.select("claim", "root", s.alias("s"))
    return out.select("claim", "root", F.round("s.rating", 6).alias("rating"), F.round("s.deviation", 6).alias("deviation"))


_DEV = f"CASE WHEN abs(t) >= 1 THEN 0.0 WHEN t = 0 THEN NULL ELSE 173.7178 * {math.pi} / sqrt(3.0) * sqrt(1 / (t * t) - 1) END"


@register("trust_measures", f"""WITH c AS (SELECT unnest({[n for n, _ in R.TRUST_CLASSES]}) AS label, unnest({_PRIORS}) AS t), d AS (SELECT *, {_DEV} AS d FROM c)
SELECT label, t AS prior, round(d, 6) AS deviation, round(CASE WHEN t = 0 THEN 350.0 ELSE greatest(30.0, d) END, 6) AS entry, round(least(350.0, greatest(30.0, coalesce(d, 1e9))), 6) AS series_floor, round(CASE WHEN t = 0 THEN 0.0 WHEN t = 1 THEN (173.7178 / 30) * (173.7178 / 30) ELSE least(3 * t * t / ({math.pi} * {math.pi} * (1 - t * t)), (173.7178 / 30) * (173.7178 / 30)) END, 6) AS precision FROM d""")
def trust_measures(spark, sf_dir):
    c = spark.createDataFrame([(n,) for n, _ in R.TRUST_CLASSES], "label string").withColumn("t", R.trust_class(F.col("label")))
    t = F.col("t")
    d = R.trust_deviation(t)
    return c.select("label", t.alias("prior"), F.round(F.when(t != 0, d), 6).alias("deviation"), F.round(R.entry_deviation(t), 6).alias("entry"), F.round(R.series_floor(t), 6).alias("series_floor"), F.round(R.witness_precision(t), 6).alias("precision"))


@register("trust_class_lookup", f"SELECT event_id, list_position({[n for n, _ in R.TRUST_CLASSES]}, CASE WHEN event_id % 3 = 0 THEN 'AppDerived' WHEN event_id % 3 = 1 THEN 'appderived' ELSE 'StandardsDerived' END) IS NOT NULL AS known, CAST(CASE event_id % 3 WHEN 0 THEN 0.4 WHEN 2 THEN 0.95 END AS DOUBLE) AS prior FROM events")
def trust_class_lookup(spark, sf_dir):
    label = F.when(F.col("event_id") % 3 == 0, "AppDerived").when(F.col("event_id") % 3 == 1, "appderived").otherwise("StandardsDerived")
    e = table(spark, sf_dir, "events").select("event_id", R.trust_class(label).alias("prior"))
    return e.select("event_id", F.col("prior").isNotNull().alias("known"), "prior")


@register("attested_rows", "WITH g AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE CAST(event_id % 9 AS DOUBLE) END AS games, CAST(event_id % 5 AS DOUBLE) AS wins, (event_id % 21 - 10) / 10.0 AS trust FROM events) SELECT event_id, CAST(games AS BIGINT) AS games, CASE WHEN trust < 0 THEN games - wins ELSE wins END AS wins, abs(trust) AS trust FROM g WHERE games >= 1 AND floor(games) = games AND wins <= games")
def attested_rows(spark, sf_dir):
    i = F.col("event_id")
    g = table(spark, sf_dir, "events").select("event_id", R.attested(F.when(i % 7 == 0, 0.5).otherwise((i % 9).cast("double")), (i % 5).cast("double"), (i % 21 - 10) / 10.0).alias("a"))
    return g.where("a is not null").select("event_id", "a.*")


@register("claim_costs", "SELECT c_custkey, round(1 / (1 + exp(-((1500 + c_acctbal / 20 - 1500) / 173.7178 - 2 * (50 + c_custkey % 300) / 173.7178))), 9) AS confidence, round(ln(1 + exp(-((c_acctbal / 20) / 173.7178 - 2 * (50 + c_custkey % 300) / 173.7178))) + 0.1, 9) AS cost FROM customer")
def claim_costs(spark, sf_dir):
    rating, deviation = F.lit(1500.0) + F.col("c_acctbal") / 20, (50 + F.col("c_custkey") % 300).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(R.confidence(rating, deviation), 9).alias("confidence"), F.round(R.cost(rating, deviation, 2.0, 0.1), 9).alias("cost"))


@register("fisher_shares", "WITH w AS (SELECT c_nationkey AS nation, c_custkey AS customer, CAST(greatest(0, floor(c_acctbal)) AS BIGINT) AS weight FROM customer), x AS (SELECT *, 10000.0 * (weight / sum(weight) OVER (PARTITION BY nation)) AS exact, sum(weight) OVER (PARTITION BY nation) AS total FROM w), f AS (SELECT *, CAST(floor(coalesce(exact, 0)) AS INT) AS whole FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY CASE WHEN weight > 0 THEN exact - whole ELSE -1 END DESC, customer) AS place, 10000 - sum(whole) OVER (PARTITION BY nation) AS missing FROM f) SELECT nation, customer, CAST(whole + CASE WHEN total > 0 AND place <= missing THEN 1 ELSE 0 END AS INT) AS share FROM r")
def fisher_shares(spark, sf_dir):
    w = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.greatest(F.lit(0).cast("bigint"), F.floor("c_acctbal").cast("bigint")).alias("weight"))
    return K.shares(w, "nation", "customer", "weight")


@register("tallies", "SELECT l_partkey AS claim, CAST(sum(l_quantity) AS DOUBLE) AS games, CAST(sum(l_quantity) AS DOUBLE) AS tokens, CAST(sum(l_quantity * CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 0.5 ELSE 1 END) AS DOUBLE) AS wins, min(CASE WHEN l_linenumber > 1 THEN l_linenumber END) AS position FROM lineitem GROUP BY l_partkey")
def tallies(spark, sf_dir):
    score = F.when(F.col("l_returnflag") == "R", 0.0).when(F.col("l_returnflag") == "A", 0.5).otherwise(1.0)
    position = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).otherwise(0)
    return K.tally(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "claim"), ["claim"], F.col("l_quantity"), score, position)


# region 1.., nation 100.., customer 10^6.., order 10^9.., line 10^12..; a line's times are its quantity
_NODES = "n AS (SELECT 1 + r_regionkey AS parent, 100 + n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey), c AS (SELECT 100 + c_nationkey AS parent, 1000000 + c_custkey AS child FROM customer), o AS (SELECT 1000000 + o_custkey AS parent, 1000000000 + o_orderkey AS child FROM orders), l AS (SELECT 1000000000 + l_orderkey AS parent, 1000000000000 + l_orderkey * 10 + l_linenumber AS child, CAST(l_quantity AS BIGINT) AS times FROM lineitem)"


def _edges(spark, sf_dir):
    big = lambda e: e.cast("bigint")
    once = F.lit(1).cast("bigint").alias("times")
    n = table(spark, sf_dir, "nation").select(big(1 + F.col("n_regionkey")).alias("parent"), big(100 + F.col("n_nationkey")).alias("child"), once)
    c = table(spark, sf_dir, "customer").select(big(100 + F.col("c_nationkey")).alias("parent"), big(1000000 + F.col("c_custkey")).alias("child"), once)
    o = table(spark, sf_dir, "orders").select(big(1000000 + F.col("o_custkey")).alias("parent"), big(1000000000 + F.col("o_orderkey")).alias("child"), once)
    l = table(spark, sf_dir, "lineitem").select(big(1000000000 + F.col("l_orderkey")).alias("parent"), big(1000000000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child"), big(F.col("l_quantity")).alias("times"))
    return n.union(c).union(o).union(l).withColumn("distance", F.lit(1))


def _nodes(edges):
    return edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node"))).distinct()


@register("dag_counts", f"WITH {_NODES} SELECT n.parent AS top, CAST(sum(l.times) AS BIGINT) AS paths, count(DISTINCT l.child) AS leaves FROM n JOIN c ON c.parent = n.child JOIN o ON o.parent = c.child JOIN l ON l.parent = o.child GROUP BY n.parent")
def dag_counts(spark, sf_dir):
    e = _edges(spark, sf_dir)
    tops = table(spark, sf_dir, "region").select((1 + F.col("r_regionkey")).cast("bigint").alias("node"))
    p = G.path_counts(e, tops).where("node >= 1000000000000")
    return p.groupBy("top").agg(F.sum("paths").cast("bigint").alias("paths"), F.count("*").alias("leaves"))


@register("dag_levels", f"WITH {_NODES}, lo AS (SELECT o.parent, o.child, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.parent = o.child) THEN 1 ELSE 0 END AS level FROM o), lc AS (SELECT c.parent, c.child, coalesce(max(lo.level) + 1, 0) AS level FROM c LEFT JOIN lo ON lo.parent = c.child GROUP BY c.parent, c.child), ln AS (SELECT n.parent, n.child, coalesce(max(lc.level) + 1, 0) AS level FROM n LEFT JOIN lc ON lc.parent = n.child GROUP BY n.parent, n.child), lr AS (SELECT parent AS child, max(level) + 1 AS level FROM ln GROUP BY parent), every AS (SELECT DISTINCT child, 0 AS level FROM l UNION ALL SELECT child, level FROM lo UNION ALL SELECT child, level FROM lc UNION ALL SELECT child, level FROM ln UNION ALL SELECT child, level FROM lr) SELECT CAST(child AS BIGINT) AS node, CAST(level AS BIGINT) AS level FROM every")
def dag_levels(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.levels(e, _nodes(e))


@register("dag_order", f"WITH {_NODES} SELECT CAST(node AS BIGINT) AS node, CAST(wave AS BIGINT) AS wave FROM (SELECT DISTINCT parent AS node, 0 AS wave FROM n UNION ALL SELECT child, 1 FROM n UNION ALL SELECT child, 2 FROM c UNION ALL SELECT child, 3 FROM o UNION ALL SELECT DISTINCT child, 4 FROM l)")
def dag_order(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.order(e, _nodes(e))


@register("graph_components", "SELECT c_custkey AS node, CASE WHEN c_custkey % 8 <= 3 AND c_custkey - c_custkey % 8 + 3 <= hi AND c_custkey - c_custkey % 8 >= lo THEN c_custkey - c_custkey % 8 ELSE c_custkey END AS component FROM customer, (SELECT min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer)")
def graph_components(spark, sf_dir):
    """All customers: each leads to the next, but that every eighth chain of four leads back to its first, and every seventh to itself."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    e = c.select(k.alias("parent"), F.when(k % 8 == 3, k - 3).when(k % 8 == 7, k).otherwise(k + 1).alias("child"))
    nodes = c.select(k.alias("node"))
    known = e.join(nodes.withColumnRenamed("node", "child"), "child", "left_semi").select("parent", "child")
    return G.strong_groups(known, nodes)


_TRADE = "t AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


@register("cheapest_chain", f"WITH RECURSIVE {_TRADE}, p AS (SELECT 0 AS node, 0 AS cost, 0 AS hops UNION SELECT t.b, p.cost + 1000000 // (1 + n), p.hops + 1 FROM p JOIN t ON t.a = p.node WHERE hops < 4) SELECT CAST(node AS BIGINT) AS node, CAST(min(cost) AS DOUBLE) AS cost FROM p GROUP BY node")
def cheapest_chain(spark, sf_dir):
    return G.cheapest(_trade(spark, sf_dir), spark.range(1).select(F.col("id").alias("node"))).select("node", "cost")


def _trade(spark, sf_dir):
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    t = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    return t.select(F.col("c_nationkey").cast("bigint").alias("parent"), F.col("s_nationkey").cast("bigint").alias("child"), F.floor(F.lit(1000000) / (1 + F.col("n"))).cast("double").alias("cost"), F.col("n").alias("claim"))


@register("frontier_pull", f"WITH RECURSIVE {_TRADE}, e AS (SELECT a, b, 1000000 // (1 + n) AS cost FROM t), p AS (SELECT 0 AS node, 0 AS cost, 0 AS hops UNION SELECT e.b, p.cost + e.cost, p.hops + 1 FROM p JOIN e ON e.a = p.node WHERE hops < 4), d AS (SELECT node, min(cost) AS cost FROM p GROUP BY node), c AS (SELECT * FROM d WHERE cost <= (SELECT avg(cost) FROM e)), o AS (SELECT e.b AS node, min(c.cost + e.cost) AS cost FROM c JOIN e ON e.a = c.node WHERE e.b NOT IN (SELECT node FROM c) GROUP BY e.b) SELECT CAST(node AS BIGINT) AS node, CAST(cost AS DOUBLE) AS cost, true AS closed FROM c UNION ALL SELECT CAST(node AS BIGINT), CAST(cost AS DOUBLE), false FROM o")
def frontier_pull(spark, sf_dir):
    """The nations that trade reaches from the first one, pulled to half of an edge's mean cost and then to all of it: closed ones, and open ones with their best offer."""
    e = cut(_trade(spark, sf_dir))
    mean = e.agg(F.avg("cost")).first()[0] or 0.0
    state = G.started(spark.range(1).select(F.col("id").alias("node")))
    for until in (mean / 2, mean):
        state = G.pulled(state, e, until=until)
    return state.select("node", "cost", "closed")


_COUNT = "CAST(o_orderkey * 7919 % 300000 AS BIGINT) AS wall_us, CAST(o_orderkey % 50 AS BIGINT) AS db_probes, CAST(o_orderkey * 31 % 9000 AS BIGINT) AS rows_scanned, CAST(o_orderkey * 65537 % 33554432 AS BIGINT) AS bytes_alloc, CAST(o_orderkey % 4 AS BIGINT) AS hops, CAST(o_orderkey % 400 AS BIGINT) AS tokens_out"


def _counters(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (k * 7919 % 300000).alias("wall_us"), (k % 50).alias("db_probes"), (k * 31 % 9000).alias("rows_scanned"), (k * 65537 % 33554432).alias("bytes_alloc"), (k % 4).alias("hops"), (k % 400).alias("tokens_out"))


@register("envelope_check", f"WITH w AS (SELECT o_orderkey, {_COUNT} FROM orders) SELECT o_orderkey, CAST(floor(db_probes * 150.0 + rows_scanned * 0.25 + bytes_alloc * 0.5 / 1024 + hops * 200.0 + tokens_out * 5.0) AS BIGINT) AS estimate, CAST(CASE WHEN wall_us > 100000 THEN 1 WHEN db_probes > 8 THEN 2 WHEN rows_scanned > 4096 THEN 3 WHEN bytes_alloc > 16777216 THEN 4 WHEN hops > 2 THEN 5 WHEN tokens_out > 256 THEN 6 ELSE 0 END AS INT) AS exceeded FROM w")
def envelope_check(spark, sf_dir):
    return _counters(spark, sf_dir).select("o_orderkey", E.estimate_us().cast("bigint").alias("estimate"), E.exceeded("FAST").alias("exceeded"))


@register("envelope_merge", f"WITH w AS (SELECT o_orderstatus, o_orderkey, {_COUNT} FROM orders) SELECT o_orderstatus, CAST(sum(wall_us) AS BIGINT) AS wall_us, CAST(sum(hops) AS BIGINT) AS hops, max(CAST(o_orderkey % 97 = 0 AS INT)) AS truncated, CAST(coalesce(arg_min(o_orderkey % 5, o_orderkey) FILTER (o_orderkey % 5 <> 0), 0) AS INT) AS reason FROM w GROUP BY o_orderstatus")
def envelope_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = _counters(spark, sf_dir).withColumns({"truncated": (k % 97 == 0).cast("int"), "reason": (k % 5).cast("int"), "ord": k})
    m = E.merged(rows, ["o_orderstatus"])
    return m.select("o_orderstatus", F.col("wall_us").cast("bigint").alias("wall_us"), F.col("hops").cast("bigint").alias("hops"), "truncated", "reason")
