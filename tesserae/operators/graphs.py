"""Directed graphs as edge tables (parent, child, ...): levels, order, path counts, strong components, cheapest chains.

Each works by rounds of joins, of levels and paths one for each level of depth. A round is checkpointed or written as a table so
that plans don't grow, in the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.checkpoints import cut, written


class CycleError(ValueError):
    """The graph isn't acyclic."""


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the longest way down to a leaf, edges counting their `distance`. Raises CycleError.

    Leaves are peeled off: a node gets its level in the round after the last of its children.
    """
    e = edges.select("parent", "child", F.col("distance").cast("bigint").alias("distance"))
    done = cut(nodes.select("node").join(e.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(0).cast("bigint")))
    left = cut(e)
    fresh = done
    while left.limit(1).count():
        known = cut(left.join(done.select(F.col("node").alias("child"), "level"), "child", "left"))
        ready = known.groupBy("parent").agg(F.max(F.col("level") + F.col("distance")).alias("level"), F.max(F.col("level").isNull().cast("int")).alias("waits")).where("waits = 0").select(F.col("parent").alias("node"), "level")
        fresh = cut(ready)
        if not fresh.limit(1).count():
            raise CycleError("a cycle is reachable")
        done = cut(done.union(fresh))
        left = cut(known.select("parent", "child", "distance").join(fresh.select(F.col("node").alias("parent")), "parent", "left_anti"))
    return done


def order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, wave): parents before children; a node is one wave behind the last of its parents. Raises CycleError."""
    turned = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(1).alias("distance"))
    return levels(turned, nodes).select("node", F.col("level").alias("wave"))


def path_counts(edges: DataFrame, tops: DataFrame, depth: int = 10_000) -> DataFrame:
    """(top, node, paths): ways from each top to each node it reaches, edges counting `times`; exact to 38 digits.

    Mass moves one level a round and only from what the last round reached, so work is each top's own reach. A top has
    one way to itself. Raises CycleError when mass still moves after as many rounds as there are nodes.
    """
    e = edges.select("parent", "child", F.col("times").cast("decimal(20,0)").alias("times"))
    moving = cut(tops.select(F.col("node").alias("top"), "node").distinct().withColumn("paths", F.lit(1).cast("decimal(38,0)")))
    total, rounds = moving, 0
    bound = min(depth, e.select("parent").distinct().count() + 1)
    while moving.limit(1).count():
        if rounds > bound:
            raise CycleError("a cycle is reachable")
        step = moving.join(e, moving.node == e.parent).groupBy("top", "child").agg(F.sum((F.col("paths") * F.col("times")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("paths"))
        moving = cut(step.withColumnRenamed("child", "node"))
        total = total.unionByName(moving)
        rounds += 1
    return total.groupBy("top", "node").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))


def strong_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): mutually reachable nodes share their least node. No closure is stored; no round makes more edges than it had.

    Nodes that nothing enters or nothing leaves are components by themselves and are dropped. A node with one parent is on no cycle
    that misses the parent, so it is merged into it, and later split off again unless something it leads to is in the
    parent's component; likewise a node with one child. A coin decides who is merged, so that no node merges into one that
    merges itself: chains and cycles shrink by a third or so each round, whatever their length. Where neither makes
    progress, each node takes the least label that reaches it; labels that stay with their own node are pivots, all at
    once, and what reaches a pivot within its label is its component.
    """
    left = written(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).where("a <> b").distinct())
    merged, groups, number = [], [], 0
    while not left.isEmpty():
        number += 1
        before = left.count()
        into, out = left.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("ins"), F.min("a").alias("up")), left.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("outs"), F.min("b").alias("down"))
        degrees = into.join(out, "node", "full")
        ends = written(degrees.where("ins is null or outs is null").select("node"))
        if not ends.isEmpty():
            left = _without(left, ends)
            degrees = degrees.join(ends, "node", "left_anti")
        heads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(number)), F.lit(2)) == 1
        up, down = (F.col("ins") == 1) & ~heads("up"), (F.col("outs") == 1) & ~heads("down")
        gone = written(degrees.where(heads("node") & (up | down)).select("node", F.when(up, F.col("up")).otherwise(F.col("down")).alias("into"), up.alias("by_parent")))
        # degrees are those before the ends went: what would merge into one waits
        gone = written(gone.join(ends.withColumnRenamed("node", "into"), "into", "left_anti"))
        if not gone.isEmpty():
            # what a merged node leads to, or what leads to it, in the terms of the next round
            mapped = left
            for side in ("a", "b"):
                mapped = mapped.join(gone.select(F.col("node").alias(side), F.col("into").alias(f"{side}_into")), side, "left").withColumn(f"{side}_next", F.coalesce(f"{side}_into", side))
            mapped = written(mapped.select("a", "b", "a_next", "b_next"))
            parents = gone.where("by_parent").join(mapped.withColumnRenamed("a", "node"), "node").select("node", "into", F.col("b_next").alias("other"))
            children = gone.where("not by_parent").join(mapped.withColumnRenamed("b", "node"), "node").select("node", "into", F.col("a_next").alias("other"))
            merged.append(written(parents.union(children).distinct()))
            left = mapped.select(F.col("a_next").alias("a"), F.col("b_next").alias("b")).where("a <> b").distinct()
        left = written(left)
        if left.count() > 0.9 * before:
            found = _pivots(left)
            groups.append(found)
            left = written(_without(left, found))
    own = groups[0] if groups else None
    for g in groups[1:]:
        own = own.union(g)
    known = nodes.select("node") if own is None else nodes.select("node").join(own, "node", "left")
    known = written(known.select("node", F.coalesce(F.col("component") if own is not None else F.lit(None), F.col("node")).alias("component")))
    for pairs in reversed(merged):
        a, b = (known.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("into", "ci"), ("other", "co")))
        kept = pairs.join(a, "into").join(b, "other").groupBy("node").agg(F.max(F.when(F.col("ci") == F.col("co"), F.col("ci"))).alias("c"))
        known = written(known.join(kept, "node", "left").select("node", F.coalesce("c", "component").alias("component")))
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(side)), side, "left_anti")
    return edges


def _pivots(edges: DataFrame) -> DataFrame:
    """(node, component) for the components of all nodes that keep their own label when each takes the least that reaches it."""
    label = F.xxhash64("node")  # labels in no order, so that long runs of falling ids don't hand labels on one by one
    marks = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("mark", F.struct(label.alias("h"), F.col("node").alias("pivot"))))
    fresh = marks
    while not fresh.isEmpty():
        offers = fresh.join(edges, fresh.node == edges.a).groupBy(F.col("b").alias("node")).agg(F.min("mark").alias("offer"))
        fresh = written(offers.join(marks, "node").where("offer < mark").select("node", F.col("offer").alias("mark")))
        marks = written(marks.join(fresh.withColumnRenamed("mark", "new"), "node", "left").select("node", F.coalesce("new", "mark").alias("mark")))
    marks = written(marks.select("node", F.col("mark.pivot").alias("component")))
    within = edges.join(marks.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(marks.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    within = written(within.where("ca = cb").select("a", "b"))
    found = written(marks.where("node = component"))
    fresh = found
    while not fresh.isEmpty():
        back = within.join(fresh.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component").distinct()
        fresh = written(back.join(found, "node", "left_anti"))
        found = written(found.union(fresh))
    return found


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, rank): mutually reachable nodes share their least node; rank puts dependencies before consumers."""
    own = cut(strong_groups(edges, nodes))
    a, b = (own.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("parent", "p"), ("child", "c")))
    condensed = edges.select("parent", "child").join(a, "parent").join(b, "child").where("p <> c").select(F.col("p").alias("parent"), F.col("c").alias("child"), F.lit(1).alias("distance")).distinct()
    ranks = levels(condensed, own.select(F.col("component").alias("node")).distinct())
    return own.join(ranks.select(F.col("node").alias("component"), F.col("level").alias("rank")), "component").select("node", "component", "rank")


#: What a search has reached: open entities may still get cheaper, closed ones refuse every offer.
REACHED = "node bigint, cost double, guess double, hops int, previous bigint, claim bigint, closed boolean"


def started(sources: DataFrame, guesses: DataFrame | None = None) -> DataFrame:
    """The state of a search that has reached its sources, rows (node), at no cost."""
    none = F.lit(None).cast("bigint")
    offers = sources.select(F.col("node").cast("bigint").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), none.alias("previous"), none.alias("claim")).distinct()
    return written(_guessed(offers, guesses).withColumn("closed", F.lit(False)).select("node", "cost", "guess", "hops", "previous", "claim", "closed"))


def _guessed(rows: DataFrame, guesses: DataFrame | None) -> DataFrame:
    if guesses is None:
        return rows.withColumn("guess", F.lit(0.0))
    return rows.join(guesses.select("node", F.col("guess").cast("double").alias("guess")), "node", "left").na.fill(0.0, ["guess"])


def offered(state: DataFrame, offers: DataFrame, guesses: DataFrame | None = None) -> DataFrame:
    """`state` after offers (node, cost, hops, previous, claim): the cheapest of each node, ties by fewer hops, lesser previous node and lesser claim.

    An offer is taken where the node is new, or open and strictly dearer; a closed node refuses even a cheaper one.
    """
    best = offers.groupBy("node").agg(F.min(F.struct("cost", "hops", "previous", "claim")).alias("o")).select("node", "o.*")
    met = _guessed(best, guesses).join(state.select("node", F.col("cost").alias("had"), "closed"), "node", "left").where("had is null or not closed and cost < had")
    taken = written(met.withColumn("closed", F.lit(False)).select("node", "cost", "guess", "hops", "previous", "claim", "closed"))
    return written(state.join(taken.select("node"), "node", "left_anti").unionByName(taken))


def pulled(state: DataFrame, edges: DataFrame, until: float | None = None, width: float | None = None, guesses: DataFrame | None = None) -> DataFrame:
    """`state` with all entities closed whose order, the cost and a guess of what is left, is at most `until`; all reachable ones if None.

    edges are (parent, child, cost >= 0, claim). Entities are closed by buckets of orders, from the least open order to
    `width` above it; by default the mean cost of an edge. In a bucket, edges are followed until no order in it falls; then it is
    closed as a whole. With guesses that never exceed the cost of an edge by their difference, that gives the costs of
    taking the least order one by one. The state can be pulled again, further or over more edges.
    """
    step = edges.select(F.col("parent").alias("node"), "child", F.col("cost").cast("double").alias("step"), F.col("claim").cast("bigint").alias("via"))
    if width is None:
        width = edges.agg(F.avg("cost")).first()[0] or 1.0
    order = F.col("cost") + F.col("guess")
    limit = F.lit(True) if until is None else order <= until
    while True:
        least = state.where(~F.col("closed") & limit).agg(F.min(order)).first()[0]
        if least is None:
            return state
        bucket = ~F.col("closed") & limit & (order <= least + width)
        fresh = written(state.where(bucket))
        while not fresh.isEmpty():
            offers = fresh.join(step, "node").select(F.col("child").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("previous"), F.col("via").alias("claim"))
            after = offered(state, offers, guesses)
            changed = after.where(bucket).join(state.select("node", F.col("cost").alias("had")), "node", "left").where("had is null or cost < had").drop("had")
            fresh, state = written(changed), after
        state = written(state.withColumn("closed", F.col("closed") | bucket))


def cheapest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, cost, hops, previous, claim): least cost from any source along edges (parent, child, cost >= 0, claim), ties as offered() has them."""
    return pulled(started(sources), edges).select("node", "cost", "hops", "previous", "claim")
