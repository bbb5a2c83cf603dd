"""Strong components without a closure and the best-first search, against plain Python over random graphs."""

import heapq
import random

import pytest

from tesserae.operators import graphs as G


def components(edges, nodes):
    """Tarjan's answer by double reachability, small graphs only."""
    to = {n: set() for n in nodes}
    for a, b in edges:
        to[a].add(b)
    seen = {}
    for n in nodes:
        found, stack = {n}, [n]
        while stack:
            for m in to[stack.pop()] - found:
                found.add(m)
                stack.append(m)
        seen[n] = found
    return {n: min(m for m in seen[n] if n in seen[m]) for n in nodes}


def groups(spark, edges, nodes):
    e = spark.createDataFrame(edges, "parent bigint, child bigint").repartition(4)
    n = spark.createDataFrame([(x,) for x in nodes], "node bigint")
    got = G.strong_groups(e, n).collect()
    assert len(got) == len(nodes)
    return {r.node: r.component for r in got}


@pytest.mark.parametrize(("n", "m"), [(40, 45), (60, 140)])
def test_random_graphs(spark, n, m):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    assert groups(spark, edges, range(n + 2)) == components(edges, range(n + 2))


def test_long_chain_and_cycle(spark):
    """A chain of 20,000 nodes into a cycle of 4,000, with a shortcut that closes nothing and one that closes a part of the chain."""
    n, c = 10_000, 2_000
    edges = [(i, i + 1) for i in range(n)] + [(n + i, n + (i + 1) % c) for i in range(c)] + [(5, 9_000), (700, 500)]
    got = groups(spark, edges, range(n + c))
    assert all(got[i] == (500 if 500 <= i <= 700 else i) for i in range(n)) and {got[n + i] for i in range(c)} == {n}


def test_no_edges(spark):
    assert groups(spark, [], [3, 1]) == {3: 3, 1: 1}
    assert groups(spark, [(1, 1)], [1]) == {1: 1}


def dijkstra(edges, sources):
    to = {}
    for a, b, cost, _ in edges:
        to.setdefault(a, []).append((b, cost))
    done, heap = {}, [(0.0, s) for s in sources]
    while heap:
        cost, n = heapq.heappop(heap)
        if n not in done:
            done[n] = cost
            for b, step in to.get(n, []):
                heapq.heappush(heap, (cost + step, b))
    return done


@pytest.mark.parametrize("width", [9.0, 1000.0])
def test_pull_in_steps(spark, width):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(12)), rng.randrange(1000)) for _ in range(150)]
    e = spark.createDataFrame(edges, "parent bigint, child bigint, cost double, claim bigint")
    want = dijkstra(edges, [0, 1])
    state = G.started(spark.createDataFrame([(0,), (1,)], "node bigint"))
    limit = sorted(want.values())[len(want) // 2]
    state = G.pulled(state, e, until=limit, width=width)
    rows = {r.node: r for r in state.collect()}
    assert {n: r.cost for n, r in rows.items() if r.closed} == {n: c for n, c in want.items() if c <= limit}
    assert all(r.cost >= want[n] for n, r in rows.items())
    # closed entities refuse, open and new ones take what is cheaper
    closed = next(n for n, r in rows.items() if r.closed and r.cost > 0)
    open_ = next(n for n, r in rows.items() if not r.closed)
    offers = spark.createDataFrame([(closed, 0.0, 1, 0, 1), (open_, 0.5, 1, 0, 1), (open_, 0.5, 1, 0, 0), (99, 3.0, 1, 0, 1)], "node bigint, cost double, hops int, previous bigint, claim bigint")
    after = {r.node: r for r in G.offered(state, offers).collect()}
    assert after[closed] == rows[closed] and after[99].cost == 3.0
    assert (after[open_].cost, after[open_].claim) == (0.5, 0)
    whole = {r.node: r for r in G.pulled(state, e, width=width).collect()}
    assert {n: r.cost for n, r in whole.items()} == want and all(r.closed for r in whole.values())
    steps = {}
    for a, b, cost, claim in edges:
        steps.setdefault((a, b, claim), []).append(cost)
    for n, r in whole.items():
        if r.previous is not None:
            assert any(whole[r.previous].cost + c == r.cost for c in steps[r.previous, n, r.claim])


def test_guesses_close_less(spark):
    """On a line of both ways, a guess of what is left to 30 closes nothing behind the source."""
    edges = [(i, i + 1, 1.0, i) for i in range(60)] + [(i + 1, i, 1.0, i) for i in range(60)]
    e = spark.createDataFrame(edges, "parent bigint, child bigint, cost double, claim bigint")
    guesses = spark.createDataFrame([(i, float(abs(30 - i))) for i in range(61)], "node bigint, guess double")
    source = spark.createDataFrame([(20,)], "node bigint")
    found = {r.node: r.cost for r in G.pulled(G.started(source, guesses), e, until=10.0, width=1.0, guesses=guesses).where("closed").collect()}
    assert found == {i: float(i - 20) for i in range(20, 31)}
