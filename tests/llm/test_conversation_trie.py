"""The conversation trie against one built turn by turn, whole and taken apart into very small subtries."""

import hashlib
import random
import zlib

import pytest

from tesserae.llm import conversation_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, prefix string, key string, depth string, chars string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[: T.NAME]


def brute_force(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        hashed = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids.get(node, [])), sum(m not in kids for m in below), saved, hashed))
    return sorted(out, key=str)


def planted():
    rng = random.Random(11)
    say = [(rng.choice(["user", "assistant", None]), "".join(rng.choice("aé😀 ") for _ in range(rng.randrange(9)))) for _ in range(5)]
    rows = []
    for c in [*range(40), *range(100, 160), *range(230, 260), 1000]:
        rows += [(c, t if t else None, *rng.choice(say[: 1 + t])) for t in range(rng.randrange(1, 8))]
    for c in range(300, 340):  # copies, and one long conversation twice, different at its end
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    for c in (402, 403):
        rows += [(c, t, "user", f"long {t}") for t in range(60)] + [(c, 60, "user", f"end {c}")]
    return rows + rows[:9] + [(None, 1, "user", "lost"), (700, 0, None, None)]


@pytest.mark.parametrize("large", [1, 5, 20_000])
def test_nodes(spark, large):
    rows = planted()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    made = T.trie(df, group=min(large, 30), large=large)
    got = sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in made.collect()), key=str)
    assert got == brute_force(rows)


def test_no_rows(spark):
    assert T.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "", "")], SCHEMA)).collect() == []


def test_ids_in_pieces(spark):
    n = 2 * T.PACKED + 7
    df = spark.createDataFrame([(c, "r", "t") for c in range(n)], "conv_id bigint, role string, text string").selectExpr("conv_id", "0 as turn", "role", "text")
    rows = {r.depth: r for r in T.trie(df).collect()}
    # every base has one turn: a conversation takes it, or keeps its own equal one
    assert rows[1].n_convs == n and rows[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
