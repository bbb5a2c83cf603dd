"""The trie of conversations: which turns many of them start with, and what storing those once saves.

Turns are digests of role and text from the start; a prefix of turns is named by the running digest of its turns, so a node is
one row however many conversations pass it, copies of a conversation add to counts alone, and no conversation is ever held whole.

Nodes are dealt by a hash of their first turn's digest to groups of bounded size. In each, applyInPandas points children from
their parents' dictionaries and sums the subtries in an iterative postorder. A first turn with too many nodes for that is taken
apart: the turns that all of its conversations share are a chain, which stays with Spark, and the subtries below are dealt by the
next turn; so on, until no subtrie is too large. Sums of the subtries then go up the chains.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import fold_of, split_join, stored, table, whole_text

#: Nodes to a group, about, and of one first turn (or next turn) before it is taken apart.
GROUP, LARGE = 20_000, 20_000
#: Conversations between a base and the next, and the most turns that a conversation takes from its base, plus one.
BASES, FOLDS = 100, 6
#: Ids that are packed into one piece of what is hashed.
PACKED = 4096
#: Bytes of a digest that name a turn or a prefix.
NAME = 16

_NODE = "prefix binary, parent binary, conv_id bigint, depth int, n_convs bigint"
_PREFIXES = "conv_id bigint, depth int, prefix binary, parent binary, first binary, chars int, last boolean"


def _digest(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, NAME)


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, turn, chars, length) of the rebuilt conversations, and the conversations (conv_id, length), empty ones included."""
    role, text = whole_text("role"), whole_text("text")
    own = df.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", _digest(role, text).alias("digest"), F.char_length(text).alias("chars"))
    all_of = Window.partitionBy("conv_id")
    turns = stored(own.select("conv_id", F.row_number().over(all_of.orderBy(F.col("turn").asc_nulls_first(), "digest")).alias("at"), F.count("*").over(all_of).alias("times"), F.col("digest").alias("turn"), "chars"))
    heads = turns.where(f"at < {FOLDS} and conv_id % {BASES} = 0").select(F.col("conv_id").alias("base"), "at", "turn", "chars")
    convs = turns.where("at = 1").select("conv_id", "times", fold_of("conv_id", FOLDS).alias("h"), F.expr(f"conv_id - conv_id % {BASES}").alias("base"))
    convs = convs.join(heads.groupBy("base").agg(F.max("at").alias("there")), "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.withColumn("length", (F.col("taken") + F.greatest(F.col("times") - F.col("h"), F.lit(0))).cast("int")))
    columns = ["conv_id", F.col("at").cast("int").alias("depth"), "turn", "chars", "length"]
    borrowed = convs.join(heads, "base").where("at <= taken").select(*columns)
    tails = split_join(turns.drop("times"), convs, ["conv_id"], "times", turns.count()).where("at > h").withColumn("at", F.expr("at - h + taken")).select(*columns)
    return borrowed.unionByName(tails), convs.select("conv_id", "length")


def _prefixes(batches):
    conv, running, first, parent = None, None, b"", b""
    for batch in batches:
        made, parents, firsts = [], [], []
        for c, turn in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if c != conv:
                conv, running, parent, first = c, hashlib.sha256(), b"", None
            running.update(turn)
            name = running.copy().digest()[:NAME]
            first = first or name
            made.append(name)
            parents.append(parent)
            firsts.append(first)
            parent = name
        columns = [pa.array(x, pa.binary()) for x in (made, parents, firsts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, batch.column(3), batch.column(4)], names=["conv_id", "depth", "prefix", "parent", "first", "chars", "last"])


def _packed(batches):
    """Rising ids of each prefix, joined by commas into pieces; `least` is the first of a piece."""
    name, ids = None, []
    for batch in batches:
        out = []
        for prefix, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if prefix != name or len(ids) == PACKED:
                if ids:
                    out.append((name, ids[0], ",".join(map(str, ids))))
                name, ids = prefix, []
            ids.append(conv)
        yield _pieces(out)
    if ids:
        yield _pieces([(name, ids[0], ",".join(map(str, ids)))])


def _pieces(rows):
    kinds = (("prefix", pa.binary()), ("least", pa.int64()), ("ids", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _hashed(batches):
    """The SHA-256 of each prefix's pieces, which come in order; one running digest is held."""
    name, running = None, None
    for batch in batches:
        out = []
        for prefix, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if prefix != name:
                if running:
                    out.append((name, running.hexdigest()))
                name, running = prefix, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _digests(out)
    if running:
        yield _digests([(name, running.hexdigest())])


def _digests(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["prefix", "ends_sha256"])


def _subtries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtries of a group; nodes whose parent isn't in the group are its tops."""
    names, parents, convs = pdf["prefix"].tolist(), pdf["parent"].tolist(), pdf["conv_id"].tolist()
    place = {name: i for i, name in enumerate(names)}
    pointers: list[dict] = [{} for _ in names]
    above = [place.get(parent) for parent in parents]
    for i, at in enumerate(above):
        if at is not None:
            pointers[at][names[i]] = i
    leaves, saved = [0] * len(names), [(n - 1) * c for n, c in zip(pdf["n_convs"].tolist(), pdf["chars"].tolist())]
    stack = [(i, False) for i, at in enumerate(above) if at is None]
    while stack:
        i, below_done = stack.pop()
        if not below_done:
            stack.append((i, True))
            stack.extend((child, False) for child in pointers[i].values())
            continue
        if not pointers[i]:
            leaves[i] = 1
        if above[i] is not None:
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    own = pdf[["prefix", "parent", "conv_id", "depth", "n_convs"]]
    return own.assign(parent_conv_id=pd.array([None if at is None else convs[at] for at in above], dtype="Int64"), n_children=[len(p) for p in pointers], n_leaves=leaves, saved_tokens=saved)


def _built(nodes: DataFrame, size: int) -> DataFrame:
    groups = -(-nodes.count() // size) or 1
    dealt = nodes.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    made = f"{_NODE}, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    return stored(dealt.groupBy("group").applyInPandas(lambda pdf: _subtries(pdf), made))


def _summed(chain: DataFrame, tops: DataFrame | None) -> DataFrame:
    """Nodes of chains with their sums; `tops` are the nodes right below the lowest one of each chain."""
    if tops is None:
        chain = chain.withColumns({c: F.lit(None).cast("bigint") for c in ("kids", "kid_leaves", "kid_saved")})
    else:
        kids = tops.groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("kid_leaves"), F.sum("saved_tokens").alias("kid_saved"))
        chain = chain.join(kids, "prefix", "left")
    up = Window.partitionBy("key").orderBy(F.col("depth").desc())
    down = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lowest = F.row_number().over(up) == 1
    return stored(
        chain.select(
            "prefix", "parent", "conv_id", "depth", "n_convs",
            F.lead("conv_id").over(up).alias("parent_conv_id"),
            F.when(lowest, F.coalesce("kids", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"),
            F.coalesce(F.sum("kid_leaves").over(down), F.lit(1)).alias("n_leaves"),
            F.sum((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("kid_saved", F.lit(0))).over(down).alias("saved_tokens"),
            lowest.alias("lowest"),
        )
    )


def trie(df: DataFrame, group: int = GROUP, large: int = LARGE) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations, from the root (depth 0), as the contract of op11 names the columns.

    Null roles and texts are empty, a null turn comes first; turns of the same number are ordered by a digest of role and text,
    repeated rows stay. Rows without a conv_id take no part. A conversation that is left without turns ends at the root.
    Other columns are not looked at. No rows: no nodes.
    """
    turns, convs = rebuilt(df)
    ordered = turns.select("conv_id", "depth", "turn", "chars", (F.col("depth") == F.col("length")).alias("last")).repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    prefixes = stored(ordered.mapInArrow(_prefixes, _PREFIXES))
    nodes = prefixes.groupBy("prefix").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("first").alias("key"))
    empty = F.lit(b"")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(empty.alias("prefix"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).alias("depth"), "n_convs", F.lit(0).alias("chars"), empty.alias("key"))
    chains, built, open_ = [stored(root)], [None], stored(nodes)
    while True:
        sizes = stored(open_.groupBy("key").agg(F.count("*").alias("n")))
        # keys above this are 100,000 at most
        bound = max(large, open_.count() // 100_000)
        hot = sizes.where(F.col("n") > bound).select("key")
        built.append(_built(open_.join(F.broadcast(hot), "key", "left_anti"), group))
        if hot.isEmpty():
            break
        big = stored(open_.join(F.broadcast(hot), "key"))
        forks = stored(big.groupBy("key", "depth").agg(F.count("*").alias("n")).where("n > 1").groupBy("key").agg(F.min("depth").alias("fork")))
        met = big.join(F.broadcast(forks), "key", "left")
        chains.append(stored(met.where("fork is null or depth < fork").drop("fork")))
        below = met.where("depth >= fork").drop("key")
        names = prefixes.select("conv_id", F.col("depth").alias("fork"), F.col("prefix").alias("key"))
        open_ = stored(below.join(names, ["conv_id", "fork"]).drop("fork"))
    out, tops = [], None
    for chain, own in list(zip(chains + [None], built))[::-1]:
        if chain is not None:
            chain = _summed(chain, tops)
            if out:
                low = F.broadcast(chain.where("lowest").select(F.col("prefix").alias("parent"), F.col("conv_id").alias("_above")))
                out[-1] = out[-1].join(low, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).drop("_above")
        made = [x for x in (chain.drop("lowest") if chain is not None else None, own) if x is not None]
        level = made[0] if len(made) == 1 else made[0].unionByName(made[1])
        tops = level.where("parent_conv_id is null")
        out.append(level)
    ends = prefixes.where("last").select("prefix", "conv_id").unionByName(convs.where("length = 0").select(empty.alias("prefix"), "conv_id"))
    pieces = ends.repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id").mapInArrow(_packed, "prefix binary, least bigint, ids string")
    hashes = pieces.repartition("prefix").sortWithinPartitions("prefix", "least").mapInArrow(_hashed, "prefix binary, ends_sha256 string")
    found = out[0].select("prefix", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    for level in out[1:]:
        found = found.unionByName(level.select(*found.columns))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(hashes, "prefix", "left").withColumns({"ends_sha256": F.coalesce("ends_sha256", none), "depth": F.col("depth").cast("bigint")}).drop("prefix")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = f"""
with own as (select conv_id, turn, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))[:{2 * NAME}] as digest, length(coalesce(text, '')) as chars
    from conversations where conv_id is not null),
turns as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as pos from own),
convs as (select distinct conv_id, conv_id - conv_id % {BASES} as base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % {FOLDS} as h from own),
made as (select c.conv_id, 0 as part, t.pos, t.digest, t.chars from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
    union all select c.conv_id, 1, t.pos, t.digest, t.chars from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
rebuilt as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, chars, count(*) over (partition by conv_id) as length,
    sha256(string_agg(digest, '') over (partition by conv_id order by part, pos)) as prefix from made),
paths as (select *, coalesce(lag(prefix) over (partition by conv_id order by depth), '') as parent from rebuilt
    union all select conv_id, 0, 0, coalesce(length, 0), '', null from convs left join (select distinct conv_id, length from rebuilt) using (conv_id)),
nodes as (select prefix, any_value(parent) as parent, any_value(depth) as depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (where length = depth) as ends from paths group by prefix),
kids as (select parent, count(*) as n from nodes group by parent),
flat as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k on k.parent = n.prefix),
sums as (select p.prefix, sum((f.n_children = 0)::int) as n_leaves, sum((f.n_convs - 1) * f.chars) as saved_tokens
    from flat f join paths p on p.conv_id = f.conv_id and p.depth <= f.depth group by p.prefix)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
from flat f join sums s using (prefix) left join nodes u on u.prefix = f.parent
"""
