"""Queries over texts, registries, codepoints, JSON and binary forms."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserae.functions import codepoints as U
from tesserae.functions import identity as I
from tesserae.functions import json_values as J
from tesserae.functions import tensors as Q
from tesserae.operators import json_nodes as N
from tesserae.operators import paths as P
from tesserae.operators import registry as R
from tesserae.operators import text as X
from tesserae.operators.checkpoints import cut, shared_folder
from tesserae.operators.decompose import composed, decomposed
from tesserae.operators.fingerprints import fingerprints
from tesserae.operators.order import numbered
from tesserae.plans.catalogue import register
from tesserae.sources import containers, wire
from tesserae.sources import tensor_files as tensor_files_source
from tesserae.sources.tables import event_sequences, table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


# word segments of Latin text: letters and digits together, blanks together, all else by itself; lone line breaks are blanks
_BLANKED = "coalesce(text, '')"
for _break, _blanks in ((r"\r\n", "  "), (r"[\n\r]", " ")):
    for _ in range(2):  # neighbours share a character, so every other one is found at a time
        _BLANKED = rf"regexp_replace({_BLANKED}, '([^\n\r \t][ \t]*){_break}([ \t]*[^\n\r \t])', '\1{_blanks}\2', 'g')"
_SEGMENTS = rf"regexp_extract_all({_BLANKED}, '[0-9A-Za-zªµºÀ-ÖØ-öø-ÿ]+| +|\r\n|(?s:.)')"


@register("text_segments", f"SELECT doc_id AS key, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_transform(s, lambda x: octet_length(encode(x))), ',')) AS lengths FROM (SELECT doc_id, {_SEGMENTS} AS s FROM documents WHERE text <> '')")
def text_segments(spark, sf_dir):
    """How many segments each document has, and a digest of their lengths in order."""
    s = X.segment_lists(_documents(spark, sf_dir), "key", "text", ids=False)
    return s.select("key", F.size("lengths").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",").cast("binary")).alias("lengths"))


@register("text_realized", "SELECT doc_id AS key, md5(text) AS digest FROM documents WHERE text <> ''")
def text_realized(spark, sf_dir):
    """Decomposed to edges, kept once each, and put together again."""
    d = _documents(spark, sf_dir).where("text <> ''")
    back = X.realized_packed(X.packed(d, "key", "text"), "key")
    return back.select("key", F.md5(F.col("text").cast("binary")).alias("digest"))


@register("text_ids", "SELECT md5(text) AS first, md5(text) AS last, count(*) AS n FROM conversations WHERE text <> '' GROUP BY text")
def text_ids(spark, sf_dir):
    """Turns by id: those of one id have one text, and those of one text one id."""
    ids = X.text_ids(table(spark, sf_dir, "conversations").where("text <> ''").select("text"), "text", "text")
    digest = F.md5(F.col("text").cast("binary"))
    return ids.groupBy("id").agg(F.min(digest).alias("first"), F.max(digest).alias("last"), F.count("*").alias("n")).drop("id")


_GOLDEN = {"A": "32684bfa28c0c84d6f210511aace0efc", "Holmes": "5b7e40e9a23ae55eaccd45646934977d"}


@register("golden_ids", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{i}', '{i}')" for t, i in _GOLDEN.items()) + ") v(text, tree, flat)")
def golden_ids(spark, sf_dir):
    """Published ids of texts, as trees and as flat sequences (for words without repeats the same)."""
    t = X.text_ids(spark.createDataFrame([(t,) for t in _GOLDEN], "text string"), "text", "text")
    return t.select("text", F.lower(F.hex("id")).alias("tree"), F.lower(F.hex(I.id_of_text_column(F.col("text")))).alias("flat"))


@register("text_entities", None)
def text_entities(spark, sf_dir):
    e = X.text_entities(_documents(spark, sf_dir), "text")
    return e.groupBy("tier").agg(F.count("*").alias("entities"), F.sum("parts").alias("parts"), F.sum("vertices").alias("vertices"))


def _points(spark):
    return U.build(spark).where("not cp between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("cp"), 8, "0")), "UTF-32").alias("letter"), "m0", "m1", "m2", "m3")


@register("text_places", None)
def text_places(spark, sf_dir):
    """Where the texts of `benchmark` lie, by the codepoint table's coordinates."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    points = _points(spark)
    return X.text_ids(b, "key", "text").join(X.placed(X.edges(b, "text"), points).withColumnRenamed("node", "id").drop("tier"), "id").select("key", "tier", "m0", "m1", "m2", "m3")


@register("text_letters", "SELECT unicode(ch) AS cp, ch FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')")
def text_letters(spark, sf_dir):
    """The codepoints that all documents come down to."""
    return X.letters(_documents(spark, sf_dir), "text").select(F.expr("ascii(letter)").alias("cp"), F.col("letter").alias("ch"))


@register("codepoint_ids", "SELECT event_type AS first, event_type AS last, count(*) AS n FROM events GROUP BY event_type")
def codepoint_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", I.id_of_text_column(F.col("event_type")).alias("id"))
    return e.groupBy("id").agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"), F.count("*").alias("n")).drop("id")


_PATHS = "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id"


@register("composed_paths", f"SELECT user_id AS seq, min(user_id) OVER (PARTITION BY path) AS twin FROM ({_PATHS})")
def composed_paths(spark, sf_dir):
    """Each user's sequence composed from the ids of its members, with the least user that has the same: equal sequences have equal ids."""
    ids = _composed(table(spark, sf_dir, "events"))
    return ids.join(ids.groupBy("id").agg(F.min("seq").alias("twin")), "id").select("seq", "twin")


@register("composed_paths_whole", f"SELECT count(DISTINCT path) AS ids FROM ({_PATHS})")
def composed_paths_whole(spark, sf_dir):
    return _composed(table(spark, sf_dir, "events")).agg(F.countDistinct("id").alias("ids"))


def _composed(events):
    own = events.select(F.col("user_id").alias("seq"), F.struct("ts", "event_id").alias("ord"), I.id_of_text_column(F.col("event_type")).alias("id"))
    whole = own.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    return whole.select("seq", I.compose_column(F.col("ids")).alias("id"))


@register("hex_ids", "SELECT doc_id, lower(hex(encode(text))) AS hex, text FROM documents")
def hex_ids(spark, sf_dir):
    """Whole texts in hexadecimal and back."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(F.encode("text", "UTF-8"))).alias("hex"))
    return h.select("doc_id", "hex", F.decode(F.unhex("hex"), "UTF-8").alias("text"))


@register("decimal_digits", "SELECT o_orderkey, CAST(o_orderkey * 37 - 50000 AS VARCHAR) AS digits FROM orders")
def decimal_digits(spark, sf_dir):
    """Whole numbers are compositions of digits; the digits of the tree are the number's."""
    from tesserae.functions import segments as S

    @F.pandas_udf("string")
    def digits(v: pd.Series) -> pd.Series:
        store = I.Composer()
        return v.map(lambda x: S.realize(S.integer(int(x), store), store))

    return table(spark, sf_dir, "orders").select("o_orderkey", digits(F.col("o_orderkey") * 37 - 50000).alias("digits"))


_CP = "c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), p AS (SELECT ch, unicode(ch) AS cp FROM c)"
_SHARD = "CASE WHEN cp <= 127 THEN 'ascii' WHEN " + " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in U.CJK) + " THEN 'cjk' WHEN cp <= 65535 AND NOT cp BETWEEN 55296 AND 57343 THEN 'utf' ELSE 'ext' END"


@register("codepoint_shards", f"WITH {_CP} SELECT {_SHARD} AS shard, count(*) AS letters FROM p GROUP BY 1")
def codepoint_shards(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''")
    return c.distinct().select(F.expr("ascii(ch)").alias("cp")).groupBy(U.shard(F.col("cp")).alias("shard")).agg(F.count("*").alias("letters"))


@register("codepoint_table", f"SELECT {_SHARD} AS shard, count(*) AS n, CAST(min(cp) AS INT) AS low, CAST(max(cp) AS INT) AS high, CAST(sum(cp) AS BIGINT) AS ranks, 0::BIGINT AS faults FROM range({U.COUNT}) r(cp) GROUP BY 1")
def codepoint_table(spark, sf_dir):
    """The table of all codepoints, counted by shard, with what is wrong in it: repeated ids or ranks, points outside, keys out of order."""
    t = cut(U.build(spark))
    f = U.faults(t).select((F.col("ids") + F.col("ranks") + F.col("outside") + F.col("order")).cast("bigint").alias("faults"))
    shards = U.branch(t, "all").groupBy("shard").agg(F.count("*").alias("n"), F.min("cp").alias("low"), F.max("cp").alias("high"), F.sum("rank").alias("ranks"))
    return shards.crossJoin(F.broadcast(f))


_CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Co".split()


@register("codepoint_properties", f"WITH {_CP} SELECT cp, CASE " + " ".join(rf"WHEN regexp_full_match(ch, '(?s:\p{{{c}}})') THEN '{c}'" for c in _CATEGORIES) + " END AS category, CAST(upper(ch) <> ch AS BOOLEAN) AS lower FROM p")
def codepoint_properties(spark, sf_dir):
    """Category of each codepoint that the documents hold, and whether it has an upper case."""
    c = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    p = c.select("ch", F.expr("ascii(ch)").alias("cp"))
    return p.select("cp", U.properties(F.col("cp"))["category"].alias("category"), (F.upper("ch") != F.col("ch")).alias("lower"))


@register("loose_names", "SELECT p_partkey, regexp_replace(lower(p_name), '[ _-]', '', 'g') AS name FROM part")
def loose_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", U.loose_name(F.col("p_name")).alias("name"))


@register("bit_fields", "SELECT o_orderkey, (o_orderkey * 1000003) % 1048576 AS low, (o_orderkey % 16) AS cross FROM orders")
def bit_fields(spark, sf_dir):
    """Fields out of a 256-bit record, one of them across two words."""
    k = F.col("o_orderkey")
    w0 = (k * 1000003 % 1048576).bitwiseOR(F.shiftleft(k % 4, 62))
    w1 = F.shiftright(k % 16, 2)
    words = [w0, w1.cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")]
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", U.bit_field(words, 0, 20).alias("low"), U.bit_field(words, 62, 4).alias("cross"))


@register("id_map", "SELECT event_type AS id, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS times FROM events GROUP BY event_type")
def id_map(spark, sf_dir):
    """Distinct ids numbered in the order of their first appearance."""
    first = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(F.min("event_id").alias("at"), F.count("*").alias("times"))
    return numbered(first, ["at"]).select("id", "n", "times")


@register("id_index", "SELECT s_suppkey, CAST(count(l_orderkey) AS BIGINT) AS matches FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def id_index(spark, sf_dir):
    """A hash index with repeats, probed: a 1:n join, counted before it joins."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("matches"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.join(found, s.s_suppkey == found.l_suppkey, "left").select("s_suppkey", F.coalesce("matches", F.lit(0)).alias("matches"))


@register("id_contains", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS known FROM customer")
def id_contains(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("k", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(False)).alias("known"))


@register("name_map", "SELECT p_name AS name, min(p_partkey) AS first, CAST(count(*) AS BIGINT) AS parts FROM part GROUP BY p_name")
def name_map(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("parts"))


@register("stable_sort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS place FROM customer")
def stable_sort(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).cast("bigint").alias("place"))


def _slots(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    status = F.when(F.col("n_nationkey") % 7 == 6, "retired").otherwise("live")
    return n.select(F.col("n_nationkey").alias("slot"), F.col("n_name").alias("key"), status.alias("status"))


@register("registry_lookup", "SELECT c_custkey, CASE WHEN c_nationkey % 7 <> 6 THEN n_name END AS key FROM customer JOIN nation ON c_nationkey = n_nationkey")
def registry_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("slot"))
    return R.lookup(c, _slots(spark, sf_dir), ["slot"]).select("c_custkey", "key")


@register("registry_crosswalk", "SELECT s_suppkey, CAST(n_regionkey AS INT) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def registry_crosswalk(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    links = n.select(F.lit("nation").alias("from_list"), F.col("n_nationkey").alias("from_slot"), F.lit("region").alias("to_list"), F.col("n_regionkey").alias("to_slot"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("slot"))
    return R.crosswalk(s, links, "nation", "region").select("s_suppkey", F.col("to_slot").alias("region"))


@register("registry_resolve", "WITH q AS (SELECT DISTINCT left(n_name, 1) AS key FROM nation UNION SELECT left(r_name, 1) || left(r_name, 1) FROM region) SELECT key, CAST(count(n_nationkey) AS INT) AS targets, CASE WHEN count(n_nationkey) = 1 THEN min(n_nationkey) END AS target FROM q LEFT JOIN nation ON left(n_name, 1) = key GROUP BY key")
def registry_resolve(spark, sf_dir):
    """Nations by their first letter: one, several, or for other keys none."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    first = F.substring("n_name", 1, 1)
    keys = n.select(F.lit("nation").alias("namespace"), first.alias("key"), F.col("n_nationkey").alias("target"))
    asked = n.select(first.alias("key")).union(r.select(F.repeat(F.substring("r_name", 1, 1), F.lit(2)).alias("key"))).distinct()
    out = R.resolve(asked.select(F.lit("nation").alias("namespace"), "key"), keys)
    return out.select("key", F.coalesce(F.size("targets"), F.lit(0)).alias("targets"), "target")


@register("registry_identifiers", "SELECT r_regionkey, CASE WHEN count(*) = 1 THEN min(n_name) ELSE '[' || string_agg(n_name, ', ' ORDER BY n_name) || ']' END AS shown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def registry_identifiers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("parts"))
    return n.select("r_regionkey", R.identifier(F.col("parts")).alias("shown"))


@register("registry_decomposed", "SELECT r_regionkey, forged, CAST(CASE WHEN forged THEN 0 ELSE count(*) END AS BIGINT) AS children FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (VALUES (false), (true)) AS f(forged) GROUP BY r_regionkey, forged")
def registry_decomposed(spark, sf_dir):
    """Regions as entries of their nations' names, and the same with two names changed about: how many constituents each may be taken apart into."""
    nation = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.array_sort(F.collect_list("n_name")).alias("parts"))
    points = cut(_points(spark))
    true = cut(nation.join(composed(nation, points), "key"))
    turned = F.concat(F.slice("parts", 2, 1), F.slice("parts", 1, 1), F.expr("slice(parts, 3, size(parts))"))
    said = true.select(F.struct("key", F.lit(False).alias("forged")).alias("key"), "id", "m0", "m1", "m2", "m3", "parts").union(true.select(F.struct("key", F.lit(True).alias("forged")).alias("key"), "id", "m0", "m1", "m2", "m3", turned))
    held = decomposed(said, points).groupBy("key").agg(F.sum("run").alias("children"))
    return said.select("key").join(held, "key", "left").select(F.col("key.key").alias("r_regionkey"), F.col("key.forged").alias("forged"), F.coalesce("children", F.lit(0)).cast("bigint").alias("children"))


@register("masks", "WITH m AS (SELECT o_orderkey, (1 << CAST(o_orderkey % 8 AS INT)) | ((o_orderkey % 17 + 1) << 8) | ((o_orderkey % 45 + 1) << 13) AS mask FROM orders) SELECT o_orderkey, CAST(mask AS BIGINT) AS mask, CAST(((mask >> 8) & 31) - 1 AS BIGINT) AS upos, CAST(o_orderkey % 8 AS BIGINT) AS kind, o_orderkey % 8 = 3 AS is_third, CAST(mask & ~(31 << 8) AS BIGINT) AS cleared FROM m")
def masks(spark, sf_dir):
    k = F.col("o_orderkey")
    m = R.put(R.put(R.put(F.lit(0).cast("bigint"), "kind", k % 8), "upos", k % 17), "lexfile", k % 45)
    o = table(spark, sf_dir, "orders").select("o_orderkey", m.alias("mask"))
    c = F.col("mask")
    return o.select("o_orderkey", "mask", R.get(c, "upos", 17).alias("upos"), R.get(c, "kind", 8).alias("kind"), R.has(c, "kind", F.lit(3)).alias("is_third"), R.clear(c, "upos").alias("cleared"))


@register("mask_merge", "WITH m AS (SELECT o_custkey, o_orderkey % 8 AS k, o_orderkey % 2 AS u FROM orders) SELECT o_custkey, CASE WHEN count(DISTINCT u) = 1 THEN CAST(bit_or(1 << CAST(k AS INT)) | ((min(u) + 1) << 8) AS BIGINT) END AS mask FROM m GROUP BY o_custkey")
def mask_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    m = table(spark, sf_dir, "orders").select("o_custkey", R.put(R.put(F.lit(0).cast("bigint"), "kind", k % 8), "upos", k % 2).alias("mask"))
    return R.merged(m, "o_custkey", "mask")


@register("cache_sections", "SELECT c_custkey, o.n AS orders, c_custkey < 100 AS dense FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM nation GROUP BY n_nationkey HAVING count(*) > 1)")
def cache_sections(spark, sf_dir):
    """A dense section by slot and a sparse one by id, published only if the section has no faults."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slot"), F.col("n_name").alias("id"))
    sound = R.faults(n).agg((F.count("*") == 0).alias("sound"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    out = c.join(o, c.c_custkey == o.o_custkey, "left").crossJoin(F.broadcast(sound)).where("sound")
    return out.select("c_custkey", "orders", (F.col("c_custkey") < 100).alias("dense"))


@register("json_values", "SELECT event_id, json_valid(props) AS valid, CASE WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE lower(json_type(props)) END AS kind, CAST(len(json_keys(props)) AS INT) AS members FROM events")
def json_values(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", J.valid(p).alias("valid"), J.kind(p).alias("kind"), J.count(p).alias("members"))


@register("json_nodes", f"""WITH d AS (SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL AND event_type IS NOT NULL),
x AS (SELECT event_id, unnest([{{'n': 0, 'parent': NULL, 'ordinal': 0, 'key': NULL, 'kind': 'object', 'size': 4, 'raw': '{{'}}, {{'n': 1, 'parent': 0, 'ordinal': 0, 'key': 'type', 'kind': 'string', 'size': 0, 'raw': '"' || event_type || '"'}},
{{'n': 2, 'parent': 0, 'ordinal': 1, 'key': 'props', 'kind': 'object', 'size': 1, 'raw': '{{'}}, {{'n': 3, 'parent': 2, 'ordinal': 0, 'key': 'k', 'kind': 'number', 'size': 0, 'raw': k}},
{{'n': 4, 'parent': 0, 'ordinal': 2, 'key': 'type', 'kind': 'array', 'size': 3, 'raw': '['}}, {{'n': 5, 'parent': 4, 'ordinal': 0, 'key': NULL, 'kind': 'number', 'size': 0, 'raw': CAST(user_id AS VARCHAR)}},
{{'n': 6, 'parent': 4, 'ordinal': 1, 'key': NULL, 'kind': 'null', 'size': 0, 'raw': 'null'}}, {{'n': 7, 'parent': 4, 'ordinal': 2, 'key': NULL, 'kind': 'object', 'size': 0, 'raw': '{{'}},
{{'n': 8, 'parent': 0, 'ordinal': 3, 'key': '\\u00e9', 'kind': 'string', 'size': 0, 'raw': '"' || event_id || '"'}}]) AS s FROM d) SELECT event_id, s.n AS n, s.parent AS parent, s.ordinal AS ordinal, s.key AS key, s.kind AS kind, s.size AS size, s.raw AS raw FROM x""")
def json_nodes(spark, sf_dir):
    """Every value of a document for each event, in which the name "type" comes twice."""
    e = table(spark, sf_dir, "events").where("props is not null and event_type is not null")
    parts = ('{ "type": "', "event_type", '", "props": ', "props", ', "type": [', "user_id", ', null, {}], "\\u00e9": "', "event_id", '" }')
    text = F.concat(*(F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)))
    return N.nodes(e.select("event_id", text.alias("doc")), "event_id", "doc").drop("after")


@register("json_written", """SELECT p_partkey, '{"name":"' || replace(p_name, '"', '\\"') || '"}' AS json FROM part""")
def json_written(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"name":'), J.escaped(F.col("p_name")), F.lit("}")).alias("json"))


#: Vectors to a tensor file, about.
BLOCK = 4096
_TYPES_SQL = ", ".join(f"('{n}', {v}, {b})" for n, (v, b, _) in Q.TYPES.items())


@register("tensor_sizes", f"SELECT t.name AS dtype, CAST(e * 160 AS BIGINT) AS elements, CAST(CASE WHEN e * 160 % per = 0 THEN e * 160 // per * size ELSE 0 END AS BIGINT) AS bytes FROM (VALUES {_TYPES_SQL}) t(name, per, size), range(1, 9) r(e)")
def tensor_sizes(spark, sf_dir):
    t = spark.createDataFrame([(n,) for n in Q.TYPES], "dtype string").select("dtype", F.explode(F.array(*(F.lit(160 * e).cast("bigint") for e in range(1, 9)))).alias("elements"))
    return t.select("dtype", "elements", Q.nbytes(F.col("dtype"), F.col("elements")).cast("bigint").alias("bytes"))


_TO_BITS = "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), {least}) - {bits}), 0) * pow(2.0, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), {least}) - {bits}) END"
_ROUNDED = {"f32": "CAST(x AS DOUBLE)", "f16": _TO_BITS.format(least=-14, bits=10), "bf16": _TO_BITS.format(least=-126, bits=7)}


@register("tensor_decode", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, " + ", ".join(f"round(list_sum(list_transform(embedding, lambda x, i: i * ({e}))), 6) AS {c}" for c, e in _ROUNDED.items()) + " FROM embeddings")
def tensor_decode(spark, sf_dir):
    """Embeddings as raw tensors of three types, decoded; of each a sum that weighs values by their places."""

    @F.pandas_udf("f32 binary, f16 binary, bf16 binary")
    def raw(v: pd.Series) -> pd.DataFrame:
        a = [np.asarray(x, np.float32) for x in v]
        return pd.DataFrame({"f32": [x.tobytes() for x in a], "f16": [x.astype("<f2").tobytes() for x in a], "bf16": [Q.f32_to_bf16(x).astype("<u2").tobytes() for x in a]})

    e = table(spark, sf_dir, "embeddings").select("vec_id", raw("embedding").alias("r"))
    back = e.select("vec_id", *(Q.decode_column(F.col(f"r.{c}"), F.lit(c.upper())).alias(c) for c in _ROUNDED))
    weighed = lambda c: F.aggregate(F.transform(c, lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return back.select("vec_id", F.size("f32").alias("n"), *(F.round(weighed(c), 6).alias(c) for c in _ROUNDED))


@register("order_labels", "SELECT CAST(l_orderkey AS BIGINT) AS o_orderkey, md5('[' || string_agg(p_name || CASE WHEN l_linenumber % 3 > 0 THEN ' × ' || (1 + l_linenumber % 3) ELSE '' END, ' · ' ORDER BY l_linenumber, l_partkey) || ']') AS label FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def order_labels(spark, sf_dir):
    """Every order as a tuple of its lines' parts, a part as the letters of its name: labels from the stored tables of nodes and edges."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).cast("binary")
    letters = p.select(named("p", "p_partkey").alias("parent"), F.posexplode(F.split("p_name", "")).alias("ordinal", "letter")).where("letter <> ''")
    lines = l.join(p, l.l_partkey == p.p_partkey).select(named("o", "l_orderkey").alias("parent"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("ordinal"), named("p", "p_partkey").alias("child"), F.expr("cast(1 + l_linenumber % 3 as bigint)").alias("run"))
    edges = letters.select("parent", "ordinal", named("l", "letter").alias("child"), F.lit(1).cast("bigint").alias("run")).unionByName(lines).withColumn("said", F.lit(0))
    plain = edges.select(F.col("parent").alias("node")).distinct().withColumns({"flags": F.when(F.expr("substring(node, 1, 1) = X'6F'"), X.TUPLE).otherwise(0), "letter": F.lit(None).cast("string")})
    nodes = plain.unionByName(letters.select(named("l", "letter").alias("node"), F.lit(0).alias("flags"), "letter").distinct())
    shown = X.labels(nodes, edges).where("substring(node, 1, 1) = X'6F'")
    return shown.select(F.substring(F.col("node").cast("string"), 2, 30).cast("bigint").alias("o_orderkey"), F.md5(F.col("label").cast("binary")).alias("label"))


@register("tensor_files", "SELECT label, 'embeddings' AS name, 'F32' AS dtype, CAST(count(*) * 64 * 4 AS BIGINT) AS bytes, true AS same FROM embeddings GROUP BY label")
def tensor_files(spark, sf_dir):
    """Each label's vectors as Safetensors and GGUF files of about BLOCK vectors, read back: bytes of both, which must be the same."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    files = e.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("files"))
    dealt = e.join(F.broadcast(files), "label").withColumn("file", F.pmod(F.xxhash64("vec_id"), F.col("files")))

    def written(pdf):
        raw = np.stack([np.asarray(v, "<f4") for v in pdf.sort_values("vec_id")["embedding"]])
        t = [("embeddings", "F32", list(raw.shape), raw.tobytes())]
        name = f"{pdf['label'].iloc[0]}/{pdf['file'].iloc[0]}"
        return pd.DataFrame({"path": [f"{name}/a", f"{name}/b"], "content": [containers.write_safetensors(t, {"by": "label"}), containers.write_gguf([("general.name", 8, "embeddings")], t)]})

    made = dealt.groupBy("label", "file").applyInPandas(written, "path string, content binary")
    d = containers.tensor_directory(made).withColumns({"label": F.split("path", "/")[0].cast("int"), "kind": F.split("path", "/")[2]})
    size = F.col("end") - F.col("start")
    sums = d.groupBy("label", "name", "dtype").agg(F.sum(F.when(F.col("kind") == "a", size)).cast("bigint").alias("bytes"), F.sum(F.when(F.col("kind") == "b", size)).cast("bigint").alias("other"))
    return sums.select("label", "name", "dtype", "bytes", (F.col("bytes") == F.col("other")).alias("same"))


@register("tensor_ranges", "SELECT label, CAST(2 * count(*) * 64 * 4 AS BIGINT) AS bytes, CAST(2 * count(*) * 64 AS BIGINT) AS n, CAST(sum(2 * list_sum(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)))) AS BIGINT) AS total FROM embeddings GROUP BY label")
def tensor_ranges(spark, sf_dir):
    """All vectors as Safetensors and GGUF files of each label, read back through the data source: sizes from headers, values by ranges of bytes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    files = e.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("files"))
    dealt = e.join(F.broadcast(files), "label").withColumn("file", F.pmod(F.xxhash64("vec_id"), F.col("files")))

    def written(pdf):
        raw = np.stack([np.asarray(v, "<f4") for v in pdf.sort_values("vec_id")["embedding"]])
        t = [("embeddings", "F32", list(raw.shape), raw.tobytes())]
        name = f"{pdf['label'].iloc[0]}/{pdf['file'].iloc[0]}"
        return pd.DataFrame({"name": [f"{name}.safetensors", f"{name}.gguf"], "content": [containers.write_safetensors(t), containers.write_gguf([], t)]})

    folder = f"{shared_folder(spark)}/tensors-{uuid.uuid4().hex}"
    cut(tensor_files_source.write_files(dealt.groupBy("label", "file").applyInPandas(written, "name string, content binary"), folder))
    spark.dataSource.register(tensor_files_source.TensorFiles)
    read = spark.read.format("tensors")
    label = F.element_at(F.split("path", "/"), -2).cast("int").alias("label")
    sizes = read.load(folder).groupBy(label).agg(F.sum(F.col("end") - F.col("start")).alias("bytes"))
    whole = F.aggregate("values", F.lit(0).cast("bigint"), lambda n, x: n + F.floor(1024 * x.cast("double")))
    sums = read.option("values", "true").option("block", 1 << 20).load(folder).groupBy(label).agg(F.sum(F.size("values")).alias("n"), F.sum(whole).alias("total"))
    return sizes.join(sums, "label").select("label", "bytes", F.col("n").cast("bigint").alias("n"), "total")


@register("ggml_names", "SELECT p_partkey, 'blk.' || (p_partkey % 40) || '.attn_q.weight' AS name FROM part")
def ggml_names(spark, sf_dir):
    name = F.concat(F.lit("model.layers."), (F.col("p_partkey") % 40).cast("string"), F.lit(".self_attn.q_proj.weight"))
    return table(spark, sf_dir, "part").select("p_partkey", Q.ggml_name(name).alias("name"))


@register("ewkb_paths", "WITH p AS (SELECT user_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), f AS (SELECT seq, pos, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY seq ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM p), g AS (SELECT seq, event_type, sum(fresh) OVER (PARTITION BY seq ORDER BY pos) AS vertex FROM f), r AS (SELECT seq, vertex, any_value(event_type) AS event_type, count(*) AS run FROM g GROUP BY seq, vertex) SELECT seq, CAST(count(*) AS INT) AS vertices, CAST(CASE WHEN count(*) = 1 THEN 37 ELSE 9 + 32 * count(*) END AS INT) AS bytes, md5(string_agg(CAST(run AS INT), ',' ORDER BY vertex)) AS runs, CAST(count(DISTINCT event_type) AS INT) AS ids FROM r GROUP BY seq")
def ewkb_paths(spark, sf_dir):
    """Paths written as EWKB with packed ids, and their vertices read back: runs in order, and how many ids they have."""
    runs = P.runs(event_sequences(spark, sf_dir)).withColumn("key", I.id_of_text_column(F.col("id")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("vertex", F.col("key").alias("id"), F.col("run").cast("double").alias("m"), F.lit(0).alias("spare")))), lambda x: F.struct(x["id"].alias("id"), x["m"].alias("m"), x["spare"].alias("spare")))
    w = runs.groupBy("seq").agg(items.alias("items")).select("seq", wire.path_column(F.col("items")).alias("wkb"))
    v = w.select("seq", "wkb", wire.vertices_column(F.col("wkb")).alias("v"))
    ids = F.array_distinct(F.transform("v", lambda p: F.struct(p["x"], p["y"], p["z"])))
    return v.select("seq", F.size("v").alias("vertices"), F.length("wkb").alias("bytes"), F.md5(F.array_join(F.transform("v", lambda p: p["m"].cast("int").cast("string")), ",").cast("binary")).alias("runs"), F.size(ids).alias("ids"))


_HEX = "lpad(lower(hex({0})), {1}, '0')"
_TUPLE = "'0003' || '00000008' || " + _HEX.format("CAST(n_nationkey AS BIGINT)", 16) + " || " + _HEX.format("octet_length(encode(n_name))", 8) + " || lower(hex(encode(n_name))) || '00000004' || " + _HEX.format("n_regionkey", 8)


@register("copy_stream", f"SELECT md5('5047434f50590aff0d0a00' || repeat('00', 8) || string_agg({_TUPLE}, '' ORDER BY n_nationkey) || 'ffff') AS digest FROM nation")
def copy_stream(spark, sf_dir):
    """One COPY stream, byte for byte."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name", "n_regionkey").coalesce(1).sortWithinPartitions("k")
    pieces = wire.copy_files(n).agg(F.array_sort(F.collect_list(F.struct("piece", F.lower(F.hex("data")).alias("hex")))).alias("p"))
    return pieces.select(F.md5(F.array_join(F.transform("p", lambda x: x["hex"]), "").cast("binary")).alias("digest"))


@register("pg_arrays", "SELECT user_id, CAST(count(*) AS INT) AS n, md5(string_agg(md5(event_type), '' ORDER BY ts, event_id)) AS ids FROM events GROUP BY user_id")
def pg_arrays(spark, sf_dir):
    """Id arrays in PostgreSQL's binary form, read back."""
    return _arrays_read(table(spark, sf_dir, "events"))


@register("pg_arrays_whole", "SELECT user_id, CAST(count(*) AS INT) AS n FROM events GROUP BY user_id")
def pg_arrays_whole(spark, sf_dir):
    return _arrays_read(table(spark, sf_dir, "events")).select("user_id", "n")


def _arrays_read(events):
    @F.pandas_udf("n int, ids string")
    def through(lists: pd.Series) -> pd.DataFrame:
        back = [wire.pg_array_read(wire.pg_array([bytes(i) for i in x])) for x in lists]
        return pd.DataFrame({"n": [len(x) for x in back], "ids": [b"".join(x).hex() for x in back]})

    own = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    read = own.select("user_id", through(F.transform("e", lambda x: F.unhex(F.md5(x["event_type"].cast("binary"))))).alias("r"))
    return read.select("user_id", "r.n", F.md5(F.col("r.ids").cast("binary")).alias("ids"))


@register("artifact_digests")
def artifact_digests(spark, sf_dir):
    """All texts of a source, one after the other by doc_id, as one artifact: its BLAKE3-256. DuckDB has no BLAKE3."""
    return fingerprints(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
