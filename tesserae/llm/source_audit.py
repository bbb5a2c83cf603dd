"""Source divergence: how far the word use of each source of a language is from the other sources and from the language.

Terms are counted where the texts are; only sums move. A share is a whole number of billionths, p = 1 + floor(10^9 (count + 2)
/ (N + 2 V)), and two shares diverge by f(p, q) = floor((p - q)^2 / (p + q)).

Two sources are compared over all V kept terms of their language, although most terms occur in neither. With the shares p0 of
absent terms, the sum is V f(p0a, p0b), corrected for the terms of a alone, of b alone, and of both; so only cells that exist
are read. Cells are dealt by shards of terms and pairs of blocks of sources: a task holds a bounded part of the cells and adds
up one number for each pair.

The k largest terms of a group come from a radix selection: histograms over the bits of the value, high digits first, find the
k-th largest value of all groups together; where too many terms tie there, histograms over their UTF-8 bytes go on. Only rows that may be
among the k are ever put in order.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import LOWER, UPPER, split_join, stored, table, whole_text

#: Documents of a language that a term must be in to be kept.
LEAST_DOCS = 10
#: Terms reported of each group.
TOP = 10
#: Distinct terms that a task holds before it passes their counts on.
HELD = 400_000
#: Sources to a block, and cells to a shard of terms, about.
BLOCK, SHARD = 64, 200_000
#: Bits of a value (below 2^30), and of a digit.
BITS, DIGIT = 30, 10
#: Ties of a group that are put in order without further histograms.
FEW = 1024
#: Pairs of cells compared at once: 4 * 10^9 for each stays exact as a double.
AT_ONCE = 2_000_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_COUNTS = "lang string, source string, term binary, n bigint, docs bigint"


def _counted(batches):
    held, size = {}, 0

    def rows():
        flat = [(lang, source, term, n, docs) for (lang, source), own in held.items() for term, (n, docs) in own.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], k) for i, k in enumerate(kinds)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3))):
            own = held.setdefault((lang.as_py(), source.as_py()), {})
            before = len(own)
            for term, n in Counter(_TERM.findall(text.as_py().lower())).items():
                if term in own:
                    sums = own[term]
                    sums[0] += n
                    sums[1] += 1
                else:
                    own[term] = [n, 1]
            size += len(own) - before
            if size > HELD:
                yield rows()
                held, size = {}, 0
    yield rows()


def _share(n: str, total: str, kept: str) -> Column:
    """p for a count, the sum of counts and the number of kept terms, which are names of columns; exact for any long."""
    return F.expr(f"case when {kept} > 0 then 1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({total} + 2 * {kept} as decimal(20, 0)) end")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, bits: int = BITS, few: int = FEW) -> DataFrame:
    """The k rows of each group with the largest values (whole, 0 or more, below 2^bits), ties to the least UTF-8 bytes of `item`; `rank` from 1.

    Histograms of all groups narrow the k-th value digit by digit, then that of its ties byte by byte; a group of fewer rows is
    returned whole. `rows` is read in each pass, so it should be stored. No rows: no rows.
    """
    bytes_of = F.col(item).cast("binary")
    sizes = stored(rows.groupBy(*group).agg(F.count("*").alias("_size")))
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    state = sizes.select(*group, "_size", F.least(F.lit(k), "_size").alias("_need"), F.lit(0).cast("bigint").alias("_value"), F.col("_size").alias("_ties"), F.lit(b"").alias("_bytes"))

    def narrowed(state: DataFrame, within: Column, digit: Column, falling: bool) -> DataFrame:
        """For each group of `state`, the digit its k-th row has: _digit, with what is still needed of the rows that have it."""
        met = split_join(rows, state, group, "_size", total).where(within)
        bins = met.groupBy(*group, "_size", "_need", "_value", "_bytes", digit.alias("_digit")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.col("_digit").desc() if falling else F.col("_digit")))
        return bins.withColumn("_upto", upto).where("_upto >= _need and _upto - _n < _need").withColumn("_need", F.expr("_need - (_upto - _n)"))

    state, shift = stored(state), -(-bits // DIGIT) * DIGIT
    while shift > 0:
        shift -= DIGIT
        own = F.shiftright(F.col(value), shift)
        state = narrowed(state, F.shiftright(own, DIGIT) == F.col("_value"), own, True)
        state = stored(state.select(*group, "_size", "_need", F.col("_digit").alias("_value"), F.col("_n").alias("_ties"), "_bytes"))
    done, at = [], 0
    # a term that ends at the last byte looked at ties with nothing but itself
    wide = lambda: F.expr(f"_ties > {few} and _ties > _need and length(_bytes) = {at}")
    while not (open_ := state.where(wide())).isEmpty():
        done.append(state.where(~wide()))
        within = (F.col(value) == F.col("_value")) & (F.substring(bytes_of, 1, at) == F.col("_bytes"))
        at += 1
        next_ = narrowed(open_, within, F.substring(bytes_of, at, 1), False)
        state = stored(next_.select(*group, "_size", "_need", "_value", F.col("_n").alias("_ties"), F.concat("_bytes", "_digit").alias("_bytes")))
    for part in done:
        state = state.unionByName(part)
    state = stored(state) if done else state
    start = F.expr(f"substring(cast({item} as binary), 1, length(_bytes))")
    found = split_join(rows, state, group, "_size", total).where((F.col(value) > F.col("_value")) | ((F.col(value) == F.col("_value")) & (start <= F.col("_bytes"))))
    order = Window.partitionBy(*group).orderBy(F.col(value).desc(), bytes_of)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_size", "_need", "_value", "_ties", "_bytes")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _alone(source: np.ndarray, p: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """[source, other]: what the terms of one source change against the shares of absent terms of another."""
    out = np.zeros((len(own), len(other)), np.int64)
    for i in range(len(own)):
        shares, times = np.unique(p[source == i], return_counts=True)
        for s in range(0, len(shares), 8192):
            part = _f(shares[s : s + 8192, None], other[None, :]) - _f(own[i], other)[None, :]
            out[i] += (part * times[s : s + 8192, None]).sum(axis=0)
    return out


def _both(a: tuple, b: tuple, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """[source, other]: what terms that both have change further; a and b are (term, source, share), in order of terms."""
    (term_a, i, p), (term_b, j, q) = a, b
    out = np.zeros(len(own) * len(other), np.int64)
    low, high = np.searchsorted(term_b, term_a, "left"), np.searchsorted(term_b, term_a, "right")
    times = high - low
    ends = np.cumsum(times)
    start = 0
    while start < len(times):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        n = times[start:stop]
        x = np.repeat(np.arange(start, stop), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)
        p0, q0 = own[i[x]], other[j[y]]
        change = _f(p[x], q[y]) - _f(p[x], q0) - _f(p0, q[y]) + _f(p0, q0)
        out += np.rint(np.bincount(i[x] * len(other) + j[y], change, len(out))).astype(np.int64)
        start = stop
    return out.reshape(len(own), len(other))


def _compared(lang: str, low: int, high: int, size: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """For sources of the blocks `low` and `high` of `size` each, what the cells of a shard change of the sum over absent terms."""
    cells = pdf[pdf["term"].notna()]
    codes = pd.factorize(cells["term"])[0]
    block = cells["place"].to_numpy() // size

    def side(which):
        known = pdf[(pdf["term"].isna()) & (pdf["place"] // size == which)].sort_values("place")
        places = known["place"].to_numpy(np.int64)
        use = np.flatnonzero(block == which)
        use = use[np.argsort(codes[use], kind="stable")]
        own = cells.iloc[use]
        return places, known["absent"].to_numpy(np.int64), (codes[use], np.searchsorted(places, own["place"].to_numpy()), own["p"].to_numpy(np.int64))

    (pa_, own, a), (pb, other, b) = side(low), side(high)
    total = _alone(a[1], a[2], own, other) + _alone(b[1], b[2], other, own).T + _both(a, b, own, other)
    x, y = np.repeat(pa_, len(pb)), np.tile(pb, len(pa_))
    made = pd.DataFrame({"lang": lang, "place": x, "to": y, "more": total.ravel()})
    if low == high:
        return made[made["place"] != made["to"]]
    return pd.concat([made, made.rename(columns={"place": "to", "to": "place"})[["lang", "place", "to", "more"]]])


def divergences(cells: DataFrame, sizes: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, `cells` being (lang, source, term, p), `sizes` (lang, source, kept, absent)."""
    placed = stored(sizes.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    langs = placed.groupBy("lang").agg((F.floor(F.max("place") / block) + 1).cast("int").alias("blocks"))
    shards = cells.groupBy("lang").agg(F.count("*").alias("n")).join(langs, "lang").select("lang", "blocks", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    known = stored(placed.join(shards, "lang"))
    deal = lambda df: df.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("own", F.floor(F.col("place") / block).cast("int"))
    full = cells.join(known, ["lang", "source"]).withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
    absent = known.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("bigint")})
    columns = ["lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "shard", "place", "term", "p", "absent"]
    dealt = deal(full).select(*columns).unionByName(deal(absent).select(*columns))
    # each cell comes to a group once, a lone block's too: `other` is its own block then
    sums = dealt.groupBy("lang", "low", "high", "shard").applyInPandas(lambda key, pdf: _compared(*key[:3], block, pdf), "lang string, place int, to int, more bigint").groupBy("lang", "place", "to").agg(F.sum("more").alias("more"))
    other = placed.select("lang", F.col("place").alias("to"), F.col("source").alias("item"), F.col("absent").alias("absent_to"))
    pairs = placed.join(other, "lang").where("place <> to").join(sums, ["lang", "place", "to"], "left")
    base = F.when(F.col("kept") > 0, F.col("kept") * _divergence("absent", "absent_to") + F.coalesce("more", F.lit(0))).otherwise(0)
    return pairs.select("lang", "source", "item", base.cast("bigint").alias("value"))


def audit(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the parts `pair` and `term` of each group (lang, source).

    Null texts, languages and sources are empty. Every row is a document, repeated rows too. A group without terms, or a
    language without kept terms, has pairs (of value 0 where nothing is kept) and no terms. Ties of values are ranked by the
    UTF-8 bytes of the item. Other columns are not looked at. No rows: no rows.
    """
    docs = df.select(*(whole_text(c).alias(c) for c in ("lang", "source")), whole_text("text").cast("binary").alias("text"))
    counts = docs.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts.withColumn("term", F.col("term").cast("string")))
    terms = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    kept = stored(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sizes = groups.join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"]).withColumn("none", F.lit(0).cast("bigint"))
    sizes = stored(sizes.withColumn("absent", _share("none", "total", "kept")).drop("none"))
    cells = kept.join(sizes, ["lang", "source"]).withColumns({"p": _share("n", "total", "kept"), "q": _share("`all`", "lang_total", "kept")})
    cells = stored(cells.select("lang", "source", "term", "p", F.when(F.col("p") > F.col("q"), _divergence("p", "q")).alias("value")))
    own = cells.where("value is not null").select("lang", "source", F.col("term").alias("item"), "value")
    best = radix_top(own, ["lang", "source"], "value", "item", top)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = divergences(cells.select("lang", "source", "term", "p"), sizes.select("lang", "source", "kept", "absent")).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
with docs as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
counts as (select lang, source, term, count(*) as n, count(distinct id) as d from (select id, lang, source, unnest(w) as term from docs) group by all),
terms as (select lang, term, sum(n) as total from counts group by lang, term having sum(d) >= {LEAST_DOCS}),
langs as (select lang, count(*) as v, sum(total) as n from terms group by lang),
groups as (select distinct lang, source from docs),
own as (select lang, source, sum(c.n) as n from counts c join terms using (lang, term) group by lang, source),
cells as (select g.lang, g.source, t.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(o.n, 0) + 2 * l.v) as p, 1 + (1000000000::hugeint * (t.total + 2)) // (l.n + 2 * l.v) as q
    from groups g join terms t using (lang) join langs l using (lang) left join own o using (lang, source) left join counts c using (lang, source, term)),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
parts as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value
    from groups g join groups h on g.lang = h.lang and g.source <> h.source left join pairs p on p.lang = g.lang and p.source = g.source and p.item = h.source
    union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from cells where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
