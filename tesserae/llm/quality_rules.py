"""Quality rules per document, and verdicts on whole hosts from the rules' failure rates, shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import SPACES, cut, stored, table, whole_text, words

SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 50  # per cent of words
MOST_SYMBOLS = 10  # per cent of word characters
MOST_DUP_LINES = 30  # per cent of lines with a word
#: A host is judged bad when the shrunken failure rate of its documents is above this.
BAD_HOST = 0.5
#: Limits of the prior's weight, in documents: below, a host of one document could be judged; above, no host could.
WEIGHT = (2.0, 1000.0)
BROADCAST_HOSTS = 200_000


def _repeated(w: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more. `w` must be a stored column."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, windows).otherwise(F.array().cast("array<string>"))


def measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (all bigint), named with `prefix`.

    Everything happens inside the row: no explode, no shuffle. Null texts count as empty, with zeros everywhere.
    """
    body, w, g, s, rank = (f"_{x}_{prefix}" for x in ("body", "words", "windows", "sorted", "twice"))
    out = df.withColumn(body, whole_text(text))
    out = out.withColumn(w, words(F.col(body)))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    out = out.withColumns(
        {
            f"{prefix}n_words": F.size(w).cast("bigint"),
            f"{prefix}word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("bigint"),
            f"{prefix}n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
            f"_lines_{prefix}": lines,
            g: _repeated(F.col(w)),
        }
    )
    # windows sorted with their places: equal ones come to stand side by side
    placed = F.array_sort(F.zip_with(F.col(g), F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    out = out.withColumns(
        {
            f"{prefix}n_lines": F.size(f"_lines_{prefix}").cast("bigint"),
            f"{prefix}n_dup_lines": (F.size(f"_lines_{prefix}") - F.size(F.array_distinct(f"_lines_{prefix}"))).cast("bigint"),
            s: F.when((F.size(g) > 0) & (F.size(F.array_distinct(g)) < F.size(g)), placed),
        }
    )
    both = F.col(s)
    twice = F.filter(F.transform(both, lambda x, i: F.when((x.g == F.get(both, i - 1).g) | (x.g == F.get(both, i + 1).g), x.i)), lambda i: i.isNotNull())
    out = out.withColumn(rank, F.array_sort(twice))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(F.col(rank), start, lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a.n)
    # the row number, never negative, keeps filters on this column above the projections: below, they would repeat them
    once = F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0)))
    out = out.withColumn(f"{prefix}n_repeat_words", once.cast("bigint"))
    return out.drop(body, w, g, s, rank, f"_lines_{prefix}")


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < FEWEST_WORDS) | (100 * r > MOST_REPEATED * n)


def soft_failed(prefix: str = "") -> Column:
    c = lambda x: F.col(prefix + x)
    return base_failed(prefix) | (100 * c("n_symbols") > MOST_SYMBOLS * c("word_chars")) | (100 * c("n_dup_lines") > MOST_DUP_LINES * c("n_lines"))


def host_verdicts(df: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n, fails, rate, bad) for each host, null being a host like any other.

    The prior Beta(a, b) is fitted to the hosts' rates by moments: its mean is the rate over all documents; its weight
    a + b makes the spread of true rates what is left of the spread of observed ones after binomial noise. The shrunken
    rate is (fails + a) / (n + a + b). Documents are counted per host before any shuffle, so a hot host costs nothing.
    """
    hosts = cut(df.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("bigint")).alias("fails")))
    n, k = F.col("n").cast("double"), F.col("fails").cast("double")
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(k).alias("failed"), F.sum(k * k / n).alias("squares"), F.sum(n * n).alias("sizes"))
    s = sums.first()  # five numbers, whatever the hosts
    mean, weight = 0.0, WEIGHT[1]
    if s.docs:
        mean = s.failed / s.docs
        noise, room = mean * (1 - mean), s.docs - s.sizes / s.docs
        between = s.squares - s.docs * mean * mean - (s.hosts - 1) * noise
        if s.hosts > 1 and room > 0 and between > 0:
            weight = max(WEIGHT[0], min(WEIGHT[1], noise / (between / room) - 1))
    rate = (F.col("fails") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select(F.col(host).alias("host"), "n", "fails", rate.alias("rate"), (rate > BAD_HOST).alias("bad"))


def judge(df: DataFrame, text: str = "text", host: str = "source", keep_text: bool = True) -> DataFrame:
    """All rows of `df` with the measures, base_failed, soft_failed, host_rate and kept.

    kept: not base_failed, and on a bad host no soft rule failed either; a clean document stays whatever its host. New
    columns carry the prefix "q_"; columns of the input that begin with it are replaced. Null texts have no words. Null hosts are judged together. Repeated rows count
    as often as they come. An empty table gives no rows. Rows are measured once and stored: verdicts need all of them.
    keep_text=False leaves the text column out.
    """
    df = df.drop(*(c for c in df.columns if c.startswith("q_")))
    out = measures(df, text, "q_").withColumn("q_base_failed", base_failed("q_")).withColumn("q_soft_failed", soft_failed("q_"))
    out = stored(out if keep_text else out.drop(text))
    hosts = host_verdicts(out, host, "q_soft_failed").select(F.col("host").alias("q_host"), F.col("rate").alias("q_host_rate"), F.col("bad").alias("q_bad"))
    # broadcast only up to a checked number of rows of a name and two numbers; beyond it, an ordinary join
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    joined = out.join(hosts, F.col(host).eqNullSafe(F.col("q_host")), "left")
    kept = ~F.col("q_base_failed") & ~(F.coalesce("q_bad", F.lit(False)) & F.col("q_soft_failed"))
    return joined.withColumn("q_kept", kept).drop("q_host", "q_bad")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate"]
    rounded = judged.withColumn("q_host_rate", F.round("q_host_rate", 9))
    return rounded.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in names))


#: Measures, verdicts and prior as DuckDB SQL.
SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g) WHERE times > 1),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (
  SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words
         OR 100 * n_symbols > {MOST_SYMBOLS} * word_chars OR 100 * n_dup_lines > {MOST_DUP_LINES} * n_lines AS soft_failed
  FROM m),
h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(soft_failed AS INT)) AS DOUBLE) AS k FROM f GROUP BY source),
s AS (
  SELECT CAST(count(*) AS DOUBLE) AS hosts, sum(n) AS docs, sum(k) / sum(n) AS mean, sum(k * k / n) AS squares, sum(n * n) AS sizes FROM h),
v AS (
  SELECT mean, hosts, (squares - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / nullif(docs - sizes / docs, 0) AS spread FROM s),
p AS (
  SELECT mean, CASE WHEN hosts < 2 OR spread <= 0 OR spread IS NULL THEN {WEIGHT[1]}
                    ELSE greatest({WEIGHT[0]}, least({WEIGHT[1]}, mean * (1 - mean) / spread - 1)) END AS weight FROM v),
x AS (SELECT h.source, (k + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rate > {BAD_HOST} AND soft_failed) AS kept, round(rate, 9) AS host_rate
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""
