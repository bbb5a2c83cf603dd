"""Toxicity by weak supervision: many small voters, a label model over their votes, a linear classifier on its posteriors.

1. Voters. Words and word beginnings that stand out in labelled toxic texts become patterns; patterns are dealt to
   VOTERS voters, so that each voter covers several of them, and some voters ask for two or for a share of such words.
2. Label model. All texts outside the held-out fold vote, labelled or not; only counts of vote patterns are gathered.
   A latent-class model is fitted to the counts by EM: for each class the rate at which each voter fires (its accuracy).
   What it leaves unexplained is measured pair by pair; the most correlated pairs are joined into one four-valued voter
   and the model is fitted again, so that two voters that only repeat each other aren't counted as two witnesses.
3. Classifier. Logistic regression on the patterns' hits in a bounded sample, towards the posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tesserae.llm.common import cut, fold_of, stored, table

#: The fitted sample: so many labelled rows at most, those with the least hashes of their ids.
SAMPLE = 20_000
#: A pattern must stand in this share of the sample's toxic texts, and of those it stands in this share must be toxic.
SUPPORT, PRECISION = 0.01, 0.8
MOST_CANDIDATES = 20_000
PATTERNS = 96
#: Single-pattern-set voters; with the two counting voters there are 2^(VOTERS + 2) vote patterns at most.
VOTERS = 8
BEGINNINGS = (3, 4, 5, 6, 7, 8)
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words and, marked by ^, their beginnings (a whole word begins with itself)."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for k in BEGINNINGS:
        out.update(["^" + w[:k] for w in words if len(w) >= k])
    return out


class Patterns:
    """Chosen patterns, ready to be counted in texts by one automaton over all of them."""

    def __init__(self, chosen: list[str]):
        self.chosen = chosen
        self.automaton = None

    def __getstate__(self):
        return {"chosen": self.chosen, "automaton": None}

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.chosen):
            bare = p.lstrip("^")
            held = self.automaton.get(bare, [])
            self.automaton.add_word(bare, [*held, (i, len(bare), p[0] == "^")])
        self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[np.ndarray, int]:
        """How often each pattern stands in the text, and how many words that have any: beginnings at the start of a word, words whole."""
        counts, words = np.zeros(len(self.chosen)), set()
        if self.chosen and text:
            if self.automaton is None:
                self._build()
            text = text.lower()
            for end, found in self.automaton.iter(text):
                for i, size, begins in found:
                    at = end - size + 1
                    if at and _WORD.match(text[at - 1]):
                        continue
                    if begins or end + 1 == len(text) or not _WORD.match(text[end + 1]):
                        counts[i] += 1
                        words.add(at)
        return counts, len(words)


def choose_patterns(rows: list[tuple[int, list[int]]], names: list[str], n_toxic: int) -> list[str]:
    """From (toxic, candidates that stand in the text): precise patterns, by how many toxic texts they add.

    Of patterns that stand in nearly the same texts the longest is taken, being the least likely elsewhere.
    """
    toxic = [np.array(c, int) for y, c in rows if y]
    clean = [np.array(c, int) for y, c in rows if not y]
    size = len(names)
    in_toxic = np.bincount(np.concatenate(toxic), minlength=size) if toxic else np.zeros(size)
    in_clean = np.bincount(np.concatenate(clean), minlength=size) if clean else np.zeros(size)
    precise = (in_toxic >= max(2, SUPPORT * n_toxic)) & ((in_toxic + 0.5) / (in_toxic + in_clean + 1.0) >= PRECISION)
    where: dict[int, set[int]] = {i: set() for i in np.flatnonzero(precise)}
    for n, c in enumerate(toxic):
        for i in c[precise[c]]:
            where[i].add(n)
    covered, chosen = np.zeros(len(toxic)), []
    left = dict(where)
    while left and len(chosen) < PATTERNS:
        # a text that three patterns reach already adds nothing
        gain = {i: sum(1.0 / (1 + covered[n]) for n in found if covered[n] < 8) for i, found in left.items()}
        best = max(left, key=lambda i: (round(gain[i], 6), len(names[i]), names[i]))
        if gain[best] <= 0:
            break
        like = [i for i, found in left.items() if len(found & left[best]) >= 0.9 * len(found | left[best])]
        best = max(like, key=lambda i: (len(names[i]) if names[i][0] == "^" else 0, len(names[i]), names[i]))
        chosen.append(names[best])
        covered[list(left[best])] += 1
        taken = left[best]
        left = {i: found for i, found in left.items() if len(found & taken) < 0.9 * len(found | taken)}
    return chosen


def votes(counts: np.ndarray, total: int) -> int:
    """The votes of all voters as bits."""
    out = 0
    for i in np.flatnonzero(counts):
        out |= 1 << (int(i) % VOTERS)
    return out | (total >= 2) << VOTERS | ((counts > 0).sum() >= 3) << (VOTERS + 1)


class LabelModel:
    """Latent classes over the votes; correlated pairs of voters are one four-valued voter."""

    def __init__(self, patterns: np.ndarray, weights: np.ndarray, prior: float):
        self.groups = [(j,) for j in range(VOTERS + 2)]
        self.prior = prior
        self._fit(patterns, weights)
        self.groups = self._pairs(patterns, weights)
        self._fit(patterns, weights)

    def _codes(self, patterns: np.ndarray) -> np.ndarray:
        return np.stack([sum(((patterns >> j) & 1) << k for k, j in enumerate(g)) for g in self.groups], axis=1)

    def _fit(self, patterns, weights):
        codes = self._codes(patterns)
        any_vote = np.bitwise_count(patterns.astype(np.uint64)) / (VOTERS + 2)
        p = np.clip(0.02 + 1.6 * any_vote, 0.02, 0.95)  # a start that says which class is which
        for _ in range(60):
            w1, w0 = weights * p, weights * (1 - p)
            self.rates = []
            for k, g in enumerate(self.groups):
                size = 2 ** len(g)
                t1, t0 = (np.bincount(codes[:, k], w, minlength=size) + 0.5 for w in (w1, w0))
                self.rates.append((np.log(t1 / t1.sum()), np.log(t0 / t0.sum())))
            self.prior = float(np.clip(w1.sum() / max(weights.sum(), 1e-9), 0.001, 0.5))
            new = self._posterior(codes)
            if np.abs(new - p).max() < 1e-7:
                break
            p = new

    def _posterior(self, codes):
        z = np.full(len(codes), np.log(self.prior) - np.log1p(-self.prior))
        for k, (one, zero) in enumerate(self.rates):
            z += one[codes[:, k]] - zero[codes[:, k]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(self._codes(patterns))

    def _pairs(self, patterns, weights) -> list[tuple[int, ...]]:
        p, n = self._posterior(self._codes(patterns)), VOTERS + 2
        x = ((patterns[:, None] >> np.arange(n)) & 1).astype(float)
        excess = np.zeros((n, n))
        for w in (weights * p, weights * (1 - p)):
            total = max(w.sum(), 1e-9)
            mean = (w[:, None] * x).sum(0) / total
            cov = (w[:, None, None] * (x - mean)[:, :, None] * (x - mean)[:, None, :]).sum(0) / total
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            excess = np.maximum(excess, np.abs(cov / sd[:, None] / sd[None, :]) * (total > 20))
        groups, free = [], set(range(n))
        for i, j in sorted(((i, j) for i in range(n) for j in range(i)), key=lambda ij: -excess[ij]):
            if excess[i, j] >= 0.2 and i in free and j in free:
                groups.append((j, i))
                free -= {i, j}
        return sorted(groups + [(j,) for j in free])


def inputs(counts: np.ndarray, total: int) -> np.ndarray:
    """What the classifier sees of a text: its hits only."""
    seen = float((counts > 0).sum())
    return np.concatenate([[1.0, np.log1p(total), np.log1p(seen), min(seen, 1.0)], counts > 0])


def fit_linear(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of rows counted n times towards probabilities, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, n.sum() / 1000))
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (target - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _map(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text[, toxic]) rows, with work(list of row dicts) -> list of tuples."""
    to = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(to)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = work(batch.slice(start, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, to)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): at most about `sample` labelled rows outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    # about `sample` rows of 12 bytes: the bound that makes this broadcast safe
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Patterns, np.ndarray, LabelModel | None]:
    """Patterns, the classifier's weights, and the label model. Without labelled toxic texts nothing scores."""
    rows = stored(labelled_sample(docs, labels, sample))

    def toxic_features(batch):
        counts: Counter = Counter()
        for r in batch:
            counts.update(features(r["text"]))
        return [*counts.items(), ("", len(batch))]

    found = cut(_map(rows.where("toxic = 1"), toxic_features, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n")))
    n_toxic = (found.where("feature = ''").agg(F.sum("n")).first()[0]) or 0
    if not n_toxic:
        return Patterns([]), np.array([-5.0, 0, 0, 0]), None
    # at most (features of a text) / SUPPORT can stand in that share of the texts
    frequent = found.where((F.col("feature") != "") & (F.col("n") >= max(2, SUPPORT * n_toxic))).orderBy(F.desc("n"), "feature").limit(MOST_CANDIDATES)
    in_toxic = {r.feature: r.n for r in frequent.collect()}

    def clean_features(batch):
        counts: Counter = Counter()
        for r in batch:
            counts.update(features(r["text"]).intersection(in_toxic))
        return list(counts.items())

    clean = _map(rows.where("toxic = 0"), clean_features, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    in_clean = {r.feature: r.n for r in clean.collect()}
    names = sorted(f for f, n in in_toxic.items() if (n + 0.5) / (n + in_clean.get(f, 0) + 1.0) >= PRECISION)
    candidates = Patterns(names)

    def standing(batch):
        return [(int(r["toxic"]), np.flatnonzero(candidates.hits(r["text"])[0]).tolist()) for r in batch]

    # one row for each row of the bounded sample that has any precise candidate: few but toxic ones have
    incidence = [(r.toxic, r.found) for r in _map(rows, standing, "toxic int, found array<int>").where("size(found) > 0").collect()]
    patterns = Patterns(choose_patterns(incidence, names, n_toxic))
    if not patterns.chosen:
        return patterns, np.array([-5.0, 0, 0, 0]), None

    def cast_votes(batch):
        counts = Counter(votes(*patterns.hits(r["text"])) for r in batch)
        return list(counts.items())

    learning = docs.select("doc_id", "text").where(F.coalesce(fold_of("doc_id", FOLDS), F.lit(0)) != HELD_OUT)
    tally = _map(learning, cast_votes, "votes int, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    model = LabelModel(np.array([r.votes for r in tally]), np.array([float(r.n) for r in tally]), 0.1)

    # the classifier's rows are as few as the sample, but equal rows are counted before they are gathered
    def seen(batch):
        return list(Counter((*inputs(*(h := patterns.hits(r["text"]))).tolist(), votes(*h)) for r in batch).items())

    rows_seen = _map(rows, lambda batch: [(list(k[:-1]), int(k[-1]), n) for k, n in seen(batch)], "x array<double>, votes int, n bigint")
    sampled = rows_seen.groupBy("x", "votes").agg(F.sum("n").alias("n")).orderBy("votes", "x").collect()
    x, n = np.array([r.x for r in sampled]), np.array([float(r.n) for r in sampled])
    return patterns, fit_linear(x, model.posterior(np.array([r.votes for r in sampled])), n), model


def score(df: DataFrame, patterns: Patterns, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out` double, 0 to 1, to every row; null and empty texts get what a text without hits gets."""
    rest = [c for c in df.columns if c != out]

    def run(batches):
        for batch in batches:
            scores = []
            for body in batch.column(batch.schema.get_field_index(text)):
                x = inputs(*patterns.hits(body.as_py()))
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*rest, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of `docs` with tox_score and tox_predicted (1 from THRESHOLD on).

    Labels are read only for ids outside the held-out fold; repeated labels of an id count as toxic if any is. Ids, sources
    and languages are never inputs. Null texts are empty. Without any toxic label every score is low. No rows: no rows.
    """
    patterns, weights, _ = fit(docs, labels, sample)
    return score(docs, patterns, weights, out="tox_score").withColumn("tox_predicted", (F.col("tox_score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels")).drop("text")
    held_out = F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
