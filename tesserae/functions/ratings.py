"""Ratings from evidence. Closed forms are Column expressions; solved posteriors are small numpy routines.

A standing is (rating, deviation, volatility) on Glickman's scale; inside, mu = (rating - 1500) / 173.7178 and
phi = deviation / 173.7178.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rating system.
SCALE, RATING, DEVIATION, VOLATILITY, TAU, FLOOR = 173.7178, 1500.0, 350.0, 0.06, 0.5, 30.0
#: Trust classes and their priors, in their fixed order.
TRUST_CLASSES = (
    ("SubstrateMandate", 1.00),
    ("StandardsDerived", 0.95),
    ("AcademicCurated", 0.85),
    ("AcademicCuratedWithUserInput", 0.78),
    ("StructuredCorpus", 0.70),
    ("UserCuratedResource", 0.60),
    ("AIModelProbe", 0.50),
    ("AppDerived", 0.40),
    ("UserPromptContent", 0.30),
    ("ResponseContent", 0.20),
    ("AdversarialUntrusted", 0.00),
    ("DerivedCalculation", 0.70),
    ("AgentTranscript", 0.40),
    ("ToolResultContent", 0.40),
    ("ToolchainVerification", 0.90),
    ("InternalMonologue", 0.10),
)


def trust_class(label: Column) -> Column:
    """The prior of an exact label, null for others."""
    out = F.lit(None).cast("double")
    for name, prior in TRUST_CLASSES:
        out = F.when(label == name, prior).otherwise(out)
    return out


def trust_deviation(trust: Column) -> Column:
    """The deviation at which a witness's weight equals its trust."""
    t = F.abs(trust)
    finite = SCALE * math.pi / math.sqrt(3.0) * F.sqrt(1.0 / (t * t) - 1.0)
    return F.when(t >= 1, 0.0).when(t <= 0, float("inf")).otherwise(finite)


def entry_deviation(trust: Column) -> Column:
    return F.when(trust == 0, DEVIATION).otherwise(F.greatest(trust_deviation(trust), F.lit(FLOOR)))


def series_floor(trust: Column, floor: Column | float = FLOOR) -> Column:
    return F.least(F.greatest(trust_deviation(trust), F.lit(floor) if isinstance(floor, float) else floor), F.lit(DEVIATION))


def witness_precision(trust: Column, floor: Column | float = FLOOR) -> Column:
    """What one witness can say at most: information of its trust, capped by the floor's precision."""
    floor = F.lit(floor) if isinstance(floor, float) else floor
    cap = F.pow(SCALE / floor, F.lit(2.0))
    said = 3.0 * trust * trust / (math.pi**2 * (1.0 - trust * trust))
    good = (trust >= 0) & (trust <= 1) & (floor > 0) & (floor < float("inf"))
    return F.when(~good, float("nan")).when(trust == 0, 0.0).when(trust == 1, cap).otherwise(F.least(said, cap))


def _reading(rating: Column, deviation: Column, k: float) -> Column:
    return (rating - RATING) / SCALE - k * deviation / SCALE


def confidence(rating: Column, deviation: Column, k: float = 2.0) -> Column:
    """The chance of beating the anchor, read k deviations low."""
    return 1.0 / (1.0 + F.exp(-_reading(rating, deviation, k)))


def cost(rating: Column, deviation: Column, k: float = 2.0, per_hop: float = 0.0) -> Column:
    return F.log1p(F.exp(-_reading(rating, deviation, k))) + per_hop


def attested(games: Column, wins: Column, trust: Column) -> Column:
    """struct(games, wins, trust) of a valid observation, else null; negative trust counts the losses."""
    whole = (games >= 1) & (games <= float(1 << 53)) & (F.floor(games) == games)
    fine = whole & (wins >= 0) & (wins <= games) & (F.abs(trust) <= 1) & ~F.isnan(wins) & ~F.isnan(trust)
    return F.when(fine, F.struct(games.cast("bigint").alias("games"), F.when(trust < 0, games - wins).otherwise(wins).alias("wins"), F.abs(trust).alias("trust")))


def attest_series(rating: Column, deviation: Column, trust: Column, games: Column, score: Column, floor: float = FLOOR) -> Column:
    """struct(rating, deviation) after one witness's series against the anchor, in built-in functions.

    The posterior mode is the zero of a falling slope, halved down to between its bracket's ends 200 times.
    """
    t = F.least(F.abs(trust), F.lit(1.0))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    vote = 0.5 + t * (F.when(trust < 0, 1.0 - s).otherwise(s) - 0.5)
    mu0, phi, n = (rating - RATING) / SCALE, deviation / SCALE, games.cast("double")
    reach = n * phi * phi
    logit = F.when(vote <= 0, float("-inf")).when(vote >= 1, float("inf")).otherwise(F.log(vote / (1.0 - vote)))
    lo = F.when(logit > mu0, mu0).otherwise(F.greatest(logit, mu0 - reach))
    hi = F.when(logit > mu0, F.least(logit, mu0 + reach)).otherwise(mu0)
    known = F.struct(lo.alias("lo"), hi.alias("hi"), mu0.alias("mu0"), (phi * phi).alias("v"), n.alias("n"), vote.alias("vote"))

    def halve(a: Column, _: Column) -> Column:
        m = a["lo"] + 0.5 * (a["hi"] - a["lo"])
        rising = (a["mu0"] - m) / a["v"] + a["n"] * (a["vote"] - 1.0 / (1.0 + F.exp(-m))) > 0
        return F.struct(F.when(rising, m).otherwise(a["lo"]).alias("lo"), F.when(rising, a["hi"]).otherwise(m).alias("hi"), a["mu0"].alias("mu0"), a["v"].alias("v"), a["n"].alias("n"), a["vote"].alias("vote"))

    def close(a: Column) -> Column:
        mu = a["lo"] + 0.5 * (a["hi"] - a["lo"])
        e = 1.0 / (1.0 + F.exp(-mu))
        return F.struct(mu.alias("mu"), (SCALE / F.sqrt(1.0 / a["v"] + a["n"] * e * (1.0 - e))).alias("solved"))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(200)), known, halve, close)
    dev = F.least(F.greatest(solved["solved"], series_floor(t, floor)), deviation)
    idle = (trust == 0) | (games == 0)
    return F.struct(F.when(idle, rating).otherwise(RATING + SCALE * solved["mu"]).alias("rating"), F.when(idle, deviation).otherwise(dev).alias("deviation"))


def _weight(deviation):
    return 1.0 / np.sqrt(1.0 + 3.0 * (np.asarray(deviation) / SCALE) ** 2 / math.pi**2)


def _new_volatility(sigma: float, phi2: float, v: float, delta: float, tau: float, tolerance: float) -> float:
    """Glickman's step 5: the zero of a falling function of log variance, by false position with halved ends."""
    a = 2.0 * math.log(sigma)

    def f(x: float) -> float:
        e = math.exp(x)
        return e * (delta * delta - phi2 - v - e) / (2.0 * (phi2 + v + e) ** 2) - (x - a) / tau**2

    low, excess = a, delta * delta - phi2 - v
    if excess > 0:
        high = math.log(excess)
    else:
        k = 1
        while f(a - k * tau) < 0:
            k += 1
        high = a - k * tau
    f_low, f_high = f(low), f(high)
    for _ in range(100):
        if abs(high - low) <= tolerance or f_high == f_low:
            break
        x = low + (low - high) * f_low / (f_high - f_low)
        y = f(x)
        if y * f_high <= 0:
            low, f_low = high, f_high
        else:
            f_low /= 2.0
        high, f_high = x, y
    return math.exp(low / 2.0)


def rate(standing: tuple[float, float, float], opponents: np.ndarray, scores: np.ndarray, tau: float = TAU, period: bool = True) -> tuple[float, float, float]:
    """A Glicko-2 rating period against opponents (n, 2) of (rating, deviation); period=False leaves out its widening."""
    rating, deviation, sigma = standing
    mu, phi = (rating - RATING) / SCALE, deviation / SCALE
    if not len(scores):
        return rating, SCALE * math.hypot(phi, sigma), sigma
    g = _weight(opponents[:, 1])
    expect = 1.0 / (1.0 + np.exp(-g * (mu - (opponents[:, 0] - RATING) / SCALE)))
    return advance(standing, float((g * (scores - expect)).sum()), float((g * g * expect * (1 - expect)).sum()), tau, period)


def advance(standing: tuple[float, float, float], gain: float, info: float, tau: float = TAU, period: bool = True) -> tuple[float, float, float]:
    """A standing after games whose surprises sum to `gain` and whose information sums to `info`."""
    rating, deviation, sigma = standing
    mu, phi = (rating - RATING) / SCALE, deviation / SCALE
    sigma = _new_volatility(sigma, phi * phi, 1.0 / info, gain / info, tau, 1e-6)
    before = phi * phi + (sigma * sigma if period else 0.0)
    after = 1.0 / (1.0 / before + info)
    return RATING + SCALE * (mu + after * gain), SCALE * math.sqrt(after), sigma


def attest(standing: tuple[float, float, float], trust: float, score: float, opponent: float = RATING, tau: float = TAU, floor: float = FLOOR) -> tuple[float, float, float]:
    """One matchup with a witness of signed trust."""
    if trust == 0:
        return standing
    t = min(abs(trust), 1.0)
    deviation = SCALE * math.pi / math.sqrt(3.0) * math.sqrt(1.0 / (t * t) - 1.0)
    rating, dev, sigma = rate(standing, np.array([[opponent, deviation]]), np.array([1.0 - score if trust < 0 else score]), tau, False)
    return rating, max(dev, floor), sigma


def sources(mu: float, n, score, anchor, weight, precision):
    """Each root's own performance x, given the claim at mu (one, or one for each root): the zero of precision (mu - x) + its games' slope.

    Returns the root's pull on the claim and its information about it.
    """

    def slope(x):
        z = weight * (x - anchor)
        tail = np.exp(-np.abs(z))
        miss = np.where(z >= 0, (score - 1) + tail / (1 + tail), score - tail / (1 + tail))
        return precision * (mu - x) + n * weight * miss, n * weight**2 * tail / (1 + tail) ** 2

    reach = n * weight / precision
    lo, hi = mu - reach, mu + reach
    x = mu + np.zeros(len(n))
    for _ in range(200):
        s, info = slope(x)
        lo, hi = np.where(s > 0, x, lo), np.where(s < 0, x, hi)
        step = x + s / (precision + info)
        new = np.where((step > lo) & (step < hi), step, lo + 0.5 * (hi - lo))
        if (np.abs(new - x) <= 1e-14 * np.maximum(1.0, np.abs(x))).all():
            break
        x = new
    _, info = slope(x)
    with np.errstate(divide="ignore"):
        return precision * (x - mu), np.where(info > 0, 1.0 / (1.0 / np.maximum(info, 1e-300) + 1.0 / precision), 0.0)


def settle(mu: float, gain: float, information: float, prior=(RATING, DEVIATION, VOLATILITY)) -> tuple[float, float, float]:
    """(rating, deviation, volatility) of a claim whose roots pull by `gain` and inform by `information` at its strength mu."""
    phi2 = (prior[1] / SCALE) ** 2
    sigma = _new_volatility(prior[2], phi2, 1.0 / information, gain / information, TAU, 1e-12)
    return RATING + SCALE * mu, SCALE / math.sqrt(1.0 / (phi2 + sigma * sigma) + information), sigma


def series(games, wins, trust, opponent=None, opponent_deviation=None, witness_deviation=None, prior=(RATING, DEVIATION, VOLATILITY)) -> dict:
    """The joint posterior of a claim from entries already folded by root: standing, witnesses, iterations, information.

    Each root has a latent performance near the claim's strength, as far as its precision lets it; its games only inform
    about that. So repeating one root sharpens what it says but never makes it two. Entries come in any order.
    """
    games, wins, trust = (np.asarray(x, float) for x in (games, wins, trust))
    size = len(games)
    opponent = np.full(size, RATING) if opponent is None else np.asarray(opponent, float)
    opponent_deviation = np.zeros(size) if opponent_deviation is None else np.asarray(opponent_deviation, float)
    witness_deviation = np.zeros(size) if witness_deviation is None else np.asarray(witness_deviation, float)
    cap = (SCALE / np.maximum(FLOOR, witness_deviation)) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        said = 3.0 * trust**2 / (math.pi**2 * (1.0 - trust**2))
    precision = np.where(trust >= 1, cap, np.minimum(said, cap))
    use = (games > 0) & (trust > 0)
    out = {"rating": prior[0], "deviation": prior[1], "volatility": prior[2], "matches": int(games.sum()), "witnesses": int(use.sum()), "iterations": 0, "information": np.zeros(size)}
    if not use.any():
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        score = 0.5 + trust * (wins / games - 0.5)
    columns = np.stack([games, score, (opponent - RATING) / SCALE, _weight(opponent_deviation), precision])[:, use]
    order = np.lexsort(columns[::-1])  # numbers decide the order of sums, not names
    columns = columns[:, order]
    mu0, phi2 = (prior[0] - RATING) / SCALE, (prior[1] / SCALE) ** 2

    def posterior(mu):
        s, info = sources(mu, *columns)
        return (mu0 - mu) / phi2 + s.sum(), info, s.sum()

    lo, hi = mu0 - 1.0, mu0 + 1.0
    while posterior(lo)[0] < 0:
        lo = mu0 - 2 * (mu0 - lo)
    while posterior(hi)[0] > 0:
        hi = mu0 + 2 * (hi - mu0)
    mu = mu0
    for k in range(64):
        slope, info, _ = posterior(mu)
        out["iterations"] = k + 1
        lo, hi = (mu, hi) if slope > 0 else (lo, mu)
        new = mu + slope / (1.0 / phi2 + info.sum())
        if not lo < new < hi:
            new = lo + 0.5 * (hi - lo)
        if new == mu or hi - lo <= 1e-12 or abs(new - mu) < 1e-15:
            mu = new
            break
        mu = new
    _, info, gain = posterior(mu)
    total = float(info.sum())
    rating, deviation, sigma = settle(mu, float(gain), total, prior)
    spread = np.zeros(size)
    spread[np.flatnonzero(use)[order]] = info
    return out | {"rating": rating, "deviation": deviation, "volatility": sigma, "information": spread}
