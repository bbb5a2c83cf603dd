"""Vertex metadata in one whole number: run (30 bits), said (3), outcome (2), position (18); and outcomes as scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_BITS, SAID_SHIFT, OUTCOME_SHIFT, POSITION_SHIFT, POSITION_MAX = 30, 30, 33, 35, (1 << 18) - 1
WIN, DRAW, LOSS, SCORE = 0, 1, 2, 3
SCORE_TAG, SCORE_ONE, TAG_BITS, SPARE_BITS = 1, 1 << 24, 4, 28


def _big(x: Column) -> Column:
    return x.cast("bigint")


def bits(m: Column) -> Column:
    """The metadata of a double: below 1 (or no number) it says 1."""
    return F.when((m >= 1) & (m < 2.0**63), _big(m)).otherwise(F.lit(1).cast("bigint"))


def run(m: Column) -> Column:
    r = bits(m).bitwiseAND(F.lit((1 << RUN_BITS) - 1))
    return F.when(r == 0, 1).otherwise(r)


def said(m: Column) -> Column:
    return F.shiftright(bits(m), SAID_SHIFT).bitwiseAND(F.lit(7))


def outcome(m: Column) -> Column:
    return F.shiftright(bits(m), OUTCOME_SHIFT).bitwiseAND(F.lit(3))


def position(m: Column) -> Column:
    return F.shiftright(bits(m), POSITION_SHIFT).bitwiseAND(F.lit(POSITION_MAX))


def pack(run_: Column, said_: Column, outcome_: Column | None = None, position_: Column | None = None) -> Column:
    """All four in one bigint; a run of 0 is written 1, positions saturate."""
    out = F.shiftleft(_big(said_).bitwiseAND(F.lit(7)), SAID_SHIFT).bitwiseOR(F.when(run_ == 0, F.lit(1).cast("bigint")).otherwise(_big(run_)))
    if outcome_ is not None:
        out = out.bitwiseOR(F.shiftleft(_big(outcome_).bitwiseAND(F.lit(3)), OUTCOME_SHIFT))
    if position_ is not None:
        out = out.bitwiseOR(F.shiftleft(F.least(_big(position_), F.lit(POSITION_MAX).cast("bigint")), POSITION_SHIFT))
    return out


def spare(tag: Column, payload: Column) -> Column:
    """28 spare bits: a tag of 4 above a payload of 24."""
    return F.shiftleft(_big(tag).bitwiseAND(F.lit(15)), SPARE_BITS - TAG_BITS).bitwiseOR(_big(payload).bitwiseAND(F.lit((1 << 24) - 1)))


def spare_tag(s: Column) -> Column:
    return F.shiftright(_big(s), 24).bitwiseAND(F.lit(15))


def spare_payload(s: Column) -> Column:
    return _big(s).bitwiseAND(F.lit((1 << 24) - 1))


def outcome_of(score: Column) -> Column:
    """struct(outcome, spare) that a score in [0, 1] is written with; what isn't below 1 wins, what isn't above 0 loses."""
    payload = F.least(F.greatest(_big(F.floor(score * SCORE_ONE + 0.5)), F.lit(1).cast("bigint")), F.lit(SCORE_ONE - 1).cast("bigint"))
    nan = F.isnan(score)
    code = F.when((score >= 1) | nan, WIN).when(score == 0.5, DRAW).when(score <= 0, LOSS).otherwise(SCORE)
    return F.struct(code.alias("outcome"), F.when(code == SCORE, spare(F.lit(SCORE_TAG), payload)).otherwise(F.lit(0).cast("bigint")).alias("spare"))


def outcome_score(outcome_: Column, spare_: Column) -> Column:
    carried = F.when(spare_tag(spare_) == SCORE_TAG, spare_payload(spare_) / F.lit(float(SCORE_ONE))).otherwise(1.0)
    return F.when(outcome_ == WIN, 1.0).when(outcome_ == DRAW, 0.5).when(outcome_ == LOSS, 0.0).otherwise(carried)


def score_carried(score: Column) -> Column:
    """A score as it is read back."""
    o = outcome_of(score)
    return outcome_score(o["outcome"], o["spare"])
