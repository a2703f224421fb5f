"""Column expressions for ages, decay and composite scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemograph import params as P

DAY_MICROS = 86_400_000_000


def as_time(as_of) -> Column:
    """``as_of`` given as a Column, a datetime or a UTC string."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def rounded(x, digits: int = 4) -> Column:
    """Half-up rounding in plain IEEE arithmetic.

    Decimal inputs make exact ties common, and the order of a distributed sum
    moves its last bits, so what lies a hair below a tie rounds up as well.
    """
    scale = 10.0 ** digits
    return F.floor(x * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def age_days(ts: Column, as_of) -> Column:
    return (F.unix_micros(as_time(as_of)) - F.unix_micros(ts)) / F.lit(float(DAY_MICROS))


def recency(ts: Column, as_of) -> Column:
    """Exponential decay; a missing time counts as now."""
    age = F.greatest(F.lit(0.0), F.coalesce(age_days(ts, as_of), F.lit(0.0)))
    return F.pow(F.lit(0.5), age / F.lit(P.HALF_LIFE_DAYS))


def is_dormant(ts: Column, as_of) -> Column:
    return F.coalesce(age_days(ts, as_of) > F.lit(P.DORMANT_DAYS), F.lit(True))


def truthy(x: Column) -> Column:
    """NULL for empty strings, so that coalesce() follows ``a or b``."""
    return F.when(x != F.lit(""), x)


def nonzero(x: Column) -> Column:
    return F.when(x != F.lit(0), x)


def importance(type_: Column) -> Column:
    expr = F.lit(P.DEFAULT_IMPORTANCE)
    by_score: dict[float, list[str]] = {}
    for name, score in P.IMPORTANCE.items():
        by_score.setdefault(score, []).append(name)
    chain = None
    for score, names in by_score.items():
        cond = type_.isin(names)
        chain = F.when(cond, score) if chain is None else chain.when(cond, score)
    return chain.otherwise(expr)


def layer(type_: Column, given: Column | None = None) -> Column:
    inferred = (
        F.when(type_.isin(P.COGNITIVE_TYPES), "cognitive")
        .when(type_.isin(P.EXECUTION_TYPES), "execution")
        .otherwise("meta")
    )
    return inferred if given is None else F.coalesce(truthy(given), inferred)


def arbitration_violation(type_: Column, agent: Column) -> Column:
    named = F.coalesce(agent, F.lit("")) != ""
    return type_.isin(P.CURATOR_TYPES) & named & (agent != P.CURATOR)


def linked_score(linked: Column) -> Column:
    return 1.0 - F.exp(-linked / F.lit(5.0))


def salience(imp: Column, ts: Column, unresolved: Column, linked: Column, as_of,
             relevance: Column | float = 0.0) -> Column:
    rel = relevance if isinstance(relevance, Column) else F.lit(float(relevance))
    return rounded(
        P.W_IMPORTANCE * F.coalesce(nonzero(imp), F.lit(P.DEFAULT_IMPORTANCE))
        + P.W_RECENCY * recency(ts, as_of)
        + P.W_RELEVANCE * rel
        + P.W_UNRESOLVED * F.when(unresolved != 0, 1.0).otherwise(0.0)
        + P.W_LINKED * linked_score(F.coalesce(linked, F.lit(0)))
    )


def base_activation(imp: Column, ts: Column, unresolved: Column, reinforced: Column,
                    as_of) -> Column:
    return rounded(
        0.5 * F.coalesce(nonzero(imp), F.lit(P.DEFAULT_IMPORTANCE))
        + 0.3 * recency(ts, as_of)
        + 0.2 * F.when(unresolved != 0, P.UNRESOLVED_SEED).otherwise(0.0)
        + F.least(F.lit(P.REINFORCE_CAP), P.REINFORCE_STEP * F.coalesce(reinforced, F.lit(0)))
    )


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
