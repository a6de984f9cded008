"""As-of state of entities at period boundaries, and what is derived from it.

One rule holds throughout: a row of period s sees only periods before s. It lives in prior_state, as a range frame
over one row per entity and period; the fact table is aggregated once and joined once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastglass.functions.scalars import clip, counted


def last_of_period(rows: DataFrame, entity: str, period: str, n: str, rates: Sequence[str], outcome: str | None = None) -> DataFrame:
    """(entity, period, last): the row of the greatest counter of each period as a struct, with whole counts.

    Ties are decided by the greater values, in order. With an outcome the last trial is included: n + 1, and its
    outcome (missing: 0) is added to the first rate's count. Null entities and counters have no state.
    """
    counts = [counted(F.col(n), F.col(r)) for r in rates]
    at = F.col(n)
    if outcome:
        counts[0] = counts[0] + F.coalesce(F.col(outcome), F.lit(0))
        at = at + 1
    last = F.struct(at.cast("double").alias("n0"), *[c.alias(f"c_{r}") for c, r in zip(counts, rates)])
    keyed = rows.filter(F.col(entity).isNotNull() & F.col(n).isNotNull() & F.col(period).isNotNull())
    return keyed.groupBy(entity, period).agg(F.max(last).alias("last"))


def boundary(rows: DataFrame, entity: str, period: str, upto: int, n: str, rates: Sequence[str], outcome: str | None = None) -> DataFrame:
    """(entity, n0, c_<rate>...): each entity's state from the periods before `upto`."""
    last = last_of_period(rows.filter(F.col(period) < upto), entity, period, n, rates, outcome)
    return last.groupBy(entity).agg(F.max("last").alias("last")).select(entity, "last.*")


def prior_state(rows: DataFrame, entity: str, period: str, n: str, rates: Sequence[str], outcome: str | None = None, back: Sequence[int] = (0,)) -> DataFrame:
    """(entity, period, was_0, was_w...): the state at the start of each period, and w dense periods earlier.

    Dense: the w-th distinct period before, whether or not the entity was there. Null where nothing was before.
    """
    last = last_of_period(rows, entity, period, n, rates, outcome)
    line = Window.orderBy(period)  # one row per distinct period
    index = last.groupBy(period).agg(F.lit(1).alias("__one")).select(F.col(period).alias("__p"), F.row_number().over(line).alias("__i"))
    last = last.join(index, F.col(period) == F.col("__p"))
    w = Window.partitionBy(entity).orderBy("__i")
    return last.select(entity, period, *[F.max("last").over(w.rangeBetween(Window.unboundedPreceding, -1 - k)).alias(f"was_{k}") for k in back])


def with_state(rows: DataFrame, state: DataFrame, entity: str, period: str) -> DataFrame:
    """rows with the state of their entity and period; all rows are kept."""
    s = state.select(F.col(entity).alias("__e"), F.col(period).alias("__p"), *[c for c in state.columns if c not in (entity, period)])
    return rows.join(s, (F.col(entity) == F.col("__e")) & (F.col(period) == F.col("__p")), "left").drop("__e", "__p")


def current(n: str, rate: str, was: str = "was_0") -> tuple[Column, Column]:
    """(trials of this period so far, their rate); the rate is null unless the entity was seen and has some."""
    here = F.col(n) - F.col(f"{was}.n0")
    return here, F.when(here > 0, (counted(F.col(n), F.col(rate)) - F.col(f"{was}.c_{rate}")) / here)


def window_rate(rate: str, w: int) -> Column:
    """The rate over the w periods before, from two states; null without trials there or without the older state."""
    now, then = F.col("was_0"), F.col(f"was_{w}")
    n = now["n0"] - then["n0"]
    return F.when(n > 0, (now[f"c_{rate}"] - then[f"c_{rate}"]) / n)


def gated(value: Column, cells: dict[str, Column]) -> dict[str, Column]:
    """value in the one cell that holds, null in the others."""
    return {name: F.when(cond, value) for name, cond in cells.items()}


def form_adjustment(n: str, rate: str, m: float, pooled: Column | None = None) -> tuple[Column, Column]:
    """(adjustment, trials of this period): (s + m p0) / (n + m) - p0, p0 the entity's rate before the period.

    p0 of an entity without trials is the pooled rate, if one is given.
    """
    n0, c0 = F.col("was_0.n0"), F.col(f"was_0.c_{rate}")
    p0 = F.coalesce(F.when(n0 > 0, c0 / n0), *([pooled] if pooled is not None else []))
    here, got = F.col(n) - n0, counted(F.col(n), F.col(rate)) - c0
    return F.when(here >= 0, (got + m * p0) / (here + m) - p0), here


def apply_form(p: Column, adjustment: Column, mu: Column, alpha: float) -> Column:
    """p + alpha (adjustment - mu), limited to 0..1; p where there is no adjustment."""
    return clip(p + alpha * F.coalesce(adjustment - mu, F.lit(0.0)), 0.0, 1.0)


def transported(n: str, rate: str, old: str, new: str) -> tuple[Column, Column]:
    """(n', rate'): the progress within a period, put on top of the next period's starting state."""
    n2 = F.col(f"{new}.n0") + F.col(n) - F.col(f"{old}.n0")
    c2 = F.col(f"{new}.c_{rate}") + counted(F.col(n), F.col(rate)) - F.col(f"{old}.c_{rate}")
    return n2, F.when(n2 > 0, c2 / n2)


def extrapolated(periods: DataFrame, period: str, value: str) -> DataFrame:
    """(period, value, delta, forecast): forecast = value before + mean of all deltas before. One row per period."""
    line = Window.orderBy(period)  # one row per period
    d = periods.withColumn("delta", F.col(value) - F.lag(value).over(line))
    ahead = F.lag(value).over(line) + F.coalesce(F.avg("delta").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return d.withColumn("forecast", ahead)
