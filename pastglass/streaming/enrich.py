"""Stream-static enrichment: events of a stream with frozen boundaries or lookup tables (an extension).

The frozen state is a plain table, so the same column expressions serve batch and stream, and no streaming state is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastglass.operators.state import current


def with_frozen_state(stream: DataFrame, frozen: DataFrame, entity: str, n: str, rates: Sequence[str]) -> DataFrame:
    """stream (or batch) rows with n_period and cur_<rate> against frozen boundaries (see operators.state.boundary)."""
    state = frozen.select(F.col(entity).alias("__e"), F.struct("n0", *[f"c_{r}" for r in rates]).alias("was_0"))
    out = stream.join(state, F.col(entity) == F.col("__e"), "left")
    return out.withColumns({"n_period": F.col(n) - F.col("was_0.n0"), **{f"cur_{r}": current(n, r)[1] for r in rates}}).drop("__e", "was_0")
