"""Point-in-time features of a stream of returns, with state per entity.

The recursion of the exponentially weighted volatility needs only its last value
and age, so it runs as a stateful stream: a feature of a row uses rows that came
no later. Rows of an entity must come in time order across micro-batches (within
one they are sorted); a row not later than the last one seen is dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepanel.operators.timeseries import BURN_IN, DECAY

OUT = "entity long, day date, variance double, volatility double"
STATE = "last string, variance double, aged double, seen long"


def ewma_stream(rows: DataFrame, decay: float = DECAY, burn_in: int = BURN_IN) -> DataFrame:
    """(entity, day, variance, volatility) of a stream (entity, day, value).

    The volatility is null before ``burn_in`` returns. A null or NaN value ages
    the state and carries it on. Rows without entity or day are dropped.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, variance, aged, seen = state.get if state.exists else ("", None, 1.0, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("day").itertuples(index=False):
            day = str(row.day)
            if day <= last:
                continue
            last = day
            if row.value is None or row.value != row.value:
                aged = aged * decay if variance is not None else 1.0
            else:
                square = float(row.value) ** 2
                variance = square if variance is None else (aged * decay * variance + (1 - decay) * square) / (aged * decay + 1 - decay)
                aged, seen = 1.0, seen + 1
            out.append((key[0], row.day, variance, variance**0.5 if variance is not None and seen >= burn_in else None))
        state.update((last, variance, aged, seen))
        yield pd.DataFrame(out, columns=["entity", "day", "variance", "volatility"])

    whole = rows.filter("entity is not null and day is not null").select("entity", "day", "value")
    return whole.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
