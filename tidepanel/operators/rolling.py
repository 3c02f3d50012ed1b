"""Totals and averages over trailing calendar periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(rows: DataFrame, *, entity: Column, day: Column, value: Column, order: Column, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """(entity, day, total_k, average_k, values_k) for every calendar day of each entity and each period k.

    Each (entity, day) counts once, with its latest delivery (greatest ``order``)
    that has a value. Prefix sums and counts run over the days with rows, are
    carried forward over the gap to the next such day, and a trailing figure is
    the difference of two prefixes. The first and last day are those of the
    entity's rows, with or without a value.

    Null, NaN and infinite values count as no value; where a period has none,
    total and average are null and values_k is 0. Rows without entity or day are
    left out. The fold to days happens map-side first, so that an entity with
    very many deliveries is bounded by its calendar.
    """
    number = value.cast("double")
    real = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number)
    base = rows.select(entity.alias("entity"), day.cast("date").alias("day"), real.alias("value"), order.cast("long").alias("order"))
    days = base.filter("entity is not null and day is not null").groupBy("entity", "day").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.coalesce("order", F.lit(-1)))).alias("value"))
    by = Window.partitionBy("entity").orderBy("day")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    prefixed = days.select(
        "entity", "day", F.coalesce(F.sum("value").over(upto), F.lit(0.0)).alias("sum"), F.count("value").over(upto).alias("n"),
        F.coalesce(F.date_sub(F.lead("day").over(by), 1), F.col("day")).alias("until"),
    )
    dense = prefixed.select("entity", F.explode(F.sequence("day", "until")).alias("day"), "sum", "n")
    out = [F.col("entity"), F.col("day")]
    for k in periods:
        n = F.col("n") - F.lag("n", k, 0).over(by)
        total = F.when(n > 0, F.col("sum") - F.lag("sum", k, 0.0).over(by))
        out += [total.alias(f"total_{k}"), (total / n).alias(f"average_{k}"), n.alias(f"values_{k}")]
    return dense.select(*out)


def idle_days(rows: DataFrame, *, entity: Column, day: Column, value: Column, order: Column, period: int = 7) -> DataFrame:
    """(entity, day) of the calendar days whose trailing ``period`` holds no value."""
    return trailing_totals(rows, entity=entity, day=day, value=value, order=order, periods=(period,)).filter(F.col(f"values_{period}") == 0).select("entity", "day")
