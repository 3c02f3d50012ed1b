"""Losses over conditional groups, block bootstrap and HAC inference."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import qlike
from tidepanel.session import staged

#: Fixed values of the inference.
BLOCK, REPLICATES, SEED, LAG, BOUND = 21, 2000, 42, 20, 0.05
#: Daily sums that may be sent to the tasks of a bootstrap.
CELLS = 4_000_000


def stacked_losses(panel: DataFrame, models: dict[str, str], *, actual: str, keep: Sequence[str]) -> DataFrame:
    """One row per panel row and model: the kept columns, model, squared_error, absolute_error, qlike."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("forecast")) for m, c in models.items()]))
    rows = panel.select(*keep, F.col(actual).alias("_a"), each.alias("m"))
    error = F.col("_a") - F.col("m.forecast")
    return rows.select(*keep, F.col("m.model").alias("model"), (error * error).alias("squared_error"), F.abs(error).alias("absolute_error"), qlike(F.col("_a"), F.col("m.forecast")).alias("qlike"))


def pooled_metrics() -> list[Column]:
    return [F.count("squared_error").alias("n"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("absolute_error").alias("mae"), F.avg("qlike").alias("qlike")]


def group_metrics(losses: DataFrame, *, regime: str, event: str, entity: str, day: str) -> DataFrame:
    """Metrics per model for all rows, each regime, and rows with and without an event, in one pass of grouping sets."""
    agg = losses.withColumn("event", F.when(F.col(event), "earnings").otherwise("no_earnings")).withColumn("regime", F.concat(F.lit("vix_"), F.col(regime)))
    sets = agg.groupingSets([["model"], ["model", "regime"], ["model", "event"]], "model", "regime", "event").agg(
        *pooled_metrics(), F.countDistinct(day).alias("dates"), F.countDistinct(entity).alias("entities"), F.grouping("regime").alias("gr"), F.grouping("event").alias("ge")
    )
    name = F.when((F.col("gr") == 1) & (F.col("ge") == 1), F.lit("overall")).otherwise(F.coalesce("regime", "event"))
    return sets.withColumn("grp", name).drop("regime", "event", "gr", "ge")


def block_starts(n: int, block: int = BLOCK, replicates: int = REPLICATES, seed: int = SEED) -> np.ndarray:
    """Starts of the blocks of each replicate, uniform over whole blocks (not circular)."""
    if n < block:
        raise ValueError("there are fewer dates than a block is long")
    if replicates < 1:
        raise ValueError("replicates must be positive")
    return np.random.default_rng(seed).integers(0, n - block + 1, size=(replicates, math.ceil(n / block)))


def replicate_sums(prefix: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """Sums over each replicate's dates of the series with prefix sums ``prefix`` (dates + 1, series)."""
    n = len(prefix) - 1
    tail = n - block * (starts.shape[1] - 1)
    sums = (prefix[starts[:, :-1] + block] - prefix[starts[:, :-1]]).sum(axis=1)
    return sums + prefix[starts[:, -1] + tail] - prefix[starts[:, -1]]


def bootstrap_replicates(daily: DataFrame, *, day: str, series: str, numerator: str, denominator: str, block: int = BLOCK, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(series, replicate, value): the ratio of resampled sums; replicate -1 is the estimate itself.

    ``daily`` has one row per (day, series); its size is bounded by the calendar
    times the number of series, so its matrix of prefix sums goes to every task,
    and the replicates are spread. A replicate without denominator is null.
    """
    spark = daily.sparkSession
    cells = staged(daily.select(day, series, F.col(numerator).cast("double").alias("num"), F.col(denominator).cast("double").alias("den")))
    if cells.count() > CELLS:
        raise ValueError(f"more than {CELLS} daily sums: they were expected to be bounded by the calendar and the series")
    table = cells.toArrow().to_pandas()
    days, names = sorted(table[day].unique()), sorted(table[series].unique())
    n, k = len(days), len(names)
    at, of = {x: i for i, x in enumerate(days)}, {x: i for i, x in enumerate(names)}
    cells = np.zeros((n + 1, 2 * k))
    rows, columns = table[day].map(at).to_numpy(int) + 1, table[series].map(of).to_numpy(int)
    np.add.at(cells, (rows, columns), table["num"].fillna(0).to_numpy(float))
    np.add.at(cells, (rows, columns + k), table["den"].fillna(0).to_numpy(float))
    prefix = cells.cumsum(axis=0)
    starts = block_starts(n, block, replicates, seed)
    sent = spark.sparkContext.broadcast((prefix, starts, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, starts, names = sent.value
        k = len(names)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in np.array_split(ids, max(1, len(ids) // 100)):
                sums = np.stack([prefix[-1] if i < 0 else replicate_sums(prefix, starts[i : i + 1], block)[0] for i in part])
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = sums[:, :k] / sums[:, k:]
                flat = value.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(names * len(part)), pa.array(np.repeat(part, k)), pa.array(flat, mask=~np.isfinite(flat))], names=["series", "replicate", "value"])

    return spark.range(-1, replicates, 1, max(2, min(64, replicates // 100))).mapInArrow(run, "series string, replicate long, value double")


def bootstrap_intervals(values: DataFrame) -> DataFrame:
    """(series, estimate, ci_lower, ci_upper, valid_replicates) of bootstrap values."""
    drawn = F.when(F.col("replicate") >= 0, F.col("value"))
    ends = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy("series").agg(F.max(F.when(F.col("replicate") == -1, F.col("value"))).alias("estimate"), ends.alias("e"), F.count(drawn).alias("valid_replicates")).select(
        "series", "estimate", F.col("e")[0].alias("ci_lower"), F.col("e")[1].alias("ci_upper"), "valid_replicates"
    )


def newey_west(daily: DataFrame, *, series: str, day: str, value: str, lag: int = LAG) -> DataFrame:
    """HAC mean test per series: mean, standard error, z and the lag used.

    Days without a finite value are left out before lagging. Bartlett weights,
    autocovariances over n, long-run variance not below 0. A standard error of 0
    gives z 0 for a mean of 0, else an infinite one. Fewer than two days: no row.
    """
    spec = Window.partitionBy(series).orderBy(day)
    rows = daily.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    rows = rows.withColumn("_n", F.count(value).over(Window.partitionBy(series))).withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(series))).filter("_n > 1")
    products = rows.select(series, value, "_n", *[(F.col("_c") * F.lag("_c", k).over(spec)).alias(f"_p{k}") if k else (F.col("_c") * F.col("_c")).alias("_p0") for k in range(lag + 1)])
    summed = products.groupBy(series).agg(F.first("_n").alias("dates"), F.avg(value).alias("mean_difference"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(lag + 1)])
    used = F.least(F.lit(lag), F.col("dates") - 1).cast("long")
    total = F.col("_p0")
    for k in range(1, lag + 1):
        total = total + F.when(F.lit(k) <= used, 2.0 * (1.0 - F.lit(float(k)) / (used + 1.0)) * F.col(f"_p{k}")).otherwise(0.0)
    se = F.sqrt(F.greatest(total / F.col("dates"), F.lit(0.0)) / F.col("dates"))
    mean = F.col("mean_difference")
    z = F.when(F.col("standard_error") == 0, F.when(mean == 0, F.lit(0.0)).otherwise(F.signum(mean) * F.lit(float("inf")))).otherwise(mean / F.nullif("standard_error", F.lit(0.0)))
    return summed.withColumn("standard_error", se).select(series, "dates", "mean_difference", "standard_error", z.alias("z_statistic"), used.alias("lag"))


def complementary_error(x: Column) -> Column:
    """erfc of ``x`` >= 0: 1 less a series of positive terms below 3, a continued fraction beyond."""
    state = F.struct(x.alias("sum"), x.alias("term"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * x * x / (2 * n + 1)
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), state, add, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / (2 * f))
    density = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x == float("inf"), F.lit(0.0)).when(x < 3, 1 - 2 * density * series).otherwise(density / fraction)


def with_p_value(tests: DataFrame) -> DataFrame:
    """``tests`` with the two-sided normal p-value and the 95 % interval of the mean."""
    half = 1.96 * F.col("standard_error")
    p = complementary_error(F.abs("z_statistic") / math.sqrt(2.0))
    return tests.withColumn("two_sided_p_value", p).withColumn("ci_lower", F.col("mean_difference") - half).withColumn("ci_upper", F.col("mean_difference") + half)


def positive_effect(estimate: Column, lower: Column) -> Column:
    return (estimate > 0) & (lower > 0)


def comparable(relative: Column, upper: Column, bound: float = BOUND) -> Column:
    return (relative <= 0) | (upper < bound)


def one_or_all(flags: list[bool]) -> str:
    """'full_support' if all hold, 'partial_support' if exactly one, else 'not_supported'."""
    return "full_support" if all(flags) else "partial_support" if sum(flags) == 1 else "not_supported"


def all_or_none(flags: list[bool]) -> str:
    return "full_support" if all(flags) else "not_supported"
