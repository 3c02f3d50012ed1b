"""Row-based window features per entity; no frame crosses an entity or looks ahead.

All frames of an entity share one window specification, so that they run in one
Window node over one sort. Frames hold rows, not calendar days, and give a value
only if all of their rows have one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.operators.guards import bad_return, require

#: Fixed values of the feature set.
STD_ROWS, ABS_ROWS, COMPOUND_ROWS, LAGS = (5, 21, 63, 126, 252), (5, 21, 63), (5, 21, 63), (1, 5, 21)
HORIZON, DECAY, BURN_IN = 21, 0.94, 21
#: Rows that the fold of the recursion appends to at once.
BLOCK = 256


def by_entity(entity: str, day: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(day)


def rolling(x: Column, agg, rows: int, spec: WindowSpec) -> Column:
    """``agg`` of the last ``rows`` rows, null unless all have a value."""
    frame = spec.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) == rows, agg(x).over(frame))


def rolling_std(x: Column, rows: int, spec: WindowSpec) -> Column:
    return rolling(x, F.stddev_samp, rows, spec)


def compounded(x: Column, rows: int, spec: WindowSpec) -> Column:
    """Compounded return; -1 where a full frame of rows holds a total loss, even beside a missing return.

    A return below -1 can't be compounded: its frames are null unless they hold a
    total loss. ``require_possible`` refuses a table with such returns.
    """
    frame = spec.rowsBetween(1 - rows, 0)
    lost = F.sum(F.when(x == -1, 1).otherwise(0)).over(frame) > 0
    full = F.count(F.lit(1)).over(frame) == rows
    growth = F.when(x > -1, F.log1p(x))
    return F.when(full & lost, F.lit(-1.0)).when(F.count(growth).over(frame) == rows, F.expm1(F.sum(growth).over(frame)))


def require_possible(df: DataFrame, value: str = "r") -> DataFrame:
    """``df``, refused if a return lies below -1."""
    require(df, {"below_total_loss": bad_return(value)}, "returns")
    return df


def return_features(df: DataFrame, *, entity: str = "permno", day: str = "d", value: str = "r", std: Sequence[int] = STD_ROWS, mean_abs: Sequence[int] = ABS_ROWS, compound: Sequence[int] = COMPOUND_ROWS) -> DataFrame:
    """``df`` with trailing standard deviations, mean sizes and compounded returns.

    All are sliding frames of one window over one sort. Each frame is evaluated
    from its own rows, so that an extreme reading leaves no trace in later frames.
    """
    spec, x = by_entity(entity, day), F.col(value)
    return df.withColumns(
        {f"return_std_{k}d": rolling_std(x, k, spec) for k in std} | {f"mean_abs_return_{k}d": rolling(F.abs(x), F.avg, k, spec) for k in mean_abs} | {f"compounded_return_{k}d": compounded(x, k, spec) for k in compound}
    )


def ewma_volatility(df: DataFrame, *, entity: str = "permno", day: str = "d", value: str = "r", decay: float = DECAY, burn_in: int = BURN_IN) -> DataFrame:
    """``df`` with exponentially weighted volatility of squared returns.

    The first value seeds the mean; a missing return ages it and carries it on.
    The recursion is one fold per entity over its rows in order (one per day, so
    the calendar bounds them), for histories of any length; rows are appended by
    blocks, so that its cost stays linear. Two columns hide the burn-in, counted in
    rows and in returns. The rows of a null entity are one entity of their own.
    """
    names = df.columns
    grouped = df.groupBy(F.col(entity).alias("_entity")).agg(F.sort_array(F.collect_list(F.struct(F.col(day).alias("_day"), F.col(value).cast("double").alias("_x"), F.struct(*names).alias("_row")))).alias("_items"))
    values = F.transform("_items", lambda i: i["_x"])
    none, empty = F.lit(None).cast("double"), F.array().cast("array<double>")

    def step(s: Column, x: Column) -> Column:
        aged = s["age"] * decay
        mean = F.when(x.isNull(), s["mean"]).when(s["mean"].isNull(), x * x).otherwise((aged * s["mean"] + (1 - decay) * x * x) / (aged + (1 - decay)))
        age = F.when(x.isNull() & s["mean"].isNotNull(), aged).otherwise(F.lit(1.0))
        return F.struct(F.array_append(s["out"], mean).alias("out"), mean.alias("mean"), age.alias("age"))

    def block(s: Column, at: Column) -> Column:
        start = F.struct(empty.alias("out"), s["mean"].alias("mean"), s["age"].alias("age"))
        return F.aggregate(F.slice(F.col("_values"), at, F.lit(BLOCK)), start, step, lambda r: F.struct(F.concat(s["out"], r["out"]).alias("out"), r["mean"].alias("mean"), r["age"].alias("age")))

    start = F.struct(empty.alias("out"), none.alias("mean"), F.lit(1.0).alias("age"))
    folded = grouped.withColumn("_values", values).withColumn("_mean", F.aggregate(F.sequence(F.lit(1), F.size("_values"), F.lit(BLOCK)), start, block, lambda s: s["out"]))
    flat = folded.select("_entity", F.explode(F.arrays_zip("_items", "_mean")).alias("_z")).select("_entity", F.col("_z._items._row").alias("_row"), F.sqrt("_z._mean").alias("_vol"))
    # the entity itself comes from the key, whose partitioning the windows go on with
    out = flat.select(*[F.col("_entity").alias(n) if n == entity else F.col("_row")[n].alias(n) for n in names], "_vol")
    spec = by_entity(entity, day)
    rows, valid = F.row_number().over(spec), F.count(value).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({"ewma_by_rows": F.when(rows >= burn_in, F.col("_vol")), "ewma_by_returns": F.when(valid >= burn_in, F.col("_vol"))}).drop("_vol")


def forward_target(df: DataFrame, *, entity: str = "permno", day: str = "d", value: str = "volatility_21d", horizon: int = HORIZON) -> DataFrame:
    """``df`` with the value and the day ``horizon`` rows ahead."""
    spec = by_entity(entity, day)
    return df.withColumns({"target_forward": F.lead(value, horizon).over(spec), "target_end_date": F.lead(day, horizon).over(spec)})


def log_changes(calendar: DataFrame, *, day: str, value: str, lags: Sequence[int] = LAGS) -> DataFrame:
    """Lagged log differences over a calendar (one row per day, bounded by its length); a level that isn't positive has none."""
    spec = Window.partitionBy(F.lit(1)).orderBy(day)
    return calendar.withColumns({f"log_change_{k}d": F.ln(value) - F.lag(F.ln(value), k).over(spec) for k in lags})


def split_labels(df: DataFrame, *, day: str = "d", end: str = "target_end_date", train_end: str = "2013-01-01", validation_end: str = "2015-01-01") -> DataFrame:
    """``df`` with train / validation / test and the flag of targets that cross a boundary."""
    a, b = F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    split = F.when(F.col(day) < a, "train").when(F.col(day) < b, "validation").when(F.col(day) >= b, "test")
    crosses = ((F.col("split") == "train") & (F.col(end) >= a)) | ((F.col("split") == "validation") & (F.col(end) >= b))
    return df.withColumn("split", split).withColumn("crosses_split_boundary", F.coalesce(crosses, F.lit(False)))


def sample_masks(df: DataFrame, *, finite: Column, day: str = "d", end: str = "target_end_date", validation_end: str = "2015-01-01") -> DataFrame:
    """``df`` with eligibility and the masks of tuning, validation, final refit and test.

    The final refit readmits rows whose target crosses the first boundary.
    """
    eligible = finite & ~F.col("crosses_split_boundary")
    limit = F.lit(validation_end).cast("date")
    refit = finite & (F.col(day) < limit) & F.coalesce(F.col(end) < limit, F.lit(False))
    return df.withColumn("eligible", eligible).withColumns({
        "tuning_train": F.col("eligible") & (F.col("split") == "train"), "validation": F.col("eligible") & (F.col("split") == "validation"),
        "final_refit": refit, "test": F.col("eligible") & (F.col("split") == "test"),
    })
