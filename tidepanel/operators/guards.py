"""Data-quality guards: each is one aggregate that counts violations.

A guard returns a Column for :func:`violations`, so that the guards of a table
share one job; :func:`require` raises on the driver.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import all_true, any_true, close_to, finite


class GuardError(ValueError):
    """A table breaks a rule that the computation relies on."""


def count_true(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each rule."""
    return df.agg(*[count_true(c).alias(n) for n, c in rules.items()])


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Several tables of one row of counts as one row: their figures by name are united and summed up, without a join."""
    long = [p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in p.columns]))) for p in parts]
    return reduce(DataFrame.unionByName, long).agg(*[F.sum(F.when(F.col("name") == c, F.col("n"))).alias(c) for p in parts for c in p.columns])


def require(df: DataFrame, rules: dict[str, Column], label: str) -> None:
    row = violations(df, rules).first().asDict()
    if bad := {k: v for k, v in row.items() if v}:
        raise GuardError(f"{label}: {bad}")


def require_columns(df: DataFrame, names: list[str], label: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise KeyError(f"{label} is missing columns: {missing}")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: list[str], label: str) -> None:
    extra = duplicate_keys(df, key).agg(F.sum(F.col("n") - 1)).first()[0]
    if extra:
        raise GuardError(f"{label} has {extra} repeated keys")


def require_known(child: DataFrame, parent: DataFrame, key: str, label: str) -> None:
    """Every key of ``child`` occurs in ``parent``."""
    lost = child.select(key).dropna().distinct().join(parent.select(key), key, "left_anti").count()
    if lost:
        raise GuardError(f"{label}: {lost} keys are unknown")


def require_rows(df: DataFrame, n: int, label: str) -> None:
    if (have := df.count()) != n:
        raise GuardError(f"{label} has {have} rows, not {n}")


def bad_interval(start: str, end: str) -> Column:
    return F.col(start).isNull() | F.col(end).isNull() | (F.col(start) > F.col(end))


def bad_return(value: str) -> Column:
    return F.coalesce(F.col(value) < -1, F.lit(False))


def bad_target(value: str) -> Column:
    return F.coalesce(F.col(value) < 0, F.lit(False))


def bad_window(origin: str, end: str) -> Column:
    return F.col(origin).isNull() | F.coalesce(F.col(end) <= F.col(origin), F.lit(False))


def bad_forecasts(columns: list[str]) -> Column:
    """Rows without complete, finite and positive values."""
    return ~all_true([finite(F.col(c)) & (F.col(c) > 0) for c in columns])


def outside_domain(column: str, domain: list[str]) -> Column:
    return ~F.coalesce(F.col(column).isin(domain), F.lit(False))


def bad_parameters(omega: str = "omega", alpha: str = "alpha", beta: str = "beta", initial: str = "initial") -> Column:
    """Fitted variance parameters that aren't positive and stationary; rows without a fit pass."""
    o, a, b, h = (F.col(x) for x in (omega, alpha, beta, initial))
    good = all_true([finite(x) for x in (o, a, b, h)]) & (o > 0) & (a >= 0) & (b >= 0) & (a + b < 1) & (h > 0)
    return o.isNotNull() & ~good


def inconsistent_log(value: str, log_value: str) -> Column:
    """A stored logarithm that isn't that of its value."""
    return ~close_to(F.col(log_value), F.ln(value))


def inconsistent_flag(flag: str, rule: Column) -> Column:
    """A stored flag that isn't what its rule gives, null counting as false."""
    return F.coalesce(F.col(flag), F.lit(False)) != F.coalesce(rule, F.lit(False))


def empty_masks(df: DataFrame, masks: list[str]) -> DataFrame:
    """One row with the number of masks that hold no row."""
    held = df.agg(*[F.coalesce(F.bool_or(m), F.lit(False)).alias(m) for m in masks])
    return held.select(sum((F.when(F.col(m), 0).otherwise(1) for m in masks), F.lit(0)).cast("long").alias("empty_masks"))


def require_digest(found: str, locked: str, label: str) -> None:
    """A digest equals the one that was locked."""
    if found != locked:
        raise GuardError(f"{label}: the digest is {found}, not {locked}")


def require_ordered(low: float | None, high: float | None, label: str) -> None:
    if low is None or high is None or not low < high:
        raise GuardError(f"{label}: thresholds {low} and {high} aren't in order")


def require_partition(groups: dict[str, list[str]], names: list[str], label: str) -> None:
    """Every name is in exactly one group, and nothing else is."""
    held = sorted(n for g in groups.values() for n in g)
    if held != sorted(names):
        raise GuardError(f"{label}: the groups don't divide the columns")


def require_same_identity(documents: dict[str, dict], fields: list[str]) -> None:
    """Metadata documents that belong together agree in ``fields`` (hashes, order of features)."""
    for f in fields:
        seen = {name: repr(d.get(f)) for name, d in documents.items()}
        if len(set(seen.values())) > 1:
            raise GuardError(f"{f} differs: {sorted(seen)}")


def index_rules(first: date, last: date, columns: tuple[str, str, str, str] = ("vixo", "vixh", "vixl", "vix_close"), day: str = "date") -> dict[str, Column]:
    """Rules of a daily index level: partial rows, signs, ranges and the sample period."""
    opening, high, low, close = (F.col(c) for c in columns)
    nulls = [F.col(c).isNull() | F.isnan(c) for c in columns]
    empty = all_true(nulls)
    return {
        "missing_date": F.col(day).isNull(),
        "placeholder": empty,
        "partial": any_true(nulls) & ~empty,
        "not_positive": any_true([F.coalesce(F.col(c) <= 0, F.lit(False)) for c in columns]),
        "close_outside": F.coalesce((high < low) | ~close.between(low, high), F.lit(False)) & ~any_true(nulls),
        "open_outside": F.coalesce(~opening.between(low, high), F.lit(False)) & ~any_true(nulls),
        "outside_sample": F.coalesce(~F.col(day).between(F.lit(first), F.lit(last)), F.lit(False)),
    }
