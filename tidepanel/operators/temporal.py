"""Temporal joins: spells, validity intervals, event windows and calendars.

Every join has an equi key beside the dates. Interval and event tables are folded
to one array per entity first, so that a row of the panel is never multiplied
unless the semantics ask for it; the folded side is broadcast only if small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import sized

#: End of intervals that are open.
FAR = "9999-12-31"


def open_end(end: Column) -> Column:
    return F.coalesce(end, F.lit(FAR).cast("date"))


def overlapping(df: DataFrame, start: str, end: str, first: str, last: str) -> DataFrame:
    """Intervals that meet [first, last]; a null end is open."""
    return df.filter((F.col(start) <= F.lit(last).cast("date")) & (open_end(F.col(end)) >= F.lit(first).cast("date")))


def clipped(df: DataFrame, start: str, end: str, first: str, last: str) -> DataFrame:
    """Overlapping intervals cut to [first, last]."""
    return overlapping(df, start, end, first, last).withColumns({start: F.greatest(F.col(start), F.lit(first).cast("date")), end: F.least(open_end(F.col(end)), F.lit(last).cast("date"))})


def membership_flag(rows: DataFrame, spells: DataFrame, *, entity: str = "permno", day: str = "dlycaldt", start: str = "universe_start", end: str = "universe_end", flag: str = "in_sp500_membership") -> DataFrame:
    """``rows`` with True where the day lies in any closed spell of the entity, else False.

    Never multiplies rows; spells with a null bound count for nothing.
    """
    folded = spells.filter(f"{start} is not null and {end} is not null").groupBy(F.col(entity).alias("_e")).agg(F.collect_set(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("_spells"))
    joined = rows.join(sized(folded), F.col(entity) == F.col("_e"), "left")
    inside = F.exists("_spells", lambda s: F.col(day).between(s["a"], s["b"]))
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("_e", "_spells")


def validity_join(rows: DataFrame, links: DataFrame, *, on: str, day: str, start: str = "linkdt", end: str = "linkenddt", take: list[str]) -> DataFrame:
    """Inner join to the intervals valid on ``day``; several matches give several rows, none drops the row."""
    right = links.select(F.col(on).alias("_k"), F.col(start).alias("_a"), open_end(F.col(end)).alias("_b"), *take)
    return rows.join(right, (F.col(on) == F.col("_k")) & F.col(day).between(F.col("_a"), F.col("_b"))).drop("_k", "_a", "_b")


def unmatched_keys(rows: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of ``rows`` that ``matched`` lacks."""
    return rows.select(*key).distinct().join(matched.select(*key), key, "left_anti")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def event_prefixes(events: DataFrame, *, entity: str, event: str) -> DataFrame:
    """(_e, _first, _months): per entity, for each month from its first to its last event, the distinct event days before it and a bit for each in it.

    An entity's months are bounded by the calendar, however many events repeat.
    """
    days = events.filter(F.col(entity).isNotNull() & F.col(event).isNotNull()).select(F.col(entity).alias("_e"), _month(F.col(event)).alias("month"), F.col(event).alias("day"))
    bits = days.groupBy("_e", "month").agg(F.bit_or(_bit(F.dayofmonth("day") - 1)).alias("bits"))
    every = bits.groupBy("_e").agg(F.explode(F.sequence(F.min("month"), F.max("month"))).alias("month"))
    dense = every.join(bits, ["_e", "month"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    before = F.coalesce(F.sum(F.bit_count("bits")).over(Window.partitionBy("_e").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = dense.withColumn("before", before)
    return rows.groupBy("_e").agg(F.min("month").alias("_first"), F.sort_array(F.collect_list(F.struct("month", "before", "bits"))).alias("_months"))


def forward_event_count(windows: DataFrame, events: DataFrame, *, entity: str = "permno", origin: str = "dlycaldt", end: str = "target_end_date", event: str = "anndats") -> DataFrame:
    """``windows`` with the number of distinct event days in (origin, end] and a flag.

    The count is the difference of two prefix counts, each one look-up by month,
    whatever the number of events. Null origin or end: both null. No events, or an
    end before the origin: 0 and False. Repeated events count once.
    """
    joined = windows.join(sized(event_prefixes(events, entity=entity, event=event)), F.col(entity) == F.col("_e"), "left")
    last = F.element_at("_months", -1)

    def upto(day: Column) -> Column:
        at = _month(day) - F.col("_first")
        here = F.get("_months", at)
        inside = here["before"] + F.bit_count(here["bits"].bitwiseAND(_bit(F.dayofmonth(day)) - 1))
        return F.when(F.col("_e").isNull() | (at < 0), F.lit(0)).when(at >= F.size("_months"), last["before"] + F.bit_count(last["bits"])).otherwise(inside)

    known = F.col(end).isNotNull() & F.col(origin).isNotNull()
    count = F.when(known, F.greatest(upto(F.col(end)) - upto(F.col(origin)), F.lit(0)).cast("long"))
    return joined.withColumn("event_count", count).withColumn("has_event", F.col("event_count") > 0).drop("_e", "_first", "_months")


def calendar_gaps(days: DataFrame, series: DataFrame, *, day: str, series_day: str) -> DataFrame:
    """Distinct days that ``series`` lacks."""
    return days.select(F.col(day).alias("missing_day")).dropna().distinct().join(series.select(F.col(series_day).alias("missing_day")), "missing_day", "left_anti")


def on_calendar(days: DataFrame, series: DataFrame, *, day: str, series_day: str, value: str) -> DataFrame:
    """The series on each distinct day; null in gaps, days outside the calendar left out."""
    calendar = days.select(F.col(day)).dropna().distinct()
    return calendar.join(series.select(F.col(series_day).alias(day), value), day, "left")
