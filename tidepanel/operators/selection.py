"""Rows of the smallest random keys per category, without ranking whole categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import sized

#: Hex digits of a priority that a histogram cuts at once (16**3 bins a category), and rows that one task may rank.
BIN_DIGITS, RANKED_ROWS = 3, 100_000
#: Hex digits of a priority.
DIGITS = 32


def priority(seed: str, *parts: Column) -> Column:
    """A uniform, reproducible rank of a record: md5 of the seed and its key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def smallest(rows: DataFrame, quotas: DataFrame | int, category: Sequence[str], key: Sequence[str], ranked: int = RANKED_ROWS, skip: int = 0) -> DataFrame:
    """Per category the ``quota`` rows of the smallest ``priority``; ties by ``key``.

    ``quotas`` has the category columns and ``quota``, or is the number to take of all
    rows where there is no category. A histogram of priority prefixes, counted
    map-side, shows which bins are taken whole and in which one the quota ends;
    that bin is cut by the next digits until it holds at most ``ranked`` rows, and
    only then ranked. So a category holding a third of all rows never meets in one
    task, however many rows there are. Categories without quota give nothing.
    """
    category = list(category)
    binned = rows.withColumn("_bin", F.substring("priority", skip + 1, BIN_DIGITS))
    # a small table: at most 16**3 bins a category
    by = (Window.partitionBy(*category) if category else Window.partitionBy(F.lit(1))).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*category, "_bin").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(by))
    given = counts.withColumn("quota", F.lit(quotas)) if isinstance(quotas, int) else counts.join(sized(quotas), category)
    cuts = given.withColumn("_need", F.col("quota") - (F.col("_upto") - F.col("_n"))).filter("_need > 0")
    cuts = sized(cuts.select(*category, "_bin", "_n", "_need", (F.col("_need") >= F.col("_n")).alias("_whole")))
    taken = binned.join(cuts, [*category, "_bin"])
    whole = taken.filter("_whole").select(*rows.columns)
    edge = taken.filter("not _whole")
    most = cuts.filter("not _whole").agg(F.max("_n")).first()[0] or 0
    if not most:
        return whole
    if most > ranked and skip + BIN_DIGITS < DIGITS:
        rest = cuts.filter("not _whole").select(*category, F.col("_need").alias("quota"))
        return whole.unionByName(smallest(edge.select(*rows.columns), rest if category else int(rest.first()[0]), category, key, ranked, skip + BIN_DIGITS))
    order = Window.partitionBy(*category, "_bin").orderBy("priority", *key)
    part = edge.withColumn("_k", F.row_number().over(order)).filter("_k <= _need")
    return whole.unionByName(part.select(*rows.columns))
