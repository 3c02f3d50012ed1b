"""References to records that do not exist, are withdrawn or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import sized


def padded_key(key: Column, digits: int = 6) -> Column:
    """``key`` without outer blanks, a number filled with leading zeros to ``digits``; null if nothing is left."""
    bare = F.regexp_replace(key, r"^\s+|\s+$", "")
    return F.when(bare == "", F.lit(None)).when(bare.rlike(rf"^\d{{1,{digits - 1}}}$"), F.lpad(bare, digits, "0")).otherwise(bare)


def orphan_references(child: DataFrame, parent: DataFrame, *, record: Column, reference: Column, at: Column, key: Column, known: Column | None = None, valid: Column | None = None, period: Column | None = None) -> DataFrame:
    """Rows of ``child`` whose ``reference`` has no ``parent``: (record, reference, period, reason).

    A parent counts if ``valid`` holds (default: all) and it was ``known`` not
    later than the child's ``at`` (default: always). ``reason`` is 'missing' or,
    if the parent became known only after the child, 'late'.

    The distinct non-null references, with their earliest use, go through a left
    anti-join against the parent keys, with the time each became known; what is
    left is joined back to the rows. Null references are no orphans. A child
    without time counts as read now. Repeated rows are reported each; an empty
    parent makes every reference an orphan; other columns are ignored.
    """
    always = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    now = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    rows = child.select(record.alias("record"), reference.alias("reference"), F.coalesce(at.cast("timestamp_ntz"), now).alias("at"), (period if period is not None else F.lit(None).cast("string")).alias("period")).filter("reference is not null")
    parents = parent if valid is None else parent.filter(valid)
    since = always if known is None else known.cast("timestamp_ntz")
    parents = parents.select(key.alias("reference"), since.alias("known")).filter("reference is not null and known is not null").groupBy("reference").agg(F.min("known").alias("known"))
    used = rows.groupBy("reference").agg(F.min("at").alias("earliest"))
    suspects = used.alias("u").join(parents.alias("p"), (F.col("u.reference") == F.col("p.reference")) & (F.col("p.known") <= F.col("u.earliest")), "left_anti")
    suspects = sized(suspects.join(parents, "reference", "left").select("reference", "known"))
    return rows.join(suspects, "reference").filter("known is null or known > at").select(
        "record", "reference", "period", F.when(F.col("known").isNull(), "missing").otherwise("late").alias("reason")
    )


def orphan_counts(orphans: DataFrame, name: str) -> DataFrame:
    """Orphans per period and reason: (source_table, period, reason, orphans, distinct_references)."""
    return orphans.groupBy("period", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("reference").alias("distinct_references")).select(F.lit(name).alias("source_table"), "period", "reason", "orphans", "distinct_references")
