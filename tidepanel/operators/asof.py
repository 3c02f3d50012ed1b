"""Attributes as known at event time.

Dated intervals, each known only from a day on, are turned per entity into
availability-ordered versions: the value in force from a day until the next
version. Events and intervals are hash-partitioned by entity (entities with very
many events by a salt too), and each bucket is joined by an embedded duckdb
ASOF LEFT JOIN.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import sized, staged

#: Events a bucket is meant to hold; entities with more are salted.
BUCKET_ROWS = 150_000
#: Day number of an interval that doesn't end.
OPEN_END = 2_932_896


def versions(intervals: Iterable[tuple[int, int, tuple, Any]]) -> list[tuple[int, Any]]:
    """(day, value) from which each value holds, of intervals (from, until, rank, value), ends included.

    Of several intervals in force the one of the highest rank holds, so that ties
    are resolved before any join; None where none is in force.
    """
    waiting = sorted(intervals, key=lambda x: x[0])
    points = sorted({x[0] for x in waiting} | {x[1] + 1 for x in waiting})
    ranked = {r: k for k, r in enumerate(sorted({x[2] for x in waiting}, reverse=True))}
    live: list[tuple[int, int, Any]] = []
    out: list[tuple[int, Any]] = []
    at = 0
    for point in points:
        while at < len(waiting) and waiting[at][0] <= point:
            heapq.heappush(live, (ranked[waiting[at][2]], at, waiting[at]))
            at += 1
        while live and live[0][2][1] < point:
            heapq.heappop(live)
        value = live[0][2][3] if live else None
        if not out or out[-1][1] != value:
            out.append((point, value))
    return out


def attribute_intervals(df: DataFrame, *, entity: Column, start: Column, end: Column, known: Column, value: Column, tie: Column, name: str) -> DataFrame:
    """Distinct intervals in the common form (entity, name, since, until, known, tie, value).

    An interval holds from the later of ``start`` and ``known`` to ``end``
    (null: open). Rows without entity, start or day of knowledge, and intervals
    over before they were known, never hold and are dropped; exact repeats fold.
    """
    day = lambda c: F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    return df.select(
        entity.cast("long").alias("entity"), F.lit(name).alias("name"), F.greatest(day(start), day(known)).alias("since"), F.coalesce(day(end), F.lit(OPEN_END)).alias("until"),
        day(known).alias("known"), tie.cast("string").alias("tie"), value.cast("string").alias("value"), start.isNotNull().alias("begun"),
    ).filter("entity is not null and begun and known is not null and since <= until").drop("begun").distinct()


def asof_attributes(events: DataFrame, intervals: DataFrame, names: list[str], *, record: Column, entity: Column, time: Column, carry: dict[str, Column] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(record, the ``carry`` columns as strings, one string column per name): what held and was known at ``time``.

    Of several intervals of a name the one known last holds; then the greatest
    ``tie``, then the greatest value. Null where none holds, where the event has no
    entity or time. Every delivery of an event keeps its own row.
    """
    spark = events.sparkSession
    carry = carry or {}
    rows = events.select(record.cast("long").alias("record"), entity.cast("long").alias("entity"), F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), *(c.cast("string").alias(f"carry_{k}") for k, c in carry.items()))
    counts = staged(rows.groupBy("entity").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_rows))
    hot = sized(counts.filter(F.col("n") > bucket_rows).select("entity", F.ceil(F.col("n") / bucket_rows).cast("int").alias("salts")))
    one = F.coalesce("salts", F.lit(1))
    bucket = F.pmod(F.xxhash64("entity", "salt"), F.lit(buckets)).cast("int")
    left = rows.join(hot, "entity", "left").withColumn("salt", F.pmod(F.xxhash64("record"), one).cast("int")).select(bucket.alias("bucket"), "record", "entity", "day", *(f"carry_{k}" for k in carry))
    right = intervals.join(hot, "entity", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).select(bucket.alias("bucket"), "entity", "name", "since", "until", "known", "tie", "value")

    kept = list(carry)
    out = pa.schema([("record", pa.int64()), *((k, pa.string()) for k in kept), *((n, pa.string()) for n in names)])

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        import duckdb

        if not a.num_rows:
            return out.empty_table()
        known: dict[tuple[str, int], list] = {}
        t = b.to_pydict()
        for e, n, s, u, k, tie, v in zip(*(t.get(c, []) for c in ("entity", "name", "since", "until", "known", "tie", "value")), strict=True):
            known.setdefault((n, e), []).append((s, u, (k, tie or "", v or ""), v))
        con = duckdb.connect(config={"threads": 1})
        con.register("events", a)
        picks, joins = [], []
        for i, name in enumerate(names):
            flat = [(e, day, v) for (n, e), x in known.items() if n == name for day, v in versions(x)]
            con.register(f"v{i}", pa.table({"entity": pa.array([x[0] for x in flat], pa.int64()), "since": pa.array([x[1] for x in flat], pa.int32()), "value": pa.array([x[2] for x in flat], pa.string())}))
            picks.append(f'v{i}.value as "{name}"')
            joins.append(f"asof left join v{i} on e.entity = v{i}.entity and e.day >= v{i}.since")
        held = ", ".join(['e.record', *(f'e.carry_{k} as "{k}"' for k in kept), *picks])
        result = con.sql(f"select {held} from events e {' '.join(joins)}").to_arrow_table()
        con.close()
        return result.cast(out)

    kinds = ", ".join(["record long", *(f"`{k}` string" for k in carry), *(f"`{n}` string" for n in names)])
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(join, kinds)

