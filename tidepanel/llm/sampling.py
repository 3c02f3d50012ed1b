"""Samples that don't depend on layout: a growing ledger, and target proportions."""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.selection import priority, smallest
from tidepanel.session import collected, staged
from tidepanel.sources.files import exists


class SampleLedger:
    """A sample kept as a persisted ledger of (key columns, priority, generation).

    Each update appends what it selects as a generation of its own (which may be
    empty) under ``folder``; nothing written before is touched, so members stay. A ledger opened
    on a folder that has generations goes on from the last whole one.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], rate: float, seed: str) -> None:
        self.spark, self.folder, self.key, self.rate, self.seed = spark, folder, key, Fraction(str(rate)), seed
        self.generation = 0
        while exists(spark, f"{self._place(self.generation + 1)}/_SUCCESS"):
            self.generation += 1

    def _place(self, generation: int) -> str:
        return f"{self.folder}/generation-{generation:06d}"

    def read(self, generation: int | None = None) -> DataFrame | None:
        """The ledger up to ``generation`` (the last one); None before the first."""
        upto = self.generation if generation is None else generation
        return self.spark.read.parquet(*[self._place(g) for g in range(1, upto + 1)]) if upto else None

    def update(self, population: DataFrame) -> DataFrame:
        """The ledger after ``population``, distinct keys of the grown table, was seen.

        Keys of the ledger are kept by join, also if the table lost them. The
        quota, the rate of the population rounded down, is filled from unseen
        keys with the lowest priority. A smaller population adds nothing. Rows
        with a null key part aren't sampled; repeats count once.
        """
        known = population.select(*self.key).dropna().distinct()
        ledger = self.read()
        held = F.lit(None).cast("int") if ledger is None else F.col("generation")
        joined = staged((known if ledger is None else known.join(ledger.select(*self.key, "generation"), self.key, "left")).select(*self.key, held.alias("held")))
        total, present = joined.agg(F.count("*"), F.count("held")).first()
        wanted = floor(self.rate * total) - present
        unseen = joined.filter("held is null").select(*self.key, priority(self.seed, *[F.col(k) for k in self.key]).alias("priority"))
        new = smallest(unseen, max(0, wanted), [], self.key) if wanted > 0 else unseen.limit(0)
        self.generation += 1
        new.withColumn("generation", F.lit(self.generation)).write.mode("overwrite").parquet(self._place(self.generation))
        return self.read()


def allocate(n: int, shares: list[Fraction], floors: list[int], caps: list[int]) -> list[int]:
    """Whole quotas near ``shares`` of ``n``, each within its floor and cap.

    Largest remainders, ties by position. Categories beyond a bound are set to it
    and the rest shared again; floors are kept even if they exceed ``n``, caps
    above all. The sum is ``n`` unless floors or caps forbid it.
    """
    floors = [min(f, c) for f, c in zip(floors, caps, strict=True)]
    fixed: dict[int, int] = {i: 0 for i, c in enumerate(caps) if c == 0}
    while True:
        free = [i for i in range(len(shares)) if i not in fixed]
        weight, rest = sum(shares[i] for i in free), n - sum(fixed.values())
        ideal = {i: (max(0, rest) * shares[i] / weight if weight else Fraction(0)) for i in free}
        over = {i: ideal[i] - caps[i] for i in free if ideal[i] > caps[i]}
        under = {i: floors[i] - ideal[i] for i in free if ideal[i] < floors[i]}
        if not over and not under:
            break
        if sum(under.values()) >= sum(over.values()):
            fixed |= {i: floors[i] for i in under}
        else:
            fixed |= {i: caps[i] for i in over}
    out = [fixed.get(i, 0) for i in range(len(shares))]
    for i in free:
        out[i] = floor(ideal[i])
    short = max(0, min(n - sum(out), len(free)))
    for i in sorted(free, key=lambda i: (out[i] - ideal[i], i))[:short]:
        if out[i] < caps[i]:
            out[i] += 1
    return out


def proportional_quotas(population: DataFrame, targets: DataFrame, *, category: list[str], share: str, least: str, rate: float) -> DataFrame:
    """(category, target, available, wanted, quota, granted, short) for each row of ``targets``.

    ``population`` holds one row per member with the category columns. The sample
    size is ``rate`` of all of it, rounded down; ``quota`` are the whole numbers
    that the sample takes. ``wanted`` is the greater of the minimum and the
    rounded-up target, and ``granted`` what the same allocation gives if every
    category insists on it; ``short`` where that is less, as members are missing. The
    targets are a small table (one row per category); members of other categories
    count in the size of the population only. Null shares and minima count as 0.
    """
    spark = population.sparkSession
    counts = staged(population.groupBy(*category).agg(F.count("*").alias("available")))
    total = counts.agg(F.sum("available")).first()[0] or 0
    n = floor(Fraction(str(rate)) * total)
    rows = collected(targets.select(*category, F.col(share).alias("target"), F.col(least).alias("least")).join(counts, category, "left").orderBy(*category))
    shares = [Fraction(str(r["target"] or 0)) for r in rows]
    floors, caps = [int(r["least"] or 0) for r in rows], [int(r["available"] or 0) for r in rows]
    wanted = [max(f, ceil(s * n)) for f, s in zip(floors, shares, strict=True)]
    quotas, granted = allocate(n, shares, floors, caps), [min(g, w) for g, w in zip(allocate(n, shares, wanted, caps), wanted, strict=True)]
    kinds = dict(targets.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in category), "target double, available long, wanted long, quota long, granted long, short boolean"])
    out = zip(rows, shares, caps, wanted, quotas, granted, strict=True)
    return spark.createDataFrame([(*[r[c] for c in category], float(s), a, w, q, g, g < w) for r, s, a, w, q, g in out], schema)


def proportional_sample(population: DataFrame, quotas: DataFrame, *, category: list[str], key: list[str], seed: str) -> DataFrame:
    """(key, category) of each category's members with the smallest random keys, as many as its quota.

    Other columns are left out. Members with a null category or of a category
    without quota are never drawn; an empty population gives no rows.
    """
    ranked = population.select(*key, *category).withColumn("priority", priority(seed, *[F.col(k) for k in key]))
    return smallest(ranked, quotas.select(*category, "quota"), category, key).drop("priority")


