"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies. The prefix sums
of the expected copies, in the order of size and hash within the source, are
shifted by one random offset of the source, and a copy is emitted at each whole
number crossed; so a document is used the rounded-down or rounded-up number of
times, and a source's total misses its target by about one of its longest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import collected, sized

#: Bins of size per power of two by which the order within a source is cut, and documents that a cell of hashes is meant to hold.
SIZE_BINS, CELL_ROWS = 8, 50_000


def folded_name(name: Column) -> Column:
    """A source's name without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def mix_plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_weight, max_repeats, documents, tokens, copies) per target source.

    ``sizes`` has (key, source, size). ``copies`` is the expected number per
    document. Without ``total`` the mix gets the greatest size at which every
    source that has documents reaches its weight within its repeats; with it,
    sources too small for their share stay at the cap.
    """
    spark = sizes.sparkSession
    have = sizes.filter("size > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("tokens"))
    wanted = targets.groupBy(folded_name(F.col("source")).alias("source")).agg(F.sum("target_weight").alias("target_weight"), F.min("max_repeats").alias("max_repeats"))
    rows = collected(wanted.filter("source is not null").join(have, "source", "left").orderBy("source"))
    usable = [r for r in rows if r["tokens"] and (r["target_weight"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    size = total if total is not None else min((r["max_repeats"] * r["tokens"] / r["target_weight"] for r in usable), default=0.0)
    out = [(r["source"], float(r["target_weight"] or 0), int(r["max_repeats"] or 0), r["documents"] or 0, r["tokens"] or 0, float(min(r["max_repeats"], size * r["target_weight"] / r["tokens"])) if r in usable else 0.0) for r in rows]
    return spark.createDataFrame(out, "source string, target_weight double, max_repeats int, documents long, tokens long, copies double")


def mix_sources(sizes: DataFrame, plan: DataFrame, seed: int = 20260101) -> DataFrame:
    """(key, source, size, uses) of every document used at least once.

    The order within a source runs over cells of (size bin, hash bin), whose counts
    are summed up in a small table, and within a cell; a source has as many hash
    bins as its number of documents asks for, so that one with a third of all rows
    is spread over its cells and none of them grows with the data.

    Documents without tokens and of sources without target are not used.
    Repeated rows are documents of their own.
    """
    cell = ["source", "size_bin", "hash_bin"]
    wanted = sized(plan.filter("copies > 0").select("source", "copies", "max_repeats", F.ceil(F.col("documents") / CELL_ROWS).alias("hash_bins")))
    rows = (
        sizes.select("key", "source", "size").filter("size > 0").join(wanted, "source")
        .withColumn("rank_hash", F.xxhash64(F.lit(seed), "key"))
        .withColumn("size_bin", F.floor(F.log2("size") * SIZE_BINS).cast("int"))
        .withColumn("hash_bin", F.pmod("rank_hash", F.col("hash_bins")).cast("int"))
    )
    before = Window.partitionBy("source").orderBy("size_bin", "hash_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized(rows.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*cell, "start"))
    within = Window.partitionBy(*cell).orderBy("size", "rank_hash", "key")
    ranked = rows.withColumn("k", F.row_number().over(within)).join(starts, cell).withColumn("k", F.col("k") + F.col("start"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    crossed = lambda k: F.floor(k * F.col("copies") + offset)
    uses = F.least(crossed(F.col("k")) - crossed(F.col("k") - 1), F.col("max_repeats"))
    return ranked.withColumn("uses", uses.cast("int")).filter("uses > 0").select("key", "source", "size", "uses")


def mix_shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Shares reached: one row per target source, also of those without documents."""
    got = mix.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("uses").alias("most_uses"))
    all_used = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # one row per target
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return plan.join(got, "source", "left").withColumn("all_tokens", all_used).select(
        "source", "target_weight", "max_repeats", "documents", "tokens", zero("tokens_used"), zero("documents_used"), zero("most_uses"),
        F.coalesce(F.try_divide("tokens_used", "all_tokens"), F.lit(0.0)).alias("share_reached"),
    ).withColumn("shortfall", F.greatest(F.col("target_weight") - F.col("share_reached"), F.lit(0.0)))

