"""Session helpers: local sessions for tests and staging in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a measured side of a join may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidepanel")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set, in local tests, a temporary folder is used instead.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="tidepanel-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept_folder(spark: SparkSession, name: str) -> str:
    """A folder ``name`` beside the session's checkpoints, the same for every later session.

    The checkpoint folder itself is a new one for each session.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).getParent()
    return f"{folder.toString()}/kept/{name}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` staged, and marked for broadcast only if it has at most ``limit`` rows and ``most`` bytes.

    The bytes are those of the values as text, and 8 for each. Beyond a limit it
    stays unmarked, so that the join is planned as a shuffle join, whose hot
    partitions adaptive execution splits.
    """
    small = staged(df)
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in small.columns), F.lit(8 * len(small.columns)))
    rows, size = small.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(small) if rows <= limit and size <= most else small


def collected(df: DataFrame, limit: int = BROADCAST_ROWS) -> list[Row]:
    """The rows of a table that is meant to be small, on the driver; fails if it has more than ``limit``."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"a table of at most {limit} rows was expected")
    return rows
