"""Reading the corpus tables and keeping intermediate results in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space, separators and invisible characters at either end of a value. A run inside is tried
#: once, not from each of its characters, so long runs cost no more than their length.
EDGE = r"^[\s\p{Z}\p{C}]++|(?<![\s\p{Z}\p{C}])[\s\p{Z}\p{C}]++$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the corpus folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors reach: the checkpoint folder of the session.

    It comes from ``spark.checkpoint.dir``. Only a session on one machine that
    names none gets a temporary folder; a cluster without one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="turnloom-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so a lost executor costs nothing but its running tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def strip(c: Column) -> Column:
    """Trim white space and invisible characters at both ends; null stays null."""
    return F.regexp_replace(c, EDGE, "")


def blank(c: Column) -> Column:
    """True where a text is null, empty or holds only white space and invisible characters."""
    return F.coalesce(strip(c) == "", F.lit(True))


def parallel(df: DataFrame) -> DataFrame:
    """Spread a scan of few partitions over all task slots before costly work on each row.

    A small file of few row groups gives few scan partitions; a large input
    has enough of them and stays as it is, without a shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(max(wanted, slots(df)))


#: Rows of a few numbers each up to which a side is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has been counted to be small, else as it is.

    For narrow frames whose lineage was cut: the count reads what is kept.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slots(df: DataFrame) -> int:
    """Partitions of a shuffle in the session of the frame."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
