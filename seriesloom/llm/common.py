"""What the operators of this subpackage share: reading tables, cutting lineage, text expressions, joins of uneven keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than this share of all rows is hot; so there are at most as many hot keys as its inverse says.
HOT_SHARE = 1 / 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir. Where it names none, a session on one machine gets a temporary one; on a cluster it is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not given and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="seriesloom-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns as one, so that none clashes with those an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)


def columns_of(docs: DataFrame, name: str = "row") -> list[Column]:
    """The columns of docs out of what whole_row made of them."""
    return [F.col(name).getField(c).alias(c) for c in docs.columns]


def joined_unevenly(rows: DataFrame, groups: DataFrame, key: str, *, total: int) -> DataFrame:
    """rows joined with groups (key, n and more; n is how many rows a key has; one row a key), whatever share of the rows a key has.

    Hot keys, of more than HOT_SHARE of all total rows, number 1 / HOT_SHARE at most: they are broadcast, and their rows stay where
    they are. The rows of all others are shuffled by key.
    """
    least = max(1000, int(total * HOT_SHARE))
    hot, cold = groups.filter(F.col("n") > least), groups.filter(F.col("n") <= least)
    if not hot.take(1):
        return rows.join(groups, key)
    names = hot.select(F.col(key).alias("_hot"))
    rest = rows.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def sampled(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """About n rows of df (total rows), at least n where there are as many, by the hash of key: few rows of each partition are left for a sort."""
    if total <= n:
        return df
    share = min(1.0, n / total + 6 * (n / total / total) ** 0.5)
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000_007)) < int(1_000_000_007 * share) + 1)
