"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: A key of more rows than this, and than a thousandth of them all, is joined by broadcast.
CROWD = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names.

    A folder of this process's own is set only where ``spark.checkpoint.dir`` is unset, as in tests.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of frames that are no longer in use; else they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def joined(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the columns of table, one row for each value of ``keys`` and ``of``, the number of rows that have it.

    Those of more than max(CROWD, total / 1000) of the ``total`` rows, fewer than 1000 then, are broadcast; so no
    task gets more than that many rows of one key. Keys aren't null.
    """
    crowd = max(CROWD, total // 1000)
    hot = F.broadcast(table.where(F.col("of") > crowd).drop("of"))
    cold = table.where(F.col("of") <= crowd).drop("of")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(cold, keys))
