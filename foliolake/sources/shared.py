"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or, where it is unset (tests on one machine), one in the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that what follows reads files that outlive an executor and the plan
    starts there. Spark deletes the files once nothing refers to them, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def deal(df: DataFrame, keys: list[str], amount: Column, each: int) -> DataFrame:
    """``df`` dealt by its keys into as many partitions as the sum of ``amount`` takes at ``each`` a partition. What rows
    are taken apart into is much larger than what is dealt, which is all that AQE sees when it merges partitions; the sum
    is one more pass over the columns of ``amount``, and one number comes to the driver."""
    total = df.agg(F.sum(amount.cast("double")).alias("n")).first()["n"] or 0.0
    return df.repartition(int(total / each) + 1, *keys)
