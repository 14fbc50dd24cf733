"""Dense ids that follow an order and survive reruns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import staged


def dense_ids(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """df with ids after+1, after+2, ... in order, which must tell rows apart.

    Rows are ranged over tasks, numbered in each, and shifted by the counts of the tasks
    before; only one count per task meets in one place.
    """
    sort = [F.col(c) for c in order]
    ranged = staged(df.repartitionByRange(*sort).withColumn("__p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = counts.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*sort))
    return ranged.join(before, "__p").withColumn(name, (F.lit(after) + F.col("__before") + own).cast("long")).drop("__p", "__before")


def keep_ids(new: DataFrame, old: DataFrame | None, key: list[str], order: list[str], name: str) -> DataFrame:
    """new with the ids that old has for the same key; other rows get ids after the largest, in order."""
    if old is None:
        return dense_ids(new, order, name)
    # Not by broadcast: a staged table of old rows may be far smaller as a file than in memory.
    known = new.join(old.select(*key, name).hint("merge"), key, "left")
    most = old.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]
    fresh = dense_ids(known.where(F.col(name).isNull()).drop(name), order, name, most)
    return known.where(F.col(name).isNotNull()).unionByName(fresh)
