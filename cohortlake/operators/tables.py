"""Tables in the folder that driver and executors share, and places of rows in groups of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only on one machine, where none is named, a local folder is made."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cohortlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` in the shared folder and reads it again, which cuts its lineage; ``by``: a folder for each value."""
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def places(df: DataFrame, group: str | None, order: list[str], at: str = "at", size: str = "n", first: str = "g") -> DataFrame:
    """``df`` with the place ``at`` (0, 1, ...) of each row among those of an equal ``group`` (null is a group; None: all rows
    are one), by ``order``; ``size``, the group's rows; and ``first``, a number of the group that grows with ``group``
    (null first).

    A group may hold any share of all rows: rows are sorted by ranges, and what joins them is one count for each group of
    a range. Rows that are equal in all of ``order`` are told apart by where they were read.
    """
    whole = group is None
    if whole:
        group, df = "__all", df.withColumn("__all", F.lit(0))
    keys = [group, *order, "__tie"]
    spread = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the upper bits number the range, the lower ones the row within it
    rows = stored(spread.drop("__tie").withColumn("__row", F.monotonically_increasing_id()), "places").withColumn("__range", F.shiftright("__row", 33))
    counts = rows.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    own = W.partitionBy(group)
    counts = counts.select(
        F.col(group).alias("__group"), F.col("__range").alias("__r"), (F.sum("__n").over(own.orderBy("__range")) - F.col("__n") - F.col("__first")).alias("__shift"),
        F.sum("__n").over(own).alias(size), F.min("__first").over(own).alias(first),
    )
    out = rows.join(counts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__r")))
    out = out.withColumn(at, F.col("__row") + F.col("__shift")).drop("__group", "__r", "__range", "__row", "__shift")
    return out.drop("__all") if whole else out
