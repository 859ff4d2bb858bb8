"""What the corpus operators share: tables in the shared folder, and column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.tables import new_path, places, shared_dir  # noqa: F401

#: Bytes of an Arrow batch between Spark and Python, where the session names none: Spark's own 64 MB are held several
#: times over by each task, in the executor and in its worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: what follows survives lost executors without a second run of what came before.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df`` as a table of its own, for broadcast if it has at most ``rows`` rows, else for a sort-merge join.

    A table of its own, so that in the second case the other side is dealt anew and Spark can split its hot keys.
    """
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on where they are read. Where it comes in fewer splits than there are cores (one
    small file, say), its rows are dealt out, so that no core stands idle; larger tables are never shuffled for that."""
    small_batches(spark)
    df, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bucket_of(n: int, *cols: str | Column) -> Column:
    """A bucket 0..n-1 that depends on the values alone, not on where a row happens to be."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def ranked(df: DataFrame, by: str, order: list[str], out: str, salts: int = 64) -> DataFrame:
    """``out``: place 0, 1, ... of each row among the rows with an equal ``by``, gapless.

    A key may hold any share of all rows: rows are ranked within (key, salt), and the salts' counts, at most
    ``salts`` rows a key, give each salt its first place. The order within a key is free but fixed.
    """
    from pyspark.sql import Window as W

    salt = "__salt"
    df = df.withColumn(salt, bucket_of(salts, *order))
    counts = df.groupBy(by, salt).agg(F.count(F.lit(1)).alias("__n"))
    first = F.sum("__n").over(W.partitionBy(by).orderBy(salt)) - F.col("__n")
    counts = counts.select(F.col(by).alias("__by"), F.col(salt).alias("__s"), first.alias("__first"))
    inner = F.row_number().over(W.partitionBy(by, salt).orderBy(*order)) - F.lit(1)
    placed = df.withColumn("__in", inner).join(counts, F.col(by).eqNullSafe(F.col("__by")) & (F.col(salt) == F.col("__s")))
    return placed.withColumn(out, (F.col("__in") + F.col("__first")).cast("long")).drop(salt, "__in", "__by", "__s", "__first")


def give_back() -> None:
    """Gives freed memory of this Python worker back to the machine.

    Workers live on from task to task and stage to stage, and allocators keep what was freed in the meantime.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def tidy(run):
    """``run`` (a generator over a task's batches) that gives freed memory back at its end."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def tidy_groups(run):
    """``run`` (of a key and its table, or of two tables of one key) that gives freed memory back after each group."""

    def whole(a, b):
        out = run(a, b)
        give_back()
        return out

    return whole


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """Inside, shuffle files go as soon as the write that needed them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def add_struct(df: DataFrame, measure, columns: list[str], schema: str, into: str) -> DataFrame:
    """Adds the struct column ``into``, worked out on whole Arrow batches by ``measure(*arrays) -> StructArray``.

    All other columns pass through; one that is already named ``into`` is replaced. No shuffle.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    df = df.drop(into) if into in df.columns and into not in columns else df
    out = T.StructType([*df.schema.fields, T.StructField(into, T.StructType.fromDDL(schema))])
    names = df.columns

    def run(batches):
        for b in batches:
            found = measure(*[b.column(names.index(c)) for c in columns])
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*names, into])

    return df.mapInArrow(tidy(run), out)
