"""Experiments: a results table that configurations are appended to, each in one commit that can be repeated.

A configuration's tables stand in a folder named by its id. Its metrics are written last, and Spark marks a written table
with a file of its own; so a configuration counts as done only when all of it is there, whatever ended a run before, and
one that was cut off is written over.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cohortlake.operators.crossval import Preselection, cross_validate
from cohortlake.operators.evaluation import fold_metrics

TABLES = ("predictions", "selected", "fits", "importances", "metrics")
_MARK = "_SUCCESS"


class ResultsTable:
    """The results under ``path``, a folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, config_id: str) -> str:
        return f"{self.path}/config={quote(config_id, safe='')}"

    def done(self) -> list[str]:
        """Ids of the configurations that are there as a whole."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.path}/config=*/{TABLES[-1]}/{_MARK}")
        fs = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(pattern) or []
        return sorted(unquote(f.getPath().getParent().getParent().getName().removeprefix("config=")) for f in found)

    def commit(self, config_id: str, tables: dict[str, DataFrame]) -> None:
        """Writes all tables, the metrics at the end; doing it again gives the same."""
        for name in TABLES:
            tables[name].withColumn("config_id", F.lit(config_id)).write.mode("overwrite").parquet(f"{self._folder(config_id)}/{name}")

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """One table of all configurations that are done."""
        done = self.done()
        if not done:
            return self.spark.createDataFrame([], schema or "config_id string")
        return self.spark.read.parquet(*[f"{self._folder(c)}/{name}" for c in done])


def run_experiments(features: DataFrame, labels: DataFrame, configs: DataFrame, results: ResultsTable | None = None, thr_method: str = "percentile", parallelism: int = 2, pool: str = "experiments", **options) -> DataFrame:
    """(config_id, fold, metrics) of all configurations (config_id, cl, prefs, prefs_thr) of ``configs``.

    Those that ``results`` has are not run again. At most ``parallelism`` run at a time, each in a scheduler pool of its own
    (``pool``-n), so that one does not wait for another's tasks. One that fails does not stop the others, but the call
    ends with its error; the others are kept. Without ``results`` a new table in the shared folder is used. Forests go
    unscaled, all others scaled. ``options`` go to ``cross_validate``.
    """
    from cohortlake.operators.tables import new_path
    from cohortlake.operators.voxels import skip_done

    spark = features.sparkSession
    results = results or ResultsTable(spark, new_path(spark, "experiments"))
    have = spark.createDataFrame([(c,) for c in results.done()], "config_id string")
    todo = skip_done(configs, have).orderBy("config_id").collect()  # one row for each experiment
    features, labels = features.persist(), labels.persist()

    def one(place: int, c) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pool}-{place % parallelism}")
        presel = Preselection(c["prefs"], thr_method, c["prefs_thr"]) if c["prefs"] else Preselection()
        cv = cross_validate(features, labels, c["cl"], presel, scale=c["cl"] != "rf", **options)
        metrics = fold_metrics(cv.predictions, ("fold",))
        results.commit(c["config_id"], {"predictions": cv.predictions, "selected": cv.selected, "fits": cv.fits, "importances": cv.importances, "metrics": metrics})

    try:
        with ThreadPoolExecutor(parallelism) as threads:
            run = inheritable_thread_target(spark)(one)
            jobs = [threads.submit(run, i, c) for i, c in enumerate(todo)]
        errors = [e for j in jobs if (e := j.exception())]
    finally:
        features.unpersist()
        labels.unpersist()
    if errors:
        raise errors[0]
    return results.read("metrics").join(configs.select("config_id").distinct(), "config_id", "left_semi")
