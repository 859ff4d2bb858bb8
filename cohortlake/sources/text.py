"""Subject lists, label files, and the text formats of learning tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.operators.sizes import small

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines in order within each file. A file's lines lie in one row group of the reader."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at"))).drop("at")


def read_subjects(spark: SparkSession, path: str, datadir: str = "", split: str = ":", labels: str | None = None) -> DataFrame:
    """(line, path, label): ``datadir`` before relative paths; a separate file of labels, one a line, overrides."""
    rows = numbered(spark, path).filter(F.trim("value") != "")
    parts = F.split("value", F.lit(f"\\Q{split}\\E"))
    name = F.trim(F.get(parts, F.lit(0)))
    full = F.when(F.startswith(name, F.lit("/")) | F.lit(datadir == ""), name).otherwise(F.concat(F.lit(datadir.rstrip("/") + "/"), name))
    out = rows.select("line", full.alias("path"), F.trim(F.get(parts, F.lit(1))).alias("label"))
    if labels is None:
        return out
    own = numbered(spark, labels).select("line", F.trim("value").alias("__label"))
    return out.join(own, "line", "left").select("line", "path", F.coalesce("__label", "label").alias("label"))


def write_lines(df: DataFrame, column: str, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).select(F.col(column).cast("string").alias("value")).write.text(path)


def write_subjects(df: DataFrame, path: str, split: str = ":") -> None:
    write_lines(df.withColumn("__v", F.concat_ws(split, "path", "label")), "__v", path, ["line"] if "line" in df.columns else None)


def read_svmperf_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per log: the first of each of its figures."""
    names = ["Accuracy", "Precision", "Recall", "F1", "PRBEP", "ROCArea", "AvgPrec"]
    rows = numbered(spark, path).withColumn("name", F.regexp_extract("value", rf"^\s*({'|'.join(names)})\s*:", 1)).filter("name <> ''")
    rows = rows.withColumn("number", F.regexp_extract("value", r":\s*([-+.\deE]+)", 1).cast("double"))
    first = rows.groupBy("file", "name").agg(F.min_by("number", "line").alias("number"))
    return first.groupBy("file").pivot("name", names).agg(F.first("number"))


def grep_first(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(file, value): the first line of each file that holds ``text``."""
    return numbered(spark, path).filter(F.contains("value", F.lit(text))).groupBy("file").agg(F.min_by("value", "line").alias("value"))


def arff_lines(rows: DataFrame, names: list[str], relation: str, classes: list[int]) -> DataFrame:
    """(at, value) of a table (x ARRAY<DOUBLE>, y INT, sample_id); an array of another length than ``names`` is an error."""
    head = [f"@RELATION {relation}", *[f"@ATTRIBUTE {n} NUMERIC" for n in names], f"@ATTRIBUTE class {{{','.join(map(str, classes))}}}", "@DATA"]
    top = rows.sparkSession.createDataFrame([(i - len(head), v) for i, v in enumerate(head)], "at long, value string")
    x = F.when(F.size("x") == len(names), F.col("x")).otherwise(F.raise_error(F.lit("names and columns differ in number")))
    text = F.concat_ws(",", F.transform(x, lambda v: F.format_string("%6.4f", v)), F.col("y").cast("string"))
    return top.unionByName(rows.select(F.col("sample_id").cast("long").alias("at"), text.alias("value")))


def write_arff(rows: DataFrame, path: str, names: list[str], relation: str, classes: list[int]) -> None:
    write_lines(arff_lines(rows, names, relation, classes), "value", path, ["at"])


def svmperf_line(y: Column, x: Column) -> Column:
    """'+1 1:0.1234 ...'; a label that is not -1 or 1 is an error."""
    ok = F.when(y.isin(-1, 1), y).otherwise(F.raise_error(F.lit("labels must be -1 or 1")))
    return F.concat_ws(" ", F.format_string("%+d", ok.cast("int")), F.array_join(F.transform(x, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string("%.4f", v))), " "))


def write_svmperf(rows: DataFrame, path: str) -> None:
    write_lines(rows.withColumn("__v", svmperf_line(F.col("y"), F.col("x"))), "__v", path, ["sample_id"])


def read_atlas_labels(spark: SparkSession, path: str) -> DataFrame:
    """(atlas, idx, name, x, y, z, v) of atlas XML files; the header's name catalogues many files."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    schema = "_VALUE string, _index int, _x int, _y int, _z int, _v int"
    rows = spark.read.format("xml").option("rowTag", "label").schema(schema).load(path).select(name.alias("file"), F.col("_index").alias("idx"), F.trim("_VALUE").alias("name"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"), F.col("_v").alias("v"))
    return rows.join(small(read_atlas_headers(spark, path).select("file", "atlas"), 100_000), "file").drop("file")


def read_atlas_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, atlas, type, units, lower, upper): a probabilistic atlas runs from 0 to 100 and its unit is %."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    h = spark.read.format("xml").option("rowTag", "header").schema("name string, type string, units string").load(path)
    prob = F.lower("type").startswith("prob")
    return h.select(name.alias("file"), F.trim("name").alias("atlas"), F.lower("type").alias("type"), F.when(prob, "%").otherwise(F.coalesce("units", F.lit(""))).alias("units"), F.when(prob, 0).alias("lower"), F.when(prob, 100).alias("upper"))


def convert_table(spark: SparkSession, path: str, out: str, source: str = "csv", target: str | None = None) -> None:
    reader = spark.read.format(source)
    df = (reader.option("header", "true").option("inferSchema", "true") if source == "csv" else reader).load(path)
    export_variables({"": df}, out, target)


def export_variables(tables: dict[str, DataFrame], path: str, target: str | None = None) -> None:
    """Each named table to ``path`` (or path/name); the format is that of the extension unless given."""
    kind = target or FORMATS.get("." + path.rsplit(".", 1)[-1], "parquet")
    for name, df in tables.items():
        w = df.write.format(kind)
        (w.option("header", "true") if kind == "csv" else w).save(f"{path}/{name}" if name else path)
