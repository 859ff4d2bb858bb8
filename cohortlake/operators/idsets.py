"""Reconciliation of identifier sets: idset (set_name, id, ref, pos). A null id is a value of sets, never a repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_repetitions(ids: DataFrame) -> DataFrame:
    return ids.filter("id is not null").groupBy("set_name", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def id_totals(ids: DataFrame) -> DataFrame:
    """Rows and distinct ids (null is one) of each set."""
    distinct = (F.count_distinct("id") + F.max(F.when(F.col("id").isNull(), 1).otherwise(0))).cast("long")
    return ids.groupBy("set_name").agg(F.count(F.lit(1)).alias("total"), distinct.alias("unique"))


def repeated_id_references(ids: DataFrame) -> DataFrame:
    return ids.join(id_repetitions(ids).select("set_name", "id"), ["set_name", "id"], "left_semi").select("set_name", "id", "ref")


def missing_id_references(ids: DataFrame) -> DataFrame:
    return ids.filter("id is null").select("set_name", "ref")


def _firsts(ids: DataFrame) -> DataFrame:
    return ids.groupBy("set_name", "id").agg(F.min_by("ref", "pos").alias("ref"))


def compare_all(ids: DataFrame) -> DataFrame:
    """(set_a, set_b, id, ref) for every ordered pair of sets: ids in a and not in b, with a's first reference.

    An id without a reference gets 'Not found'. Pairs come from the set names, so this is one anti-join for all.
    """
    firsts = _firsts(ids)
    names = ids.select("set_name").distinct()
    a, b = names.select(F.col("set_name").alias("set_a")), names.select(F.col("set_name").alias("set_b"))
    pairs = a.crossJoin(F.broadcast(b) if b.limit(10_001).count() <= 10_000 else b).filter("set_a <> set_b")
    left = firsts.join(pairs, F.col("set_name") == F.col("set_a"))
    right = firsts.select(F.col("set_name").alias("other"), F.col("id").alias("id_b"))
    only = left.join(right, (F.col("set_b") == F.col("other")) & F.col("id").eqNullSafe(F.col("id_b")), "left_anti")
    return only.select("set_a", "set_b", "id", F.coalesce("ref", F.lit("Not found")).alias("ref"))


def compare_idsets(ids: DataFrame, a: str, b: str) -> DataFrame:
    return compare_all(ids.filter(F.col("set_name").isin(a, b)))


def foreign_repetitions(ids: DataFrame, a: str, b: str) -> DataFrame:
    """References in ``a`` of the ids that ``b`` repeats."""
    again = id_repetitions(ids.filter(F.col("set_name") == b)).select("id", "n")
    return ids.filter(F.col("set_name") == a).join(again, "id").select("id", "ref", "n")


def id_report(ids: DataFrame) -> DataFrame:
    """(set_name, section, id, ref, n): totals, unique, repetitions, their references and missing ids' references."""
    t = id_totals(ids)
    row = lambda df, section, id_="id", ref="ref", n="n": df.select("set_name", F.lit(section).alias("section"), (F.col(id_) if id_ else F.lit(None).cast("string")).alias("id"), (F.col(ref) if ref else F.lit(None).cast("string")).alias("ref"), (F.col(n) if n else F.lit(None)).cast("long").alias("n"))
    parts = [row(t, "total", None, None, "total"), row(t, "unique", None, None, "unique"), row(id_repetitions(ids), "repetition", ref=None), row(repeated_id_references(ids), "repeated reference", n=None), row(missing_id_references(ids), "missing reference", None, "ref", None)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def patient_ids_per_folder(headers: DataFrame) -> DataFrame:
    """headers (folder, id) to the sorted set of ids of each folder."""
    return headers.groupBy("folder").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def folder_id(column: str, pattern: str):
    """The pattern's match in a folder name if it has more than 3 characters, else null."""
    found = F.regexp_extract(column, pattern, 0)
    return F.when(F.length(found) > 3, found)


def reconcile_subject_id(folders: DataFrame, id_column: str = "folder_id") -> DataFrame:
    """folders (folder, ids, folder_id): one header id is it; of several the folder's own; else 'None'."""
    n = F.size("ids")
    one = F.when(n == 1, F.element_at("ids", 1)).when((n > 1) & F.array_contains("ids", F.col(id_column)), F.col(id_column)).otherwise(F.lit("None"))
    return folders.withColumn("subject_id", one)
