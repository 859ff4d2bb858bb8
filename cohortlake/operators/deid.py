"""De-identification of header tables: tags (file, grp, elem, vr, keyword, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keywords and what replaces them.
NAME, ADDRESS, BIRTH = ["PatientName", "PatientsName"], ["PatientAddress", "PatientsAddress"], ["PatientBirthDate", "PatientsBirthDate"]
OTHER_IDS = ["OtherPatientIDs", "OtherPatientIDsSequence"]
EXTENSIONS = [".IMA", ".DICOM", ".DCM", ".ima", ".dicom", ".dcm"]


def anonymize_headers(tags: DataFrame, private: bool = True, curves: bool = True) -> DataFrame:
    k = F.col("keyword")
    rows = tags.filter(~F.coalesce(k, F.lit("")).isin(OTHER_IDS))
    if private:
        rows = rows.filter((F.col("grp") % 2) == 0)
    if curves:
        rows = rows.filter(F.col("grp").bitwiseAND(F.lit(0xFF00)) != 0x5000)
    value = F.when(k.isin(NAME) | (F.col("vr") == "PN"), "Anonymous").when(k.isin(ADDRESS), "North Pole").when(k.isin(BIRTH), "").otherwise(F.col("value"))
    return rows.withColumn("value", value)


def anonymize_headers_fixed(tags: DataFrame) -> DataFrame:
    k = F.col("keyword")
    return tags.withColumn("value", F.when(k.isin(NAME), "Anonymous").when(k.isin(BIRTH), "17000101").when(k.isin(ADDRESS), "North Pole").otherwise(F.col("value")))


def first_patient_id(files: DataFrame) -> DataFrame:
    """files (folder, path, id): the first id of each folder that is not null, by extension in a fixed order, then path."""
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    rank = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), ext)
    rows = files.withColumn("__r", rank).filter("__r > 0 and id is not null")
    return rows.groupBy("folder").agg(F.min_by("id", F.struct("__r", "path")).alias("id"))


def rename_folder_plan(folders: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """(folder, target): the id in the folder's name, else the first header id, else the name as it is."""
    from cohortlake.operators.idsets import folder_id

    return folders.join(first_patient_id(files), "folder", "left").select("folder", F.coalesce(folder_id("folder", pattern), "id", "folder").alias("target"))


def serial_names(files: DataFrame, width: int = 4, ext: str = ".dcm") -> DataFrame:
    """files (folder, path): new names 0001.dcm, 0002.dcm, ... in each folder and extension, by path."""
    own = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    n = F.row_number().over(Window.partitionBy("folder", own).orderBy("path"))
    return files.withColumn("new_name", F.concat(F.lpad(n.cast("string"), width, "0"), F.lit(ext)))


def deidentify_subject(folders: DataFrame, files: DataFrame, tags: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The plan (path, target path) of a cohort's files, and their cleaned tags."""
    plan = serial_names(files).join(rename_folder_plan(folders, files, pattern), "folder")
    return plan.select("path", F.concat_ws("/", "target", "new_name").alias("target_path")), anonymize_headers(tags)
