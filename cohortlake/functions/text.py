"""Column functions for paths, names and strings."""


import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def get_extension(path) -> Column:
    """Last extension with its dot; '.nii.gz' is one; '' without."""
    return F.regexp_extract(_c(path), r"(\.nii\.gz|\.[^./]*)$", 1)


def remove_ext(path) -> Column:
    return F.regexp_replace(_c(path), r"(\.nii\.gz|\.[^./]*)$", "")


def add_extension_if_needed(path, ext: str) -> Column:
    """Appends ``ext`` unless the path holds it anywhere."""
    p = _c(path)
    return F.when(F.contains(p, F.lit(ext)), p).otherwise(F.concat(p, F.lit(ext)))


def join_path(base, item) -> Column:
    return F.concat_ws("/", _c(base), _c(item))


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def folder(path) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def is_hidden(name) -> Column:
    return F.startswith(_c(name), F.lit("."))


def prefix_items(items, prefix: str) -> Column:
    return F.transform(_c(items), lambda x: F.concat(F.lit(prefix), x))


def prefix_keys(mapping, prefix: str) -> Column:
    return F.transform_keys(_c(mapping), lambda k, _: F.concat(F.lit(prefix), k))


def result_name(data, cl, prefs=None, prefs_thr=None, fs1=None, fs2=None) -> Column:
    """data[_prefs_thr][_fs1][_fs2]_cl; null or empty parts are left out."""
    part = lambda c: F.lit("") if c is None else F.when(F.coalesce(_c(c), F.lit("")) == "", "").otherwise(F.concat(F.lit("_"), _c(c)))
    pre = part(prefs) if prefs_thr is None else F.when(part(prefs) == "", "").otherwise(F.concat(part(prefs), F.lit("_"), _c(prefs_thr).cast("string")))
    return F.concat(_c(data), pre, part(fs1), part(fs2), F.lit("_"), _c(cl))


def glob_or_regex(pattern: str) -> str:
    """A regex for a name: a glob where the pattern has one of ! * $ and is no valid regex, else a match at the start."""
    if any(c in pattern for c in "!*$"):
        try:
            re.compile(pattern)
        except re.error:
            body = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]" else re.escape(c)) for c in pattern)
            return "^" + body.replace("[!", "[^") + "$"
    return f"^(?:{pattern})"


def search_list(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def match_list(df: DataFrame, column: str, pattern: str, group: int | None = None, into: str = "match") -> DataFrame:
    """Rows that match at the start; with ``group`` the group's text goes to ``into``."""
    out = df.filter(F.col(column).rlike(f"^(?:{pattern})"))
    return out if group is None else out.withColumn(into, F.regexp_extract(column, f"^(?:{pattern})", group))


def filter_names(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(glob_or_regex(pattern))).orderBy(column)


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def drop_hidden(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_hidden(column))


def filter_by(df: DataFrame, column: str, keep) -> DataFrame:
    """Rows whose string passes the user's predicate ``keep(str) -> bool``, in Arrow batches."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def passes(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s is not None and bool(keep(s)))

    return df.filter(passes(F.col(column)))
