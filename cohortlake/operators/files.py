"""File manifests (path): finding, classifying, matching and copy plans. Nothing is moved; plans are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.functions.text import base_name, folder, get_extension, glob_or_regex
from cohortlake.operators.sizes import small


def manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, dir, name, ext, size) of all files below ``path``; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", F.col("length").alias("size"))
    return rows.select("path", folder("path").alias("dir"), base_name("path").alias("name"), get_extension("path").alias("ext"), "size")


def find_files(files: DataFrame, pattern: str, anchored: bool = False, within: str | None = None) -> DataFrame:
    """Files whose base name holds (``anchored``: starts with) the pattern; ``within``: directly in one folder. Sorted."""
    rows = files.filter(folder("path") == within) if within else files
    return rows.filter(base_name("path").rlike(f"^(?:{pattern})" if anchored else pattern)).orderBy("path")


def complete_sets(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(dir, n, files): folders with as many (file, pattern) hits as there are patterns; ``patterns``: (pattern)."""
    n = patterns.count()
    hits = files.crossJoin(small(patterns, 10_000)).filter(F.expr("regexp_like(element_at(split(path, '/'), -1), pattern)"))
    own = hits.groupBy(folder("path").alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("files"))
    return own.filter(F.col("n") == n)


def nearest_match(bases: DataFrame, targets: DataFrame, pattern: str, max_jumps: int = 3) -> DataFrame:
    """(path, match): for each base file the lowest matching path below its own folder, else its parent's, and so on.

    The first path below each ancestor is taken before the join, so a folder near the root costs one row. '' if none.
    """
    levels = F.sequence(F.lit(0), F.lit(max_jumps - 1))
    up = lambda p: F.explode(F.transform(levels, lambda n: F.struct(n.alias("level"), F.array_join(F.slice(F.split(p, "/"), F.lit(1), F.greatest(F.size(F.split(p, "/")) - 1 - n, F.lit(0))), "/").alias("dir")))).alias("a")
    want = bases.select("path", up(F.col("path"))).select("path", "a.level", "a.dir")
    hits = targets.filter(base_name("path").rlike(f"^(?:{pattern})")).select(F.col("path").alias("hit"))
    parts = F.split("hit", "/")
    below = hits.select("hit", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir"))
    first = below.groupBy("dir").agg(F.min("hit").alias("hit"))
    found = want.join(first, "dir").groupBy("path").agg(F.min_by("hit", "level").alias("match"))
    return bases.select("path").join(found, "path", "left").withColumn("match", F.coalesce("match", F.lit("")))


def classify_tree(files: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, node): files that match all levels of a node; tree (node, level, pattern), level 1 is the path's first part."""
    depth = tree.groupBy("node").agg(F.count(F.lit(1)).alias("depth"))
    parts = files.select("path", F.posexplode(F.split("path", "/")).alias("level", "part")).withColumn("level", F.col("level") + 1)
    hits = parts.join(small(tree, 10_000), "level").filter(F.expr("regexp_like(part, pattern)"))
    n = hits.groupBy("path", "node").agg(F.count(F.lit(1)).alias("n"))
    return n.join(small(depth, 10_000), "node").filter("n = depth").select("path", "node")


def tree_node_files(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter((F.col("node") == node) | F.startswith("node", F.lit(node + "/"))).orderBy("path")


def root_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.element_at(F.split("node", "/"), 1).alias("root")).distinct()


def count_matches(nodes: DataFrame, pattern: str) -> DataFrame:
    """Number of distinct nodes at any depth whose own name matches."""
    parts = F.split("node", "/")
    deep = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("p")).distinct()
    return deep.filter(base_name("p").rlike(f"^(?:{pattern})")).agg(F.count(F.lit(1)).alias("n"))


def prune_tree(nodes: DataFrame, pattern: str) -> DataFrame:
    return nodes.filter(~F.col("node").rlike(pattern) & ~base_name("path").rlike(pattern))


def copy_plan(nodes: DataFrame, target: str, keep_names: bool = False, own_folder: bool = False, node: str | None = None) -> DataFrame:
    """(path, target): a node's single file is 'node.ext', several are '00001.ext', ... in the node's folder."""
    rows = tree_node_files(nodes, node) if node else nodes
    w = Window.partitionBy("node")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy("path")))
    leaf, ext = F.element_at(F.split("node", "/"), -1), get_extension("path")
    single = F.concat_ws("/", F.lit(target), "node", F.concat(leaf, ext)) if own_folder else F.concat(F.lit(target + "/"), F.col("node"), ext)
    many = F.concat_ws("/", F.lit(target), "node", F.concat(F.lpad(F.col("__r").cast("string"), 5, "0"), ext))
    kept = F.concat_ws("/", F.lit(target), "node", base_name("path"))
    return rows.select("path", (kept if keep_names else F.when(F.col("__n") == 1, single).otherwise(many)).alias("target"))


def common_prefix(paths: DataFrame, by: str | None = None) -> DataFrame:
    """The longest common folder: what the smallest and the largest path share, part by part."""
    own = paths.groupBy(*([by] if by else [])).agg(F.min("path").alias("a"), F.max("path").alias("b"))
    same = F.zip_with(F.split("a", "/"), F.split("b", "/"), lambda x, y: x.eqNullSafe(y))
    n = F.when(F.array_contains(same, F.lit(False)), F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same) - 1)
    return own.select(*([by] if by else []), F.array_join(F.slice(F.split("a", "/"), F.lit(1), n.cast("int")), "/").alias("prefix"))


def names_like(files: DataFrame, pattern: str) -> DataFrame:
    return files.filter(base_name("path").rlike(glob_or_regex(pattern))).orderBy("path")
