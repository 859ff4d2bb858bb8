"""Volume files: single-file NIfTI-1 (.nii, .nii.gz) to voxel and header tables, and voxel tables to storage."""

from __future__ import annotations

import gzip
import json
import math
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


VOXELS = "volume_id string, i int, j int, k int, t int, value double"
#: Voxels that a task holds at a time.
BATCH_VOXELS = 100_000


def header(data: bytes) -> dict:
    """shape, dtype, zooms, slope, inter, offset and affine (12 values) of a volume's 348-byte header."""
    end = "<" if struct.unpack_from("<i", data, 0)[0] == 348 else ">"
    if struct.unpack_from(end + "i", data, 0)[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack_from(end + "8h", data, 40)
    zooms = struct.unpack_from(end + "8f", data, 76)
    offset, slope, inter = struct.unpack_from(end + "3f", data, 108)
    sform = struct.unpack_from(end + "h", data, 254)[0]
    m = list(struct.unpack_from(end + "12f", data, 280)) if sform > 0 else [zooms[1], 0, 0, 0, 0, zooms[2], 0, 0, 0, 0, zooms[3], 0]
    n = dim[0]
    return {"shape": list(dim[1 : n + 1]), "dtype": end + TYPES[struct.unpack_from(end + "h", data, 70)[0]], "zooms": [float(z) for z in zooms[1 : n + 1]], "slope": slope if slope else 1.0, "inter": inter if slope else 0.0, "offset": int(offset), "affine": [float(x) for x in m]}


def array(data: bytes) -> tuple[dict, np.ndarray]:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    h = header(data)
    n = int(np.prod(h["shape"]))
    x = np.frombuffer(data, h["dtype"], n, h["offset"]).reshape(h["shape"], order="F")
    return h, x * h["slope"] + h["inter"] if (h["slope"], h["inter"]) != (1.0, 0.0) else x


def _listed(spark: SparkSession, path: str, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(path, content) of all files below ``path``, those that are read whole and those that are not: uncompressed ones of
    more than ``range_bytes``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = (F.col("length") > range_bytes) & ~F.col("path").endswith(".gz")
    return files.filter(~large).select("path", "content"), files.filter(large).select("path")


def read_headers(spark: SparkSession, path: str, range_bytes: int = 128 << 20) -> DataFrame:
    """(volume_id, shape, zooms, affine) of all files; of large uncompressed ones the header alone is read."""
    kind = "volume_id string, shape array<int>, zooms array<double>, affine array<double>"

    def table(names, hs):
        return pa.RecordBatch.from_arrays([names, pa.array([h["shape"] for h in hs], pa.list_(pa.int32())), pa.array([h["zooms"] for h in hs], pa.list_(pa.float64())), pa.array([h["affine"] for h in hs], pa.list_(pa.float64()))], names=["volume_id", "shape", "zooms", "affine"])

    def head(data: bytes) -> dict:
        return header(zlib.decompressobj(31).decompress(data, 352) if data[:2] == b"\x1f\x8b" else data)

    def held(batches):
        for b in batches:
            yield table(b.column(0), [head(c.as_py()) for c in b.column(1)])

    def opened(batches):
        for b in batches:
            hs = []
            for name in b.column(0).to_pylist():
                with _open(name) as f:
                    hs.append(header(f.read(348)))
            yield table(b.column(0), hs)

    whole, large = _listed(spark, path, range_bytes)
    return whole.mapInArrow(held, kind).union(large.mapInArrow(opened, kind))


def _voxels(name: str, x: np.ndarray, first: int, shape: list[int], zeros: bool):
    """Batches of the voxels that lie end to end in ``x``, of which the first is number ``first`` of the volume."""
    for s in range(0, len(x), BATCH_VOXELS):
        v = x[s : s + BATCH_VOXELS].astype(float)
        at = np.arange(len(v)) if zeros else np.flatnonzero(v)
        if len(at):
            places = np.unravel_index(first + s + at, shape, order="F")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), *[pa.array(c.astype("int32")) for c in places], pa.array(v[at])], names=["volume_id", "i", "j", "k", "t", "value"])


def _four(shape: list[int]) -> list[int]:
    return [*shape, *[1] * (4 - len(shape))]


@dataclass
class VoxelRange(InputPartition):
    """``n`` voxels of a file, from number ``first`` on."""

    path: str
    shape: list[int]
    dtype: str
    offset: int
    scale: tuple[float, float]
    first: int
    n: int


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if ":/" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.zeros, self.range_bytes = json.loads(options["paths"]), options["zeros"] == "true", int(options["rangeBytes"])

    def partitions(self) -> list[VoxelRange]:
        out = []
        for path in self.paths:
            with _open(path) as f:
                h = header(f.read(348))
                size = f.size()
            n, step = math.prod(h["shape"]), max(1, self.range_bytes // np.dtype(h["dtype"]).itemsize)
            if size < h["offset"] + n * np.dtype(h["dtype"]).itemsize:
                raise ValueError(f"{path} ends before its last voxel")
            out += [VoxelRange(path, _four(h["shape"]), h["dtype"], h["offset"], (h["slope"], h["inter"]), at, min(step, n - at)) for at in range(0, n, step)]
        return out

    def read(self, partition: VoxelRange):
        p, size = partition, np.dtype(partition.dtype).itemsize
        with _open(p.path) as f:
            for at in range(p.first, p.first + p.n, BATCH_VOXELS):
                n = min(BATCH_VOXELS, p.first + p.n - at)
                f.seek(p.offset + at * size)
                x = np.frombuffer(f.read(n * size), p.dtype, n)
                x = x * p.scale[0] + p.scale[1] if p.scale != (1.0, 0.0) else x
                yield from _voxels(p.path, x, at, p.shape, self.zeros)


class VolumeRanges(DataSource):
    """Uncompressed volumes by ranges of bytes: a file of any size is as many tasks as it has ranges, each of which holds one
    batch of voxels. Options: paths (JSON), zeros, rangeBytes. Files are opened by pyarrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return "cohortlake_volume_ranges"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


def read_volumes(spark: SparkSession, path: str, zeros: bool = False, range_bytes: int = 128 << 20) -> DataFrame:
    """(volume_id, i, j, k, t, value) of all files; zero voxels are left out unless ``zeros``.

    Uncompressed files of more than ``range_bytes`` are read by ranges of so many bytes, each in a task of its own. Others,
    and compressed ones, which cannot be split, are read one file at a time in a task, by Spark's binary reader.
    """
    whole, ranged = _listed(spark, path, range_bytes)
    large = [r["path"] for r in ranged.collect()]  # names alone

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h, x = array(content.as_py())
                yield from _voxels(name, x.ravel(order="F"), 0, _four(h["shape"]), zeros)

    out = whole.mapInArrow(run, VOXELS)
    if not large:
        return out
    spark.dataSource.register(VolumeRanges)
    ranges = spark.read.format(VolumeRanges.name()).options(paths=json.dumps(large), zeros=str(zeros).lower(), rangeBytes=str(range_bytes)).load()
    return out.union(ranges)


def save_volume_table(voxels: DataFrame, headers: DataFrame, path: str) -> None:
    voxels.write.partitionBy("volume_id").parquet(f"{path}/voxels")
    headers.write.parquet(f"{path}/headers")


def encode(x: np.ndarray, affine: list[float] | None = None) -> bytes:
    """A minimal single-file volume, for fixtures."""
    code = {v: k for k, v in TYPES.items()}[x.dtype.str[1:]]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, x.ndim, *x.shape, *[1] * (7 - x.ndim))
    struct.pack_into("<hh", head, 70, code, x.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *[1.0] * x.ndim, *[0.0] * (7 - x.ndim))
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<h", head, 254, 1)
    struct.pack_into("<12f", head, 280, *(affine or [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]))
    head[344:348] = b"n+1\0"
    return bytes(head) + x.astype("<" + x.dtype.str[1:]).tobytes(order="F")


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines, bytes): line counts and sizes."""
    lines = spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    size = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    name = F.regexp_replace("path", "^file:/+", "/")
    return size.withColumn("path", name).join(lines.withColumn("path", name), "path", "left").select("path", F.coalesce("lines", F.lit(0)).alias("lines"), "bytes")
