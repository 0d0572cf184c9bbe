"""Volumes and surfaces as long tables of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_volume(df: DataFrame, id_col: str, array_col: str, dims: tuple[int, int, int]) -> DataFrame:
    """(subject_id, voxel_id, x, y, z, value) of one array for each subject, z running fastest."""
    _, ny, nz = dims
    long = df.select(F.col(id_col).alias("subject_id"), F.posexplode(array_col).alias("pos", "val"))
    v = F.col("pos").cast("long")
    part = lambda sql: F.expr(sql).cast("long")
    return long.select("subject_id", v.alias("voxel_id"), part(f"pos div {ny * nz}").alias("x"), part(f"(pos div {nz}) % {ny}").alias("y"), part(f"pos % {nz}").alias("z"), F.col("val").cast("double").alias("value"))


def explode_region(df: DataFrame, id_col: str, array_col: str, dims: tuple[int, int, int], x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """As ``region`` of ``explode_volume``, with a row for each voxel of the box only: places are taken out of the arrays before anything is exploded."""
    _, ny, nz = dims
    ends = [(max(0, a), min(b, n)) for (a, b), n in zip((x, y, z), dims)]
    if any(a >= b for a, b in ends):
        return explode_volume(df.limit(0), id_col, array_col, dims)
    (x0, x1), (y0, y1), (z0, z1) = ends
    sequence = lambda a, b: F.sequence(F.lit(a), F.lit(b - 1))
    # A line along z is one slice.
    lines = F.flatten(F.transform(sequence(x0, x1), lambda i: F.transform(sequence(y0, y1), lambda j: (i * ny + j) * nz + z0)))
    taken = df.select(F.col(id_col).alias("subject_id"), F.explode(F.transform(lines, lambda at: F.struct(at.alias("at"), F.slice(F.col(array_col), at + 1, F.lit(z1 - z0)).alias("part")))).alias("line"))
    long = taken.select("subject_id", F.col("line.at").alias("at"), F.posexplode("line.part").alias("k", "val"))
    v = (F.col("at") + F.col("k")).cast("long")
    part = lambda sql: F.expr(sql).cast("long")
    return long.select("subject_id", v.alias("voxel_id"), part(f"(at + k) div {ny * nz}").alias("x"), part(f"((at + k) div {nz}) % {ny}").alias("y"), part(f"(at + k) % {nz}").alias("z"), F.col("val").cast("double").alias("value"))


def _interleaved(cols: list[Column], bits: int = 20) -> Column:
    """A place on a space-filling curve: the bits of the coordinates in turn."""
    code = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(cols):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * len(cols) + k))
    return code


def store_volumes(obs: DataFrame, path: str, side: int = 8, files: int = 64) -> None:
    """Writes observations (subject_id, voxel_id, x, y, z, value) in blocks of ``side`` voxels a side along a space-filling curve.  Files are ranges of the curve and
    sorted by it, so that their footers' least and greatest block tell which of them a box needs."""
    block = _interleaved([F.floor(F.col(c) / side).cast("long") for c in "xyz"])
    rows = obs.withColumn("block", block)
    rows.repartitionByRange(files, "block", "subject_id").sortWithinPartitions("block", "subject_id").write.mode("overwrite").parquet(f"{path}/side={side}")


def read_region(spark: SparkSession, path: str, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """The half-open box of volumes that ``store_volumes`` has written.  The blocks that it touches are ranges of the curve, which reach the scan; at most
    MOST_RANGES of them are told apart, further ones are read together."""
    rows = spark.read.parquet(path)
    side = rows.select("side").first()
    if side is None:
        return rows.drop("side", "block")
    side, ends = side[0], [(max(0, a), b) for a, b in (x, y, z)]
    if any(a >= b for a, b in ends):
        return rows.limit(0).drop("side", "block")
    near = F.lit(False)
    for low, high in _curve_ranges([(a // side, (b - 1) // side) for a, b in ends]):
        near = near | F.col("block").between(low, high)
    return region(rows.where(near), x, y, z).drop("side", "block")


#: Ranges of the curve in a filter.
MOST_RANGES = 32


def _curve_ranges(ends: list[tuple[int, int]], bits: int = 20) -> list[tuple[int, int]]:
    """Ranges of the curve that hold all blocks of a box: cubes of the curve are halved along every axis as long as they stick out of it and
    there are few of them."""
    cubes, out = [((0, 0, 0), bits, 0)], []
    while cubes:
        cubes.sort(key=lambda c: -c[1])
        (at, level, code), cubes = cubes[0], cubes[1:]
        size = 1 << level
        if any(a + size <= low or a > high for a, (low, high) in zip(at, ends)):
            continue
        inside = all(a >= low and a + size - 1 <= high for a, (low, high) in zip(at, ends))
        if inside or not level or len(cubes) + len(out) >= MOST_RANGES:
            out.append((code, code + (1 << 3 * level) - 1))
            continue
        half = size >> 1
        for k in range(8):
            cubes.append((tuple(a + half * (k >> j & 1) for j, a in enumerate(at)), level - 1, code + (k << 3 * (level - 1))))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(out):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def region(df: DataFrame, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """The half-open box; bounds below 0 count as 0.  Filters on plain columns reach the scan."""
    box = [(F.col(c) >= max(0, a)) & (F.col(c) < b) for c, (a, b) in (("x", x), ("y", y), ("z", z))]
    return df.where(box[0] & box[1] & box[2])


def vertex_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Vertices start to end, exclusive."""
    return df.where((F.col("voxel_id") >= max(0, start)) & (F.col("voxel_id") < end))


def feature_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """(subject_id, features array<double>)."""
    return df.select("subject_id", F.array(*[F.col(n).cast("double") for n in names]).alias("features"))
