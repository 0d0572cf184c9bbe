"""Column functions and small table functions."""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def for_category(df: DataFrame, category: int) -> DataFrame:
    return df.where(F.col("category") == category)


def one_vs_all(df: DataFrame, predictor: str, categories: list[int]) -> DataFrame:
    """One column predictor_c for each category: the predictor where the row is of it, else 0."""
    return df.withColumns({f"{predictor}_{c}": F.when(F.col("category") == c, F.col(predictor)).otherwise(F.lit(0.0)) for c in categories})


def first_token(col: Column, sep: str = "_") -> Column:
    """``col`` trimmed, up to the separator."""
    return F.element_at(F.split(F.trim(col), sep), 1)


def shifted(col: Column) -> Column:
    return col - 1


def recoded(col: Column) -> Column:
    """0/1 to -1/1."""
    return 2 * col - 1


def file_key(col: Column, pattern: str = r"([^/]*?)(?:\.[^/.]*)?$") -> Column:
    """The key in a file name."""
    return F.regexp_extract(col, pattern, 1)


def affine(point: tuple[Column, Column, Column], matrix: np.ndarray) -> list[Column]:
    """The three coordinates of matrix @ (x, y, z, 1)."""
    x, y, z = point
    return [float(a) * x + float(b) * y + float(c) * z + F.lit(float(d)) for a, b, c, d in np.asarray(matrix, float)[:3]]


def voxel_to_mm(point, matrix) -> list[Column]:
    return affine(point, matrix)


def mm_to_voxel(point, matrix) -> list[Column]:
    """Rounded half to even."""
    return [F.rint(c).cast("long") for c in affine(point, np.linalg.inv(np.asarray(matrix, float)))]


def fill_non_finite(col: Column, default: float = 0.0) -> Column:
    """``default`` for null, NaN and infinite values."""
    odd = col.isNull() | F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(odd, F.lit(default)).otherwise(col)


def mean_mask(scores: DataFrame, obs: DataFrame, threshold: float, default: float = 0.0) -> DataFrame:
    """``scores`` (voxel_id, value) with the default where the mean observation lies below the threshold."""
    means = obs.groupBy("voxel_id").agg(F.avg("value").alias("__mean"))
    return scores.join(means, "voxel_id").select("voxel_id", F.when(F.col("__mean") < threshold, F.lit(default)).otherwise(F.col("value")).alias("value"))


def value_grid(spark: SparkSession, start: float, end: float, n: int, spacing: str = "linear", method: str = "deterministic", seed: int = 0) -> DataFrame:
    """(i, value): n values from start to end; logarithmic spacing takes exponents of 10; random ones are sorted."""
    place = F.col("id") / F.lit(max(1, n - 1)) if method == "deterministic" else F.rand(seed)
    value = F.lit(float(start)) + place * F.lit(float(end - start))
    value = F.pow(F.lit(10.0), value) if spacing == "logarithmic" else value
    df = spark.range(n).select("id", value.alias("value"))
    if method == "deterministic":
        return df.select(F.col("id").alias("i"), "value")
    ordered = df.agg(F.array_sort(F.collect_list("value")).alias("v"))  # n values, a parameter
    return ordered.select(F.posexplode("v").alias("i", "value")).select(F.col("i").cast("long"), "value")


def min_max_scale(df: DataFrame, col: str = "value") -> DataFrame:
    """``col`` scaled to [0, 1]; a constant gives 0."""
    ends = df.agg(F.min(col).alias("__low"), F.max(col).alias("__high"))
    scaled = (F.col(col) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(col, F.coalesce(scaled, F.lit(0.0))).drop("__low", "__high")


def drop_background(df: DataFrame, col: str = "value") -> DataFrame:
    return df.where(F.col(col) != 0)


def orthogonal_slice(df: DataFrame, axis: str, index: int, dims: tuple[int, int, int]) -> DataFrame:
    """(row, col, value) of the plane at ``index`` of an axis, as it is shown: the plane's second axis runs upwards."""
    across, up = [a for a in "xyz" if a != axis]
    height = dims["xyz".index(up)]
    return df.where(F.col(axis) == index).select((F.lit(height - 1) - F.col(up)).cast("long").alias("row"), F.col(across).cast("long").alias("col"), "value")


def constant_map(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))
