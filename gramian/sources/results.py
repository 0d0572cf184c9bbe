"""Stored parameters, maps and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(params: DataFrame, path: str) -> None:
    """Parameters in folders by model and category."""
    params.write.mode("overwrite").partitionBy("model", "category").parquet(path)


def results_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, model, category) of stored results; a name ends in -category_N, or in _vs_all or nothing: no category."""
    names = spark.read.parquet(path).select(F.col("model").alias("name")).distinct()
    category = F.regexp_extract("name", r"-category_(\d+)$", 1)
    return names.select("name", F.regexp_replace("name", r"(-category_\d+|_vs_all)$", "").alias("model"), F.when(category != "", category.cast("int")).alias("category"))


def read_roi(spark: SparkSession, path: str, id_col: str, name_col: str) -> DataFrame:
    """(roi_id, roi_name) of a table separated by semicolons."""
    df = spark.read.csv(path, header=True, sep=";")
    return df.select(F.col(id_col).cast("long").alias("roi_id"), F.col(name_col).alias("roi_name"))


def write_error_table(df: DataFrame, path: str) -> None:
    """Grid-search scores, rounded to 2 decimals, separated by semicolons."""
    cols = [F.round(c, 2).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, sep=";")


def collect_maps(maps: dict[str, DataFrame]) -> DataFrame:
    """One table of named maps."""
    named = [df.select(F.lit(name).alias("map_name"), "voxel_id", "value") for name, df in maps.items()]
    return reduce(DataFrame.unionByName, named)
