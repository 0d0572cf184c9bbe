"""Subject metadata sheets: reading, typing, slicing and the subjects table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramian.operators.windows import numbered


def read_metadata(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header; column names trimmed and in lower case, all values strings."""
    df = spark.read.csv(path, header=True, sep=sep)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def typed_rows(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The fields cast to their types: what can't be cast is null, a field that is absent is a null column, and
    rows in which every present field is null are dropped."""
    names = {c.strip().lower(): c for c in df.columns}
    present = [f for f in fields if f.lower() in names]
    cols = [F.trim(F.col(names[f.lower()])).try_cast(t).alias(f) if f in present else F.lit(None).cast(t).alias(f) for f, t in fields.items()]
    out = df.select(*cols)
    return out.dropna(how="all", subset=present) if present else out.limit(0)


def row_slice(df: DataFrame, order: str | Column, start: int, end: int) -> DataFrame:
    """Rows start (0-based) to end, exclusive, by ``order``; numbered range by range, so a slice deep in a large sheet is no task's alone."""
    key = F.col(order) if isinstance(order, str) else order
    # Rows of one key are dealt out by what else they hold.
    placed = numbered(df.withColumn("__order", key), F.col("__order"), F.xxhash64(*df.columns), as_number="__rank")
    return placed.where((F.col("__rank") > start) & (F.col("__rank") <= end)).select(*df.columns)


def subject_table(df: DataFrame, id_field: str, category: str | None, predictors: list[str], correctors: list[str], folder: str = "", extension: str = "") -> DataFrame:
    """(subject_id, category, predictors..., correctors..., image): rows with a blank id, or a null predictor or
    corrector, are dropped; the image key is folder + id + extension."""
    key = F.trim(F.col(id_field))
    doubles = [F.trim(F.col(c)).try_cast("double").alias(c) for c in [*predictors, *correctors]]
    group = F.trim(F.col(category)).try_cast("int") if category else F.lit(None).cast("int")
    out = df.where(key.isNotNull() & (key != "")).select(key.alias("subject_id"), group.alias("category"), *doubles, F.concat(F.lit(folder), key, F.lit(extension)).alias("image"))
    return out.dropna(subset=[*predictors, *correctors])
