"""The data behind distribution plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.operators.gauss import kernel_sums
from gramian.operators.windows import quantile, same_keys, value_counts


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts in equal bins from 1; below low: bin 0, from high on: bins + 1."""
    return df.groupBy(F.width_bucket(F.col(col), F.lit(low), F.lit(high), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, col: str, grid: DataFrame, bandwidth: float) -> DataFrame:
    """(g, density): Gaussian estimate at the grid's points.  Equal values are counted first; the rest are moments."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("u")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("__n"))  # one row
    sums = kernel_sums(counts, "u", ["n"], grid.select("g").distinct(), "g", bandwidth).crossJoin(F.broadcast(whole))
    return sums.select("g", (F.col("sum_n") / F.col("__n") / (bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def density2d(df: DataFrame, x: str, y: str, grid: DataFrame, bx: float, by: float) -> DataFrame:
    """(gx, gy, density); ``grid``: (gx, gy)."""
    counts = df.groupBy(F.col(x).alias("u"), F.col(y).alias("v")).agg(F.count("*").alias("n"))
    k = F.exp(-((F.col("gx") - F.col("u")) ** 2) / (2 * bx**2) - ((F.col("gy") - F.col("v")) ** 2) / (2 * by**2)) / (2 * math.pi * bx * by)
    return counts.crossJoin(F.broadcast(grid)).groupBy("gx", "gy").agg((F.sum(F.col("n") * k) / F.sum("n")).alias("density"))


def box_stats(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(by, q1, median, q3, low, high, outliers): quartiles, whiskers at the last values within 1.5 quartile distances, and
    how many lie beyond.  The table is read once, to count its values; quartiles are read at their ranks among the counts."""
    by = by or []
    counts = value_counts(df.where(F.col(col).isNotNull()).select(*by, col), col, by)
    q = counts.groupBy(*by).agg(*[quantile(col, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    q = q.select(*[F.col(k).alias(f"__{k}") for k in by], "q1", "median", "q3")
    rows = counts.join(q, same_keys(by)) if by else counts.crossJoin(F.broadcast(q))  # one row
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(col).between(F.col("q1") - reach, F.col("q3") + reach)
    out = rows.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(col))).alias("low"), F.max(F.when(inside, F.col(col))).alias("high"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"))
    return out.where("q1 is not null")
