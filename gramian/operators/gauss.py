"""Sums of Gaussian kernels without pairs of points: moments of cells, translated and evaluated.

Points are dealt into cells half a deviation wide.  What a cell's points add up to anywhere follows from TERMS moments about its centre (a Hermite series);
each cell passes them to the cells within REACH deviations as a Taylor series about theirs, and a point reads the sum off the series of its own cell.  So the
work grows with points and cells: moments are partial aggregates, and the series meet as sums.

The error of a sum is at most ERROR times the sum of the absolute weights within reach; beyond it a kernel is under 1e-31.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramian.runtime import cut

#: Kernels are summed over so many deviations to either side.
REACH = 12
#: Cells in a deviation, and terms of a series.
CELLS, TERMS = 2, 22
ERROR = 1e-12
#: So many cells at most are sent to all tasks; more are joined.
FEW_CELLS = 20_000


def _hermite(most: int, t: float) -> np.ndarray:
    """h[n] = He_n(t) exp(-t^2 / 2)."""
    h = np.zeros(most + 1)
    h[0] = math.exp(-t * t / 2)
    h[1] = t * h[0]
    for n in range(1, most):
        h[n + 1] = t * h[n] - n * h[n - 1]
    return h


def translations(terms: int = TERMS, reach: int = REACH) -> dict[int, np.ndarray]:
    """For each distance in cells, the matrix that turns moments (u^q / q! summed) of a cell into the series of the cell so far to its right."""
    out = {}
    for k in range(-reach * CELLS, reach * CELLS + 1):
        h = _hermite(2 * terms, k / CELLS)
        out[k] = np.array([[(-1) ** p / math.factorial(p) * h[p + q] for q in range(terms)] for p in range(terms)])
    return out


def _cell(x: str, sigma: float) -> Column:
    return F.floor(F.col(x) * (CELLS / sigma)).cast("long")


def _within(x: str, cell: str, sigma: float) -> Column:
    """The distance from the cell's centre, in deviations: a quarter at most."""
    return F.col(x) / sigma - (F.col(cell) + 0.5) / CELLS


def kernel_sums(points: DataFrame, x: str, weights: Sequence[str], at: DataFrame, g: str, sigma: float) -> DataFrame:
    """``at`` with a column sum_w for each of ``weights``: the sum over ``points`` of w exp(-(g - x)^2 / (2 sigma^2)).

    Rows of ``points`` with a null x or weight add nothing; where g is null the sums are.
    """
    rows = points.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("__x"), *[F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(f"__w{k}") for k, w in enumerate(weights)])
    rows = rows.withColumn("__c", _cell("__x", sigma))
    u = _within("__x", "__c", sigma)
    powers = [F.lit(1.0)]
    for q in range(1, TERMS):
        powers.append(powers[-1] * u / q)
    moments = rows.groupBy("__c").agg(*[F.sum(F.col(f"__w{k}") * p) for k in range(len(weights)) for p in powers]).toDF("__c", *[f"m{j}" for j in range(len(weights) * TERMS)])
    wide = len(weights) * TERMS

    def spread(it):
        known = translations()
        for batch in it:
            cell = batch.column(0).to_numpy()
            m = np.column_stack([batch.column(j + 1).to_numpy() for j in range(wide)]).reshape(len(cell), len(weights), TERMS)
            for k, t in known.items():
                series = (m @ t.T).reshape(len(cell), wide)
                yield pa.record_batch([pa.array(cell + k), *[pa.array(series[:, j]) for j in range(wide)]], names=["__c", *[f"l{j}" for j in range(wide)]])

    # Cells that nothing is asked of get no series; of points there are no more rows than before.
    asked = at.withColumn("__g", F.col(g).cast("double")).withColumn("__c", _cell("__g", sigma))
    cells = cut(asked.where("__c is not null").select("__c").distinct())
    few = cells.count() <= FEW_CELLS
    sent = moments.mapInArrow(spread, "__c long, " + ", ".join(f"l{j} double" for j in range(wide)))
    met = sent.join(F.broadcast(cells) if few else cells, "__c", "left_semi")
    local = met.groupBy("__c").agg(*[F.sum(f"l{j}").alias(f"l{j}") for j in range(wide)])
    v = _within("__g", "__c", sigma)
    joined = asked.join(F.broadcast(local) if few else local, "__c", "left")
    sums = []
    for k in range(len(weights)):
        value = F.col(f"l{(k + 1) * TERMS - 1}")
        for p in range(TERMS - 2, -1, -1):
            value = value * v + F.col(f"l{k * TERMS + p}")
        sums.append(F.when(F.col("__g").isNotNull(), F.coalesce(value, F.lit(0.0))).alias(f"sum_{weights[k]}"))
    return joined.select(*at.columns, *sums)
