"""Local regression and kernel smoothing, on a grid of given points.

Kernel sums come from moments of cells (see ``gauss``), local polynomials from prefix sums of powers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramian.operators.gauss import kernel_sums
from gramian.runtime import cut

def kernel_smooth(df: DataFrame, x: str, y: str, sigma: float, grid: DataFrame) -> DataFrame:
    """(g, value): Gaussian-weighted means at the points g of ``grid``; null where no point is within reach.  Equal values of x are one point."""
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("u")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"))
    sums = kernel_sums(points, "u", ["n", "y"], grid.select("g"), "g", sigma)
    return sums.select("g", F.when(F.col("sum_n") > 1e-9, F.col("sum_y") / F.col("sum_n")).alias("value"))


def kernel_df(df: DataFrame, x: str, sigma: float) -> DataFrame:
    """(df): the trace of S S' of the row-normalised kernel matrix.  Equal values of x are one point with a count; the squared kernel is one of a
    narrower deviation, so both sums come from moments and no pair is made."""
    points = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    once = kernel_sums(points, "u", ["n"], points, "u", sigma).withColumnRenamed("sum_n", "whole")
    both = kernel_sums(points, "u", ["n"], once, "u", sigma / math.sqrt(2))
    return both.agg(F.sum(F.col("n") * F.col("sum_n") / F.col("whole") ** 2).alias("df"))


def band_join(df: DataFrame, x: str, grid: DataFrame, span: float) -> DataFrame:
    """Rows of ``df`` with the grid points within ``span`` of x.  Both are put in bins as wide as the span, and a grid point
    also in the bins beside its own, so the join has an equal key."""
    bin_of = lambda c: F.floor(F.col(c) / span).cast("long")
    near = grid.withColumn("bin", F.explode(F.array(*[bin_of("g") + k for k in (-1, 0, 1)])))
    return df.withColumn("bin", bin_of(x)).join(near, "bin").where(F.abs(F.col("g") - F.col(x)) <= span).drop("bin")


def span_of(df: DataFrame, x: str, percent: float) -> float:
    """The distance that is ``percent`` of the range of x; 0 if there is none."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    return 0.0 if low is None else float(high - low) * percent / 100


#: (1 - t^3)^3 as coefficients of t^0, t^3, t^6 and t^9.
TRICUBE = (1.0, -3.0, 3.0, -1.0)


def _prefix_moments(points: DataFrame, grid: DataFrame, span: float, powers: int) -> tuple[DataFrame, DataFrame]:
    """Marks (g, mark, cell, v0, v1, ...) and cells (cell, v0, v1, ...).  Cells are as wide as the span; v are sums of n u^p and of y u^p, p = 0, 1, ..., over a cell's
    ``points`` (x, n, y), u the distance from its middle over the span; of a mark, over those up to g - span, g or g + span.  The last v is the
    number of different x.

    Points and marks are dealt out by range and sorted together, and each task adds up what it has; what earlier ranges have of a cell is added
    after.  So a dense cell is many tasks' work.
    """
    names = [f"v{k}" for k in range(2 * powers + 1)]
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), (F.col("g") + (k - 1) * span).alias("x")) for k in range(3)]))
    marks = grid.where("g is not null").select("g").distinct().select("g", ends.alias("e")).select("e.x", F.lit(0.0).alias("n"), F.lit(0.0).alias("y"), "g", "e.mark")
    rows = points.select("x", F.col("n").cast("double").alias("n"), "y", F.lit(None).cast("double").alias("g"), F.lit(None).cast("int").alias("mark")).unionByName(marks)

    def add(it):
        part, cell, held = TaskContext.get().partitionId(), None, np.zeros(len(names))
        for batch in it:
            x, n, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(x):
                continue
            of = np.floor(x / span).astype(np.int64)
            u = (x / span - of - 0.5)[:, None] ** np.arange(powers)
            each = np.hstack([n[:, None] * u, y[:, None] * u, (n > 0)[:, None]])
            is_mark = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(x)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if cell is not None and of[a] != cell:
                    yield whole(part, cell, held)
                    held = np.zeros(len(names))
                cell, sums = int(of[a]), held + np.cumsum(each[a:b], axis=0)
                held = sums[-1]
                at = np.flatnonzero(is_mark[a:b])
                if len(at):
                    yield pa.record_batch([batch.column(k).slice(a, b - a).take(pa.array(at)) for k in (3, 4)] + [pa.array(np.full(len(at), cell)), pa.array(np.full(len(at), part)), *[pa.array(sums[at, k]) for k in range(len(names))]], names=["g", "mark", "cell", "part", *names])
        if cell is not None:
            yield whole(part, cell, held)

    def whole(part, cell, held):
        return pa.record_batch([pa.array([None], pa.float64()), pa.array([None], pa.int32()), pa.array([cell]), pa.array([part]), *[pa.array([v]) for v in held.tolist()]], names=["g", "mark", "cell", "part", *names])

    placed = rows.repartitionByRange("x").sortWithinPartitions("x", F.col("mark").asc_nulls_first())
    found = cut(placed.mapInArrow(add, "g double, mark int, cell long, part long, " + ", ".join(f"{v} double" for v in names)))
    parts = found.where("mark is null")
    # A cell has a row for each range that it reaches into.
    earlier = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("cell", "part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0.0)).alias(f"b_{v}") for v in names])
    marked = found.where("mark is not null").join(before, ["cell", "part"]).select("g", "mark", "cell", *[(F.col(v) + F.col(f"b_{v}")).alias(v) for v in names])
    return marked, parts.groupBy("cell").agg(*[F.sum(v).alias(v) for v in names])


def _weighted_moments(rows: DataFrame, span: float, degree: int, powers: int) -> DataFrame:
    """(g, s0, s1, ..., t0, t1, ..., kinds): tricube-weighted sums of d^k, and of y d^k, d the distance from g over the span, of ``rows`` (g, side, sign, cell, v0, v1, ...): moments
    of points to the left (side -1) or right (1) of g, to be added or taken off.
    kinds: how many different x there are."""
    out = [f"s{k}" for k in range(2 * degree + 1)] + [f"t{k}" for k in range(degree + 1)] + ["kinds"]

    def shift(it):
        for batch in it:
            g, side, sign, cell = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4))
            v = np.column_stack([batch.column(k + 4).to_numpy(zero_copy_only=False) for k in range(2 * powers + 1)])
            away = (cell + 0.5 - g / span)[:, None] ** np.arange(powers)
            about = lambda m: np.column_stack([sum(math.comb(p, q) * away[:, p - q] * m[:, q] for q in range(p + 1)) for p in range(powers)])
            n, y = about(v[:, :powers]), about(v[:, powers : 2 * powers])
            # (side d)^3k is side^k d^3k.
            weigh = lambda m, j: sign * sum(c * side**k * m[:, 3 * k + j] for k, c in enumerate(TRICUBE))
            sums = [weigh(n, j) for j in range(2 * degree + 1)] + [weigh(y, j) for j in range(degree + 1)] + [sign * v[:, -1]]
            yield pa.record_batch([batch.column(0), *map(pa.array, sums)], names=["g", *out])

    return rows.mapInArrow(shift, "g double, " + ", ".join(f"{c} double" for c in out)).groupBy("g").agg(*[F.sum(c).alias(c) for c in out])


def lowess(df: DataFrame, x: str, y: str, span: float, grid: DataFrame, degree: int = 1, percent: bool = False) -> DataFrame:
    """(g, value): local polynomials of degree 1 or 2 with tricube weights of what lies within ``span`` (a distance, or with ``percent`` a
    percentage of the range of x); null where the points don't determine one.  Rows with a null x or y take no part.

    On either side of g the weight is a polynomial, so a sum over the band is a difference of prefix sums of powers, taken about the middle of
    cells: three for each point of the grid, and no point of the data meets one of the grid.
    """
    span = (span_of(df, x, span) if percent else span) or 1.0
    powers = 3 * (len(TRICUBE) - 1) + 2 * degree + 1
    names = [f"v{k}" for k in range(2 * powers + 1)]
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("y"))
    asked = grid.select(F.col("g").cast("double").alias("g"))
    marks, cells = _prefix_moments(points, asked, span, powers)
    marks = cut(marks)
    # What lies left of g is up to g less what is up to g - span; what lies right of it likewise; and the cells in between are whole.
    use = F.explode(F.when(F.col("mark") == 0, F.array(F.struct(F.lit(-1).alias("side"), F.lit(-1).alias("sign")))).when(F.col("mark") == 1, F.array(F.struct(F.lit(-1).alias("side"), F.lit(1).alias("sign")), F.struct(F.lit(1).alias("side"), F.lit(-1).alias("sign")))).otherwise(F.array(F.struct(F.lit(1).alias("side"), F.lit(1).alias("sign")))))
    edges = marks.select("g", use.alias("u"), "cell", *names).select("g", "u.side", "u.sign", "cell", *names)
    of = marks.groupBy("g").agg(*[F.max(F.when(F.col("mark") == k, F.col("cell"))).alias(f"c{k}") for k in range(3)])

    def whole_cells(k: int) -> Column:
        """(side, cell): the cells from the one of mark k on, before that of the next mark."""
        near = F.filter(F.array(F.col(f"c{k}"), F.col(f"c{k}") + 1), lambda c: c < F.col(f"c{k + 1}"))
        return F.transform(near, lambda c: F.struct(F.lit(2 * k - 1).alias("side"), c.alias("cell")))

    between = of.select("g", F.explode(F.concat(whole_cells(0), whole_cells(1))).alias("w")).select("g", "w.side", F.lit(1).alias("sign"), "w.cell").join(cells, "cell").select("g", "side", "sign", "cell", *names)
    sums = _weighted_moments(edges.unionByName(between), span, degree, powers)
    s, t = [F.col(f"s{k}") for k in range(2 * degree + 1)], [F.col(f"t{k}") for k in range(degree + 1)]
    if degree == 1:
        top, det, size = s[2] * t[0] - s[1] * t[1], s[0] * s[2] - s[1] * s[1], s[0] * s[2]
    else:
        det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * s[3] - s[2] * s[2])
        top = t[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (t[1] * s[4] - s[3] * t[2]) + s[2] * (t[1] * s[3] - s[2] * t[2])
        size = s[0] * s[2] * s[4]
    fits = sums.select("g", F.when((F.col("kinds") > degree) & (s[0] > 1e-10) & (F.abs(det) > 1e-9 * F.abs(size)), top / det).alias("value"))
    return asked.join(fits, "g", "left").select("g", "value")
