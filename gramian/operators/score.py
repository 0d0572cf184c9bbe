"""Fit scores: aggregations over the observations of a variable.

A metric names the quantities it needs and gives an aggregate column, so that all metrics of an evaluation are
one aggregation.  Quantities: ``corrected``, ``predicted``, ``value`` (columns), ``n`` (aggregate), ``df_c``, ``df_p`` (numbers),
and for tstat ``beta`` (columns) and ``inverse_gram`` (numbers).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramian.functions.columns import fill_non_finite, mean_mask
from gramian.functions.distributions import f_cdf_column, t_quantile, t_quantile_column
from gramian.operators.design import CORRECTOR, PREDICTOR, Basis, Design, factored
from gramian.operators.fit import SIGNATURE, all_subjects, by_signature, joined, observed, signature
from gramian.operators.windows import differences
from gramian.runtime import cut

#: Points of a curve's interval, which are sent to all tasks.
MOST_POINTS = 100_000

Metric = Callable[[dict], Column]
METRICS: dict[str, Metric] = {}


def register_metric(name: str, fn: Metric) -> None:
    """Make ``fn`` known: it takes the quantities and returns an aggregate column; it may call other metrics."""
    METRICS[name] = fn


def _error(q: dict) -> Column:
    return q["corrected"] - q["predicted"]


def mse(q: dict) -> Column:
    return F.avg(_error(q) ** 2)


def r2(q: dict) -> Column:
    """On corrected data; null for constant data."""
    return 1 - F.sum(_error(q) ** 2) / F.nullif(F.var_pop(q["corrected"]) * F.count("*"), F.lit(0.0))


def fstat(q: dict) -> Column:
    """Explained over residual mean square; the data are not centred."""
    rss = F.sum(_error(q) ** 2)
    return ((F.sum(q["corrected"] ** 2) - rss) / q["df_p"]) / (rss / (F.count("*") - q["df_c"] - q["df_p"]))


def aic(q: dict) -> Column:
    n, rss = F.count("*").cast("double"), F.sum(_error(q) ** 2)
    likelihood = -n / 2 * (F.lit(float(np.log(2 * np.pi))) + F.log(rss) - F.log(n) + 1)
    return 2.0 * (q["df_c"] + q["df_p"] + 1) - 2 * likelihood


for _name, _fn in (("mse", mse), ("r2", r2), ("fstat", fstat), ("aic", aic)):
    register_metric(_name, _fn)


def evaluate(obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design, metrics: list[str], df_c: float | None = None, df_p: float | None = None) -> DataFrame:
    """(voxel_id, one column for each metric)."""
    q = {"corrected": F.col("corrected"), "predicted": F.col("predicted"), "value": F.col("value"), "df_c": float(len(design.of(CORRECTOR)) if df_c is None else df_c), "df_p": float(len(design.of(PREDICTOR)) if df_p is None else df_p)}
    return joined(obs, subjects, params, design).groupBy("voxel_id").agg(*[METRICS[m](q).alias(m) for m in metrics])


def ftest(scores: DataFrame, df_p: float, df_rest: float, col: str = "fstat") -> DataFrame:
    """The F law's share below each F value: 1 - p."""
    return scores.withColumn("ftest", f_cdf_column(F.col(col), df_p, df_rest))


def _residuals(obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design) -> DataFrame:
    """(voxel_id, rss, signature) of each variable."""
    rows = joined(obs, subjects, params, design)
    error = F.col("corrected") - F.col("predicted")
    return rows.where(error.isNotNull()).groupBy("voxel_id").agg(F.sum(error**2).alias("rss"), *signature(F.xxhash64("subject_id")))


def _factors(obs: DataFrame, subjects: DataFrame, design: Design, rss: DataFrame) -> tuple[Basis, np.ndarray, DataFrame | None]:
    """The basis, the variance factors (X'X)^+ of variables with all subjects, and (signature, __inverse) of those that lack some, if any do."""
    basis = factored(subjects, design)
    whole = basis.t @ np.linalg.pinv(basis.gram, hermitian=True) @ basis.t.T
    odd = rss.where(~all_subjects(basis))
    return basis, whole, None if odd.isEmpty() else by_signature(observed(obs, subjects, design, basis), odd, basis, ["voxel_id"])


def tstat(obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design, term: str) -> DataFrame:
    """(voxel_id, tstat) of one coefficient: its value over sqrt(RSS / (n - df_p) * its variance factor), n and the factor over the subjects
    that the variable has."""
    k = design.names.index(term)
    rss = cut(_residuals(obs, subjects, params, design))
    basis, whole, other = _factors(obs, subjects, design, rss)
    factor = F.lit(float(whole[k, k]))
    if other is not None:
        rss = rss.join(other.select(*SIGNATURE, F.col("__inverse")[k * len(design) + k].alias("__own")), list(SIGNATURE), "left")
        factor = F.when(all_subjects(basis), factor).otherwise(F.col("__own"))
    t = F.col(f"`{term}`") / F.sqrt(F.col("rss") / (F.col("__n") - len(design.of(PREDICTOR))) * factor)
    return rss.join(params, "voxel_id").select("voxel_id", t.alias("tstat"))


def roughness(curves: DataFrame) -> DataFrame:
    """(voxel_id, roughness, spread): sum of squared second differences over the fourth power of the step, and the variance of each curve."""
    ends = curves.groupBy("voxel_id").agg(((F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("step"), F.var_pop("predicted").alias("spread"))
    d = differences(curves).groupBy("voxel_id").agg(F.sum(F.col("second") ** 2).alias("bends"))
    return d.join(ends, "voxel_id").select("voxel_id", (F.col("bends") / F.col("step") ** 4).alias("roughness"), "spread")


def prss(scores: DataFrame, curves: DataFrame, gamma: float) -> DataFrame:
    """(voxel_id, prss, vnprss): mse + gamma * roughness, and that over the curve's variance; ``scores`` has mse."""
    rows = scores.join(roughness(curves), "voxel_id").withColumn("prss", F.col("mse") + gamma * F.col("roughness"))
    return rows.select("voxel_id", "prss", (F.col("prss") / F.nullif(F.col("spread"), F.lit(0.0))).alias("vnprss"))


def model_df(kind: str, **settings) -> float:
    """Degrees of freedom that follow from a model's form: glm (columns), pls (components), polynomial (degree + 1), spline (df), intercept (1).
    Those of support vectors and kernels follow from a fit, see ``fitted_df``."""
    return float({"glm": lambda: settings["columns"], "pls": lambda: settings["components"], "polynomial": lambda: settings["degree"] + 1, "spline": lambda: settings["df"], "intercept": lambda: 1}[kind]())


def fitted_df(kind: str, rows: DataFrame, **settings) -> DataFrame:
    """(voxel_id, df) of fitted models: glm, polynomial, spline, intercept and pls (their form, for every variable of ``rows``); kernel (x, sigma: the trace of
    S S' over the distinct subjects in ``rows``); linear_svr and gaussian_svr (c, epsilon; ``rows`` as ``svr.svr_df`` takes them)."""
    from gramian.operators import local, svr

    if kind in ("linear_svr", "gaussian_svr"):
        return svr.svr_df(rows, settings["c"], settings["epsilon"]).withColumn("df", F.col("df").cast("double"))
    voxels = rows.select("voxel_id").distinct()
    if kind == "kernel":
        own = local.kernel_df(rows.select("subject_id", settings["x"]).distinct(), settings["x"], settings["sigma"])
        return voxels.crossJoin(F.broadcast(own))  # one row
    return voxels.withColumn("df", F.lit(model_df(kind, **settings)))


def evaluate_fit(obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design, metric: str, threshold: float | None = None, fill: float = 0.0) -> DataFrame:
    """(voxel_id, value): correct, predict, score, replace what isn't finite, and mask variables of a low mean."""
    scores = evaluate(obs, subjects, params, design, [metric]).select("voxel_id", fill_non_finite(F.col(metric), fill).alias("value"))
    return scores if threshold is None else mean_mask(scores, obs, threshold, fill)


def curve_interval(spark: SparkSession, obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design, points: DataFrame, level: float = 0.95) -> DataFrame:
    """(voxel_id, point, predicted, se, low, high): ``points`` (point, the design's features), a grid of MOST_POINTS at most, with every variable.  The
    error variance and its degrees of freedom are over the subjects that the variable has."""
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    k = range(len(design))
    rss = cut(_residuals(obs, subjects, params, design))
    basis, whole, other = _factors(obs, subjects, design, rss)
    pairs = [(i, j) for i in k for j in k]
    t = [F.col(f"__t{i}") for i in k]
    factor = sum((float(whole[i, j]) * t[i] * t[j] for i, j in pairs), F.lit(0.0))
    rest = F.col("__n") - len(design)
    quantile = F.lit(t_quantile(0.5 + level / 2, basis.n - len(design)) if basis.n > len(design) else None).cast("double")
    if other is not None:
        rss = rss.join(other.select(*SIGNATURE, "__inverse"), list(SIGNATURE), "left")
        own = sum((F.col("__inverse")[i * len(design) + j] * t[i] * t[j] for i, j in pairs), F.lit(0.0))
        factor = F.when(all_subjects(basis), factor).otherwise(own)
        quantile = F.when(all_subjects(basis), quantile).otherwise(t_quantile_column(0.5 + level / 2, rest))
    at = points.select("point", *[x.column.alias(f"__t{i}") for i, x in enumerate(design.terms)])
    rows = rss.join(params, "voxel_id").crossJoin(F.broadcast(at))
    value = sum((F.col(f"`{m}`") * t[i] for i, m in enumerate(design.names)), F.lit(0.0))
    rows = rows.select("voxel_id", "point", value.alias("predicted"), F.sqrt(F.col("rss") / F.when(rest > 0, rest) * factor).alias("se"), quantile.alias("__q"))
    low, high = (F.col("predicted") + s * F.col("__q") * F.col("se") for s in (-1, 1))
    return rows.select("voxel_id", "point", "predicted", "se", low.alias("low"), high.alias("high"))
