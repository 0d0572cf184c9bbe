"""Hyperparameter search: sampled variables, grids of values, and scores of every combination in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramian.functions.distributions import f_cdf_column
from gramian.operators.design import Design, Term, factored, poly_terms
from gramian.operators.fit import grouped_moments, solve_spd
from gramian.runtime import cut


def sample_voxels(obs: DataFrame, m: int, least_variance: float, seed: int = 0, box: dict[str, tuple[int | None, int | None]] | None = None) -> DataFrame:
    """(voxel_id, variance): m variables of enough variance inside ``box`` ({axis: (low, high)}, low <= axis < high, None: open), in the order
    of a hash of the id and seed."""
    rows = obs
    for axis, (low, high) in (box or {}).items():
        rows = rows if low is None else rows.where(F.col(axis) >= low)
        rows = rows if high is None else rows.where(F.col(axis) < high)
    v = rows.groupBy("voxel_id").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > least_variance)
    return v.orderBy(((F.col("voxel_id") + 1) * 7919 + seed * 104729) % 100003, "voxel_id").limit(m)


def grid_search(obs: DataFrame, iterations: int, m: int, least_variance: float, errors: Callable[[DataFrame], DataFrame], box: dict[str, tuple[int | None, int | None]] | None = None, score: str = "mse") -> DataFrame:
    """(iteration, combination, error): in each iteration m sampled variables, and for every combination the sum of their scores over their variances;
    null where a variable has no score.

    ``errors`` gives (voxel_id, combination, n, mse, sse, sst, df) of all combinations for the observations of the sampled variables, which are
    a bounded number (iterations times m) and are written down once; so the whole table is read for the sampling and once more.
    ``score`` is a name in SCORES.
    """
    drawn = [sample_voxels(obs, m, least_variance, i, box).withColumn("iteration", F.lit(i)) for i in range(1, iterations + 1)]
    voxels = cut(reduce(DataFrame.unionByName, drawn))
    sampled = cut(obs.join(F.broadcast(voxels.select("voxel_id").distinct()), "voxel_id"))
    rows = errors(sampled).join(F.broadcast(voxels), "voxel_id")
    return SCORES[score](rows).select("iteration", "combination", "error")


def _whole(*parts: Column) -> Column:
    """The sum over variables of the product of ``parts``, null if one of them has none."""
    product = reduce(lambda a, b: a * b, parts)
    fine = product.isNotNull() & ~F.isnan(product)
    return F.when(F.count_if(fine) == F.count(F.lit(1)), F.sum(F.when(fine, product)))


def _mse(rows: DataFrame) -> DataFrame:
    return rows.groupBy("iteration", "combination").agg(_whole(F.col("mse") / F.col("variance")).alias("error"))


def _cp(rows: DataFrame) -> DataFrame:
    """mse + 2 df s / n, s the error variances' sum over the iteration's variables, which share it."""
    shared = _whole(F.col("sse") / F.nullif(F.col("n") - 1, F.lit(0)))
    parts = rows.groupBy("iteration", "combination").agg(_whole(F.col("mse") / F.col("variance")).alias("a"), _whole(2.0 * F.col("df") / F.col("n") / F.col("variance")).alias("b"), shared.alias("s"))
    return parts.withColumn("error", F.col("a") + F.col("b") * F.col("s"))


def _anova(rows: DataFrame) -> DataFrame:
    """The F law's share above the explained over the residual mean square, 1e-12 added to each sum and number."""
    rest = F.col("n") - 1 - F.col("df")
    f = ((F.col("sst") - F.col("sse") + 1e-12) / (F.col("df") + 1e-12)) / ((F.col("sse") + 1e-12) / (rest + 1e-12))
    scored = rows.withColumn("p", 1 - f_cdf_column(f, F.col("df"), rest))
    return scored.groupBy("iteration", "combination").agg(_whole(F.col("p") / F.col("variance")).alias("error"))


#: What a search minimises, by name.
SCORES: dict[str, Callable[[DataFrame], DataFrame]] = {"mse": _mse, "cp": _cp, "anova": _anova}


def polynomial_errors(sampled: DataFrame, subjects: DataFrame, feature: str, degrees: Sequence[int]) -> DataFrame:
    """(voxel_id, combination, n, mse, sse, sst, df) of a polynomial of each degree, which is the combination.  One aggregation gives the moments of all
    of them, over orthonormal columns of which a degree takes the first ones; errors are summed over the observations, not taken from the
    moments.  A variable whose subjects don't determine a degree has nulls there."""
    top = max(degrees) + 1
    while True:  # the highest degree that the subjects' values determine
        top -= 1
        design = Design((Term("intercept", "1.0"), *poly_terms(feature, top).terms))
        basis = factored(subjects, design)
        if basis.rank == top + 1 or not top:
            break
    own = subjects.select("subject_id", *[c.alias(f"t{k}") for k, c in enumerate(basis.columns(design))])
    rows = sampled.join(own, "subject_id").where(F.col("value").isNotNull())
    width = basis.rank
    plain = Design(tuple(Term(f"c{k}", f"t{k}") for k in range(width)))
    moments = cut(grouped_moments(rows, ["voxel_id"], "value", plain))
    fits = moments.select("voxel_id")
    for degree in degrees:
        names = [f"d{degree}_{i}" for i in range(min(degree + 1, width))]
        solved = solve_spd(moments, ["voxel_id"], names)
        none = [F.lit(None).cast("double").alias(n) for n in names]
        fits = fits.join(solved if degree < width else moments.select("voxel_id", *none), "voxel_id")
    met = rows.join(fits, "voxel_id")  # as many rows as there are sampled observations
    error = lambda degree: F.col("value") - sum((F.col(f"d{degree}_{i}") * F.col(f"t{i}") for i in range(min(degree + 1, width))), F.lit(0.0))
    sums = [f(error(d)).alias(f"{n}{d}") for d in degrees for n, f in (("mse", lambda e: F.avg(e * e)), ("var", F.var_pop))]
    agg = met.groupBy("voxel_id").agg(F.count(F.lit(1)).alias("n"), (F.var_pop("value") * F.count(F.lit(1))).alias("sst"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("combination"), F.col(f"mse{d}").alias("mse"), (F.col(f"var{d}") * F.col("n")).alias("sse"), F.lit(float(d + 1)).alias("df")) for d in degrees]))
    return agg.select("voxel_id", "n", "sst", each.alias("e")).select("voxel_id", "e.combination", "n", "e.mse", "e.sse", "sst", "e.df")


def param_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """One row for each combination, numbered; the lists are parameters."""
    frames = [spark.createDataFrame([(float(v),) for v in vs], f"`{n}` double") for n, vs in values.items()]
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)
    return grid.withColumn("combination", (F.row_number().over(Window.orderBy(*values)) - 1).cast("long"))


def mse_score(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) of rows with an error."""
    return errors.groupBy(*keys).agg(F.avg(F.col("error") ** 2).alias("score"))


def cp_score(errors: DataFrame, keys: list[str], df: float) -> DataFrame:
    """(keys, score): mse + 2 df s / n, s pooled over all sampled variables."""
    per = errors.groupBy(*keys).agg(F.avg(F.col("error") ** 2).alias("mse"), F.count("*").alias("n"), F.sum(F.col("error") ** 2).alias("rss"))
    pooled = per.agg((F.sum("rss") / F.sum("n")).alias("s"))
    return per.crossJoin(F.broadcast(pooled)).select(*keys, (F.col("mse") + 2.0 * df * F.col("s") / F.col("n")).alias("score"))


def anova_statistic(errors: DataFrame, keys: list[str], df: float) -> DataFrame:
    """(keys, f): explained over residual mean square of centred errors, 1e-12 added to each."""
    n, sst, sse = F.count("*"), F.var_pop("value") * F.count("*"), F.var_pop("error") * F.count("*")
    return errors.groupBy(*keys).agg((((sst - sse) / df + 1e-12) / (sse / (n - 1 - df) + 1e-12)).alias("f"))


def anova_score(errors: DataFrame, keys: list[str], df: float, n: int) -> DataFrame:
    """(keys, score): the F law's share above the statistic."""
    return anova_statistic(errors, keys, df).select(*keys, (1 - f_cdf_column(F.col("f"), df, n - 1 - df)).alias("score"))


def best(errors: DataFrame) -> DataFrame:
    """The combination of the least error over all iterations, ties: the smallest number; one without an error only if none has one."""
    error = F.when(~F.isnan("error"), F.col("error"))
    order = F.struct(error.isNull().alias("none"), error.alias("error"), "combination", "iteration")
    return errors.agg(F.min(order).alias("b")).select("b.combination", "b.iteration", "b.error")


def error_surface(errors: DataFrame) -> DataFrame:
    """(combination, error): means over iterations, what isn't finite replaced by the greatest finite error."""
    finite = F.when(~F.isnan("error") & (F.abs("error") < float("inf")), F.col("error"))
    top = errors.agg(F.max(finite).alias("top"))
    return errors.crossJoin(F.broadcast(top)).groupBy("combination").agg(F.avg(F.coalesce(finite, F.col("top"))).alias("error"))
