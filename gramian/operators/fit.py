"""Least-squares fits of one small model to every variable, and what follows from their parameters.

With one design for all variables a fit needs the products of the observations with the columns of an orthonormal basis of the design, which are
columns of the subjects table; so it is one join and one partial aggregation however many variables there are.  Variables that lack subjects are solved
by the signature of those they have.  With a design for each group the moments are aggregated and solved in columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramian.operators.design import CORRECTOR, PREDICTOR, Basis, Design, Term, factored, poly_terms, with_intercept
from gramian.operators.windows import sorted_values
from gramian.runtime import cut


def observed(obs: DataFrame, subjects: DataFrame, design: Design, basis: Basis, weight: str | None = None, value: str = "value") -> DataFrame:
    """``obs`` with a value, beside the basis columns (z0, z1, ...), weight (w) and hashed id (h) of the subject, as one struct __s."""
    w = F.expr(weight).cast("double") if weight else F.lit(1.0)
    own = F.struct(*[c.alias(f"z{k}") for k, c in enumerate(basis.columns(design))], w.alias("w"), F.xxhash64("subject_id").alias("h"))
    return obs.where(F.col(value).isNotNull()).join(design.complete(subjects, weight).select("subject_id", own.alias("__s")), "subject_id")


#: The subjects of a variable, whatever their order: how many, and the exclusive or of their ids' hashes.
SIGNATURE = ("__n", "__sign")


def signature(hashed: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("__n"), F.bit_xor(hashed).alias("__sign")]


def all_subjects(basis: Basis) -> Column:
    """Whether a row's signature is that of the whole subjects table."""
    return (F.col("__n") == basis.n) & (F.col("__sign") == F.lit(basis.sign))


def _solution(t: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The matrix that gives coefficients of the design from Z'Wy, for subjects over which Z'WZ is ``gram``; of smallest norm."""
    d, v = np.linalg.eigh(gram) if len(gram) else (np.zeros(0), gram)
    held = d > 1e-12 * d.max(initial=0.0)
    if held.all():
        return t @ (v / d) @ v.T
    root = np.sqrt(d[held])
    return np.linalg.pinv((root[:, None] * v[:, held].T) @ np.linalg.pinv(t), rcond=1e-12) @ (v[:, held] / root).T


#: So many signatures at most are sent to all tasks; more are joined.
FEW_SIGNATURES = 10_000


def by_signature(rows: DataFrame, odd: DataFrame, basis: Basis, keys: Sequence[str]) -> DataFrame:
    """(signature, solution, inverse) for the signatures of the variables ``odd`` (keys, signature) that lack subjects: the matrices that give
    coefficients and their variance factors, row by row.  A Gram matrix is summed over the observations of one variable of each signature."""
    r = basis.rank
    first = odd.groupBy(*SIGNATURE).agg(F.min(F.struct(*keys)).alias("first"))
    first = first.select(*SIGNATURE, *[F.col("first")[k].alias(f"__k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    z = lambda k: F.col("__s")[f"z{k}"]
    grams = rows.join(first, same).groupBy(*SIGNATURE).agg(F.array(*[F.sum(F.col("__s")["w"] * z(i) * z(j)) for i in range(r) for j in range(r)]).alias("gram"))

    def solve(it):
        for batch in it:
            found = [(_solution(basis.t, np.array(g, float).reshape(r, r)), np.array(g, float).reshape(r, r)) for g in batch.column(2).to_pylist()]
            lists = [pa.array([m.ravel().tolist() for m in ms], pa.list_(pa.float64())) for ms in ([s for s, _ in found], [s @ g @ s.T for s, g in found])]
            yield pa.record_batch([batch.column(0), batch.column(1), *lists], names=[*SIGNATURE, "__solution", "__inverse"])

    out = cut(grams.mapInArrow(solve, "__n long, __sign long, __solution array<double>, __inverse array<double>"))
    return F.broadcast(out) if out.count() <= FEW_SIGNATURES else out


def glm_fit(obs: DataFrame, subjects: DataFrame, design: Design, weight: str | None = None, value: str = "value", keys: Sequence[str] = ("voxel_id",)) -> DataFrame:
    """(keys, one coefficient for each term): least squares over the subjects that each variable has, of smallest norm if the design is rank-deficient.

    A variable's moments Z'Wy over the orthonormal basis of the design and the signature of its subjects come from one aggregation.  Variables
    with all subjects share one solution; for others, those with the same subjects do.  Null values, and subjects with a null
    term, are as if they weren't there; a repeated observation counts again.
    """
    basis, keys = factored(subjects, design, weight), list(keys)
    rows = observed(obs, subjects, design, basis, weight, value)
    z = [F.sum(F.col("__s")["w"] * F.col("__s")[f"z{k}"] * F.col(value)).alias(f"__b{k}") for k in range(basis.rank)]
    sums = cut(rows.groupBy(*keys).agg(*z, *signature(F.col("__s")["h"])))
    b, solution = [F.col(f"__b{k}") for k in range(basis.rank)], _solution(basis.t, basis.gram)
    dot = lambda row: sum((w * c for w, c in zip(row, b)), F.lit(0.0))
    whole = sums.where(all_subjects(basis)).select(*keys, *[dot(map(float, solution[i])).alias(n) for i, n in enumerate(design.names)])
    odd = sums.where(~all_subjects(basis))
    if odd.isEmpty():
        return whole
    at = lambda i: [F.col("__solution")[i * basis.rank + k] for k in range(basis.rank)]
    own = odd.join(by_signature(rows, odd, basis, keys), list(SIGNATURE))
    return whole.unionByName(own.select(*keys, *[dot(at(i)).alias(n) for i, n in enumerate(design.names)]))


def polyglm_fit(obs: DataFrame, subjects: DataFrame, base: Design, degrees: dict[str, int]) -> tuple[DataFrame, Design]:
    """A fit with powers of features besides ``base``; also the design."""
    design = base
    for feature, degree in degrees.items():
        design = design + poly_terms(feature, degree)
    return glm_fit(obs, subjects, design), design


def grouped_moments(df: DataFrame, keys: Sequence[str], y: str, design: Design) -> DataFrame:
    """(keys, n, a_i_j, b_i): X'X and X'y of each group, in one partial aggregation."""
    cols = [t.column for t in design.terms]
    k = len(cols)
    grams = [F.sum(cols[i] * cols[j]).alias(f"a_{i}_{j}") for i in range(k) for j in range(i + 1)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *grams, *[F.sum(cols[i] * F.col(y)).alias(f"b_{i}") for i in range(k)])


def solve_spd(moments: DataFrame, keys: Sequence[str], names: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """(keys, coefficients) of A x = b by LDL', a projection for each column; a pivot of (nearly) nothing makes them null."""
    k, df = len(names), moments
    for j in range(k):
        inner = sum((F.col(f"l_{j}_{p}") ** 2 * F.col(f"d_{p}") for p in range(j)), F.lit(0.0))
        d = F.col(f"a_{j}_{j}") - inner
        df = df.withColumn(f"d_{j}", F.when(d > floor * F.abs(F.col(f"a_{j}_{j}")), d))
        lower = {f"l_{i}_{j}": (F.col(f"a_{i}_{j}") - sum((F.col(f"l_{i}_{p}") * F.col(f"l_{j}_{p}") * F.col(f"d_{p}") for p in range(j)), F.lit(0.0))) / F.col(f"d_{j}") for i in range(j + 1, k)}
        df = df.withColumns(lower) if lower else df
    for i in range(k):
        df = df.withColumn(f"z_{i}", F.col(f"b_{i}") - sum((F.col(f"l_{i}_{p}") * F.col(f"z_{p}") for p in range(i)), F.lit(0.0)))
    for i in reversed(range(k)):
        df = df.withColumn(f"x_{i}", F.col(f"z_{i}") / F.col(f"d_{i}") - sum((F.col(f"l_{p}_{i}") * F.col(f"x_{p}") for p in range(i + 1, k)), F.lit(0.0)))
    return df.select(*keys, *[F.col(f"x_{i}").alias(n) for i, n in enumerate(names)])


#: So many rows at most show how a design's columns depend on each other.
SHOWN = 4096


def conditioned(df: DataFrame, design: Design) -> np.ndarray:
    """A matrix T without null columns that makes the columns X T nearly orthogonal: triangular, from some rows of ``df``.  Which rows they are matters for
    rounding only; a fit on X T is the fit on X whatever T is."""
    k = len(design)
    rows = df.select(*[t.column.alias(f"t{j}") for j, t in enumerate(design.terms)]).dropna().limit(SHOWN).toPandas().to_numpy(float)
    x = np.vstack([rows, np.zeros((k, k))])
    scale = np.where(np.abs(x).max(axis=0) > 0, np.abs(x).max(axis=0), 1.0)
    r = np.linalg.qr(x / scale, mode="r")
    for j in range(k):
        if abs(r[j, j]) <= 1e-10 * max(1.0, np.sqrt((r[:, j] ** 2).sum())):
            r[:j, j], r[j, j] = 0.0, 1.0
    return np.linalg.inv(r) / scale[:, None]


def glm_fit_grouped(df: DataFrame, keys: Sequence[str], y: str, design: Design) -> DataFrame:
    """(keys, coefficients): a design of its own for each group.  Moments are those of nearly orthogonal combinations of the terms, so
    that powers far from zero don't drown each other; a group that doesn't determine the terms has nulls.  Rows with a null term or outcome take no part."""
    t = conditioned(df, design)
    k = len(design)
    cols = [x.column for x in design.terms]
    own = [sum((float(t[i, j]) * cols[i] for i in range(k) if t[i, j]), F.lit(0.0)).alias(f"__z{j}") for j in range(k)]
    rows = design.complete(df).where(F.col(y).isNotNull()).select(*keys, F.col(y).alias("__y"), *own)
    plain = Design(tuple(Term(f"__c{j}", f"__z{j}") for j in range(k)))
    solved = solve_spd(grouped_moments(rows, keys, "__y", plain), keys, plain.names)
    back = [sum((float(t[i, j]) * F.col(f"__c{j}") for j in range(i, k)), F.lit(0.0)).alias(n) for i, n in enumerate(design.names)]
    return solved.select(*keys, *back)


def joined(obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design, keys: Sequence[str] = ("voxel_id",)) -> DataFrame:
    """(keys, subject_id, value, corrected, predicted): the observation without the correctors' part, and the predictors' part."""
    terms = subjects.select("subject_id", *[t.column.alias(f"t{k}") for k, t in enumerate(design.terms)])
    beta = params.select(*keys, *[F.col(f"`{n}`").alias(f"b{k}") for k, n in enumerate(design.names)])
    part = lambda role: sum((F.col(f"b{k}") * F.col(f"t{k}") for k in design.of(role)), F.lit(0.0))
    rows = obs.join(terms, "subject_id").join(beta, list(keys))
    return rows.select(*keys, "subject_id", "value", (F.col("value") - part(CORRECTOR)).alias("corrected"), part(PREDICTOR).alias("predicted"))


def predict(obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design) -> DataFrame:
    """(voxel_id, subject_id, predicted) for the rows of ``obs``."""
    return joined(obs, subjects, params, design).select("voxel_id", "subject_id", "predicted")


def correct(obs: DataFrame, subjects: DataFrame, params: DataFrame, design: Design) -> DataFrame:
    """(voxel_id, subject_id, value): observations without the correctors' part."""
    return joined(obs, subjects, params, design).select("voxel_id", "subject_id", F.col("corrected").alias("value"))


def two_stage_fit(obs: DataFrame, subjects: DataFrame, design: Design, data_is_corrected: bool = False) -> DataFrame:
    """Correctors fitted and taken off, then predictors fitted to what is left."""
    parts = {r: Design(tuple(design.terms[k] for k in design.of(r))) for r in (CORRECTOR, PREDICTOR)}
    if data_is_corrected or not len(parts[CORRECTOR]):
        return glm_fit(obs, subjects, parts[PREDICTOR])
    first = glm_fit(obs, subjects, parts[CORRECTOR])
    rest = correct(obs, subjects, first, parts[CORRECTOR])
    return first.join(glm_fit(rest, subjects, parts[PREDICTOR]), "voxel_id")


def gam_fit(obs: DataFrame, subjects: DataFrame, smoothers: dict[str, Design]) -> DataFrame:
    """(voxel_id, intercept, coefficients): an additive model whose smoothers are linear in their basis.

    Backfitting with mean-free components converges to least squares on the joined basis; so basis columns
    are centred, which makes the intercept the mean.
    """
    design = Design(tuple(t for d in smoothers.values() for t in d.terms))
    means = subjects.agg(*[F.avg(t.column) for t in design.terms]).first()
    centred = Design(tuple(Term(t.name, f"(CAST({t.sql} AS DOUBLE) - {m!r}D)", t.role) for t, m in zip(design.terms, means)))
    return glm_fit(obs, subjects, with_intercept(centred, PREDICTOR))


def gam_predict(params: DataFrame, points: DataFrame, subjects: DataFrame, smoothers: dict[str, Design]) -> DataFrame:
    """(voxel_id, point, predicted) on new values: ``points`` (point, features), a small grid, with every variable."""
    design = Design(tuple(t for d in smoothers.values() for t in d.terms))
    means = subjects.agg(*[F.avg(t.column) for t in design.terms]).first()
    at = points.select("point", *[(t.column - m).alias(f"t{k}") for k, (t, m) in enumerate(zip(design.terms, means))])
    value = F.col("intercept") + sum((F.col(f"`{n}`") * F.col(f"t{k}") for k, n in enumerate(design.names)), F.lit(0.0))
    return params.crossJoin(F.broadcast(at)).select("voxel_id", "point", value.alias("predicted"))


def curve(spark: SparkSession, params: DataFrame, subjects: DataFrame, feature: str, design: Design, points: int, start: float | None = None, end: float | None = None) -> DataFrame:
    """(voxel_id, point, t, predicted): the predictors' part on an even grid between the feature's ends, or the given ones.

    ``points`` = -1 takes the sorted values of the feature instead.
    """
    if points == -1:
        grid = sorted_values(subjects, [feature]).select((F.col("rank") - 1).alias("point"), F.col(feature).alias(feature))
    else:
        row = subjects.agg(F.min(feature), F.max(feature)).first()
        low, high = row[0] if start is None else start, row[1] if end is None else end
        grid = spark.range(points).select(F.col("id").alias("point"), (F.lit(low) + F.col("id") * F.lit((high - low) / max(1, points - 1))).alias(feature))
    own = [k for k in design.of(PREDICTOR)]
    at = grid.select("point", F.col(feature).alias("t"), *[design.terms[k].column.alias(f"t{k}") for k in own])
    value = sum((F.col(f"`{design.names[k]}`") * F.col(f"t{k}") for k in own), F.lit(0.0))
    return params.crossJoin(at).select("voxel_id", "point", "t", value.alias("predicted"))


def two_sample_ttest(obs: DataFrame, groups: DataFrame, threshold: float | None = None) -> DataFrame:
    """(voxel_id, t): pooled two-sample t of group 1 against group 0; ``groups``: (subject_id, group).

    Variables whose mean lies below ``threshold`` get 0.
    """
    g = lambda k: F.when(F.col("group") == k, F.col("value"))
    m = obs.join(groups, "subject_id").groupBy("voxel_id").agg(*[f(g(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))], F.avg("value").alias("mean"))
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = ((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / (n0 + n1 - 2)
    t = (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / n0 + 1 / n1))
    return m.select("voxel_id", (F.when(F.col("mean") < threshold, F.lit(0.0)).otherwise(t) if threshold is not None else t).alias("t"))


def fit_by_category(obs: DataFrame, subjects: DataFrame, design: Design) -> DataFrame:
    """(category, voxel_id, coefficients): an independent fit in each category."""
    cols = [t.column.alias(f"t{k}") for k, t in enumerate(design.terms)]
    rows = obs.join(subjects.select("subject_id", "category", *cols), "subject_id")
    plain = Design(tuple(Term(n, f"t{k}") for k, n in enumerate(design.names)))
    return glm_fit_grouped(rows, ["category", "voxel_id"], "value", plain)
