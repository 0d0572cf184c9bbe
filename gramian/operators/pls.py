"""Partial least squares of one outcome for every variable, and the latent effects that follow from it.

PLS1 needs X'X of the centred features and X'y of each variable, over the subjects that the variable has; each component is a
step on these, as column expressions, so a fit is one aggregation whatever the number of components.  Permuted effects are matrix products of blocks of
variables with permuted features, inside tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramian.operators.windows import numbered

#: The features of all subjects are so many numbers at most, which are sent to all tasks.
MOST_NUMBERS = 1 << 25
#: A group's observations are about so many at most, and so many permutations are multiplied at a time.
GROUP_ROWS, TOGETHER = 1 << 20, 64
#: Subjects whose permuted features are held at a time, and places that a task permutes.
HELD, TASK_PLACES = 4096, 1 << 17


def _features(subjects: DataFrame, features: Sequence[str]) -> DataFrame:
    """(subject_id, x0, x1, ...) of the subjects with all features."""
    return subjects.select("subject_id", *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)]).dropna(subset=[f"x{k}" for k in range(len(features))])


def _sum(terms) -> Column:
    return sum(terms, F.lit(0.0))


def pls_fit(obs: DataFrame, subjects: DataFrame, features: Sequence[str], components: int, keys: Sequence[str] = ("voxel_id",)) -> DataFrame:
    """(keys, mean, rot_l_f, coef_f, at_f): the mean of the outcome, rotations of each component, coefficients of the features, and the features' means, over
    the subjects with a value.

    A variable that doesn't vary has its mean, and zeros.
    """
    x, r = _features(subjects, features), range(len(features))
    middle = x.agg(*[F.avg(f"x{k}") for k in r]).first()
    near = x.select("subject_id", *[(F.col(f"x{k}") - F.lit(middle[k] or 0.0)).alias(f"x{k}") for k in r])
    sums = [F.sum(f"x{k}").alias(f"m{k}") for k in r] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in r for j in r if j <= i]
    df = obs.where(F.col("value").isNotNull()).join(near, "subject_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), *sums, *[F.sum(F.col(f"x{k}") * F.col("value")).alias(f"c{k}") for k in r])
    df = df.withColumns({f"g{i}_{j}": F.col(f"p{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") / F.col("n") for i in r for j in r if j <= i} | {f"s0_{k}": F.col(f"c{k}") - F.col(f"m{k}") * F.col("mean") for k in r})
    gram = lambda i, j: F.col(f"g{max(i, j)}_{min(i, j)}")
    quadratic = lambda a, b: _sum(gram(i, j) * a[i] * b[j] for i in r for j in r)
    for c in range(components):
        s = [F.col(f"s{c}_{k}") for k in r]
        norm = F.sqrt(_sum(v * v for v in s))
        df = df.withColumns({f"w{c}_{k}": F.coalesce(s[k] / F.nullif(norm, F.lit(0.0)), F.lit(0.0)) for k in r})
        # The rotation: the weight, less what earlier components have of it.
        w = [F.col(f"w{c}_{i}") for i in r]
        df = df.withColumns({f"h{c}_{p}": F.coalesce(quadratic([F.col(f"r{p}_{i}") for i in r], w) / F.nullif(F.col(f"tt{p}"), F.lit(0.0)), F.lit(0.0)) for p in range(c)})
        df = df.withColumns({f"r{c}_{k}": w[k] - _sum(F.col(f"r{p}_{k}") * F.col(f"h{c}_{p}") for p in range(c)) for k in r})
        v = [F.col(f"r{c}_{k}") for k in r]
        df = df.withColumn(f"tt{c}", quadratic(v, v))
        df = df.withColumn(f"q{c}", F.coalesce(_sum(v[k] * F.col(f"s0_{k}") for k in r) / F.nullif(F.col(f"tt{c}"), F.lit(0.0)), F.lit(0.0)))
        df = df.withColumns({f"s{c + 1}_{k}": F.col(f"s{c}_{k}") - F.col(f"q{c}") * _sum(gram(k, i) * v[i] for i in r) for k in r})
    flat = F.col("var") <= 0
    zero = lambda c: F.when(flat, F.lit(0.0)).otherwise(c)
    rots = [zero(F.col(f"r{c}_{k}")).alias(f"rot_{c}_{f}") for c in range(components) for k, f in enumerate(features)]
    coefs = [zero(_sum(F.col(f"r{c}_{k}") * F.col(f"q{c}") for c in range(components))).alias(f"coef_{f}") for k, f in enumerate(features)]
    ats = [(F.lit(middle[k] or 0.0) + F.col(f"m{k}") / F.col("n")).alias(f"at_{f}") for k, f in enumerate(features)]
    return df.select(*keys, "mean", *rots, *coefs, *ats)


def _with_features(obs: DataFrame, subjects: DataFrame, features: Sequence[str], params: DataFrame) -> DataFrame:
    return obs.join(_features(subjects, features), "subject_id").join(params, "voxel_id")


def _apart(features: Sequence[str]) -> list[Column]:
    """The features less their means over the variable's subjects."""
    return [F.col(f"x{k}") - F.col(f"at_{f}") for k, f in enumerate(features)]


def pls_predict(obs: DataFrame, subjects: DataFrame, features: Sequence[str], params: DataFrame) -> DataFrame:
    """(voxel_id, subject_id, predicted)."""
    value = F.col("mean") + _sum(F.col(f"coef_{f}") * x for f, x in zip(features, _apart(features)))
    return _with_features(obs, subjects, features, params).select("voxel_id", "subject_id", value.alias("predicted"))


def pls_transform(obs: DataFrame, subjects: DataFrame, features: Sequence[str], params: DataFrame, components: int) -> DataFrame:
    """(voxel_id, subject_id, t_l, u): scores of the features and of the outcome, for each observation with a value."""
    scores = [_sum(F.col(f"rot_{c}_{f}") * x for f, x in zip(features, _apart(features))).alias(f"t_{c}") for c in range(components)]
    return _with_features(obs, subjects, features, params).where(F.col("value").isNotNull()).select("voxel_id", "subject_id", *scores, (F.col("value") - F.col("mean")).alias("u"))


def effect_strength(scores: DataFrame, component: int, keys: Sequence[str] = ("voxel_id",)) -> DataFrame:
    """(keys, strength): sum of t u / (n - 1) over the population deviations of both; 0 where one doesn't vary."""
    t = F.col(f"t_{component}")
    spread = F.stddev_pop(t) * F.stddev_pop("u")
    return scores.groupBy(*keys).agg(F.coalesce(F.sum(t * F.col("u")) / (F.count("*") - 1) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("strength"))


def effect_type(params: DataFrame, component: int, features: Sequence[str]) -> DataFrame:
    """(voxel_id, predictor, rotation)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("predictor"), F.col(f"rot_{component}_{f}").alias("rotation")) for f in features]))
    return params.select("voxel_id", pairs.alias("p")).select("voxel_id", "p.*")


_PRIME = (1 << 31) - 1


def rounds_of(n: int) -> int:
    return 6 * max(1, math.ceil(math.log2(max(n, 2))))


def _partner(x, turn, key, n, where: Callable, largest: Callable):
    """One round of a keyed bijection of 0 to n - 1: every number has a partner, and a bit that both share says whether they change places.  Works on
    numbers and arrays alike."""
    k = (turn * 69621 + key * 40692 + 12345) % _PRIME
    k = (k * k % _PRIME * 48271 + turn) % _PRIME % n
    other = (k + n - x) % n
    high = largest(x, other)
    t = (high * 48271 + turn * 69621 + key * 40692 + 1) % _PRIME
    t = (t * t % _PRIME + high * 16807 + turn * 7919) % _PRIME
    return where(t * t % _PRIME % 2 == 1, other, x)


def permuted_places(n: int, keys: np.ndarray, inverse: bool = False, first: int = 0, last: int | None = None) -> np.ndarray:
    """(places, keys): where each of the places 0 to n - 1, or of those from ``first`` to before ``last``, goes under the bijection of each key, or comes from."""
    places = np.arange(first, n if last is None else min(last, n))
    x = np.broadcast_to(places[:, None], (len(places), len(keys)))
    turns = range(1, rounds_of(n) + 1)
    for turn in reversed(turns) if inverse else turns:
        x = _partner(x, turn, keys[None, :], n, np.where, np.maximum)
    return x


def permutations(subjects: DataFrame, n: int) -> DataFrame:
    """(perm_id, subject_id, source): for each permutation from 1 to n, whose observation each subject takes.

    Subjects have places in the order of their ids, once; a permutation is a keyed bijection of the places, taken for arrays of them in tasks, so nothing is
    sorted for it.
    """
    placed = numbered(subjects.select("subject_id"), F.col("subject_id"), as_number="place").withColumn("place", F.col("place") - 1)
    size = placed.count()
    if not size:
        return placed.select(F.lit(0).alias("perm_id"), "subject_id", F.col("subject_id").alias("source")).limit(0)

    def move(it):
        for batch in it:
            key, x = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            for turn in range(1, rounds_of(size) + 1):
                x = _partner(x, turn, key, size, np.where, np.maximum)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.int64())], names=["perm_id", "subject_id", "place"])

    tasks = max(1, -(-size * n // TASK_PLACES))
    every = placed.repartition(tasks).select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm_id"), "subject_id", F.col("place").cast("long").alias("place"))
    moved = every.mapInArrow(move, f"perm_id int, subject_id {placed.schema['subject_id'].dataType.simpleString()}, place long")
    return moved.join(placed.select("place", F.col("subject_id").alias("source")), "place").select("perm_id", "subject_id", "source")


def _strengths(s: np.ndarray, gram: np.ndarray, n: int, spread: np.ndarray, components: int) -> np.ndarray:
    """Effects of each component: s (..., features) are X'y, ``spread`` (...) the outcome's population deviation."""
    left, rots, squares, out = s, [], [], []
    for _ in range(components):
        norm = np.sqrt((left**2).sum(-1, keepdims=True))
        # What rounding has left of a direction that is used up is none.
        w = np.where(norm > 1e-10 * np.sqrt((s**2).sum(-1, keepdims=True)), left / np.where(norm > 0, norm, 1.0), 0.0)
        v = w
        for r, tt in zip(rots, squares):
            v = v - r * (((r @ gram) * w).sum(-1) / np.where(tt > 0, tt, 1.0))[..., None]
        tt = ((v @ gram) * v).sum(-1)
        tu = (v * s).sum(-1)
        left = left - (tu / np.where(tt > 0, tt, 1.0))[..., None] * (v @ gram)
        rots.append(v)
        squares.append(tt)
        scale = np.sqrt(np.maximum(tt, 0) / n) * spread
        out.append(np.where(scale > 0, tu / (n - 1) / np.where(scale > 0, scale, 1.0), 0.0))
    return np.stack(out)


def _permuted(x: np.ndarray, y: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(components x variables): effects, and the share of n permutations with a strictly greater one.  x: subjects x features, y: subjects x variables."""
    m, r = x.shape
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    gram, spread = x.T @ x, y.std(axis=0)
    seen = _strengths(y.T @ x, gram, m, spread, components)
    greater = np.zeros(seen.shape)
    for first in range(1, n + 1, TOGETHER):
        keys = np.arange(first, min(first + TOGETHER, n + 1))
        s = np.zeros((y.shape[1], len(keys) * r))
        for a in range(0, m, HELD):
            s += y[a : a + HELD].T @ x[permuted_places(m, keys, True, a, a + HELD)].reshape(-1, len(keys) * r)
        s = s.reshape(-1, len(keys), r)
        greater += (_strengths(s, gram, m, spread[:, None], components) > seen[..., None] + 1e-12 * np.abs(seen[..., None])).sum(axis=-1)
    return seen, greater / n


def permutation_p(obs: DataFrame, subjects: DataFrame, features: Sequence[str], n: int, components: int = 1, groups: int | None = None) -> DataFrame:
    """(voxel_id, component, strength, p): each latent effect, and the share of n permutations of the observations over subjects with a strictly greater one.

    Variables are dealt into as many groups as their observations need.  A task multiplies its block of variables x subjects with blocks of subjects x
    permuted features; a variable is permuted among the subjects it has.  Of repeated observations one counts.
    """
    x = _features(subjects, features)
    size = x.count()
    if size * max(1, len(features)) > MOST_NUMBERS:
        raise ValueError(f"{size} subjects are more than the {MOST_NUMBERS} numbers that a task holds")
    table = x.orderBy("subject_id").toPandas()  # within the bound
    shared = obs.sparkSession.sparkContext.broadcast((table["subject_id"].to_numpy(), table.drop(columns="subject_id").to_numpy(float)))
    of = groups or max(1, -(-obs.count() // GROUP_ROWS))

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = shared.value
        rows = rows[rows["value"].notna()]
        at = np.minimum(np.searchsorted(ids, rows["subject_id"].to_numpy()), max(len(ids) - 1, 0))
        known = ids[at] == rows["subject_id"].to_numpy() if len(ids) else np.zeros(len(rows), bool)
        voxels, column = np.unique(rows["voxel_id"].to_numpy()[known], return_inverse=True)
        wide = np.full((len(ids), len(voxels)), np.nan)
        wide[at[known], column] = rows["value"].to_numpy(float)[known]
        patterns, which = np.unique(~np.isnan(wide), axis=1, return_inverse=True)
        out = []
        for k in range(patterns.shape[1]):
            own, columns = np.flatnonzero(patterns[:, k]), np.flatnonzero(which.ravel() == k)
            if len(own) < 2:
                seen, p = np.zeros((components, len(columns))), np.zeros((components, len(columns)))
            else:
                seen, p = _permuted(x[own], wide[np.ix_(own, columns)], n, components)
            for c in range(components):
                out.append(pd.DataFrame({"voxel_id": voxels[columns], "component": c, "strength": seen[c], "p": p[c]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("voxel_id", "component", "strength", "p")})

    dealt = obs.select("voxel_id", "subject_id", "value").withColumn("g", F.pmod(F.xxhash64("voxel_id"), F.lit(of)))
    return dealt.groupBy("g").applyInPandas(judge, "voxel_id long, component int, strength double, p double")


def evaluate_latent(obs: DataFrame, subjects: DataFrame, features: Sequence[str], n: int, threshold: float | None = None, components: int = 1) -> DataFrame:
    """(voxel_id, component, strength, p, one rotation for each feature): the latent effects of every variable.  Variables whose mean lies below ``threshold``
    have strength 0, p 1 and rotations 0."""
    fit = pls_fit(obs, subjects, features, components)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), *[F.col(f"rot_{c}_{f}").alias(f"rot_{f}") for f in features]) for c in range(components)]))
    types = fit.select("voxel_id", "mean", each.alias("e")).select("voxel_id", "mean", "e.*")
    out = permutation_p(obs, subjects, features, n, components).join(types, ["voxel_id", "component"])
    masked = F.lit(False) if threshold is None else F.col("mean") < threshold
    keep = lambda name, other: F.when(masked, F.lit(other)).otherwise(F.col(name)).alias(name)
    return out.select("voxel_id", "component", keep("strength", 0.0), keep("p", 1.0), *[keep(f"rot_{f}", 0.0) for f in features])


def cluster_effect_type(types: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(voxel_id, label): k-means of the rotation vectors; ``types``: (voxel_id, one column for each predictor)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[c for c in types.columns if c != "voxel_id"], outputCol="features").transform(types)
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("voxel_id", (F.col("prediction") + 1).cast("long").alias("label"))
