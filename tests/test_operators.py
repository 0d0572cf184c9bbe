"""Properties of designs, fits, scores, graphs and kernels, on small tables."""

import math
import random

import numpy as np
import pytest

from gramian.functions import columns as fc
from gramian.functions import distributions as ds
from gramian.operators import design as dz
from gramian.operators import fit as ft
from gramian.operators import gauss, graph, kernels, local, maps, pls, score, search, summary, svr, windows
from gramian.operators.design import CORRECTOR, PREDICTOR
from gramian.sources import metadata, volumes


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(0)
    n, v = 40, 6
    x = np.column_stack([rng.normal(50, 9, n), rng.integers(0, 2, n), rng.normal(0.3, 0.2, n)])
    y = x @ rng.normal(size=(3, v)) + rng.normal(size=(n, v))
    subj = spark.createDataFrame([(k, int(k % 3), *map(float, r)) for k, r in enumerate(x)], "subject_id long, category int, age double, sex double, biomarker double").cache()
    obs = spark.createDataFrame([(k, j, float(y[k, j])) for k in range(n) for j in range(v)], "subject_id long, voxel_id long, value double").cache()
    return subj, obs, x, y


DESIGN = dz.with_intercept(dz.terms(["age", "sex"], CORRECTOR), CORRECTOR) + dz.terms(["biomarker"])


def matrix(df, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("subject_id").collect()])


def by_voxel(df, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("voxel_id").collect()])


@pytest.mark.parametrize("kind", ["normalize", "orthogonalize", "orthonormalize"])
def test_treatments(spark, study, kind):
    subj, _, x, _ = study
    full = np.column_stack([np.ones(len(x)), x])
    t = dz.treatment(DESIGN.gram(subj), kind)
    z = matrix(dz.treat(subj, DESIGN, t), DESIGN.names)
    assert np.allclose(z, full @ t)
    gram = z.T @ z
    if kind != "normalize":
        assert np.allclose(gram - np.diag(np.diag(gram)), 0, atol=1e-8)
    if kind != "orthogonalize":
        assert np.allclose(np.diag(gram), 1)


def test_treatment_of_dependent_columns():
    x = np.random.default_rng(1).normal(size=(20, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1]])
    z = x @ dz.treatment(x.T @ x, "orthonormalize")
    assert np.allclose(z[:, 3], 0) and np.allclose(z[:, :3].T @ z[:, :3], np.eye(3))


def test_fit_is_least_squares(study):
    subj, obs, x, y = study
    full = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.lstsq(full, y, rcond=None)[0].T
    params = ft.glm_fit(obs, subj, DESIGN)
    assert np.allclose(by_voxel(params, DESIGN.names), want)
    rest = ft.joined(obs, subj, params, DESIGN).withColumn("e", fc.F.col("corrected") - fc.F.col("predicted"))
    e = {(r.subject_id, r.voxel_id): r.e for r in rest.collect()}
    error = np.array([[e[k, j] for j in range(y.shape[1])] for k in range(len(x))])
    assert np.allclose(full.T @ error, 0, atol=1e-6)


def test_two_stage_after_orthogonalising_is_joint(study):
    subj, obs, _, _ = study
    t = dz.treatment(DESIGN.gram(subj), "orthonormalize")
    treated = dz.treat(subj, DESIGN, t)
    plain = dz.Design(tuple(dz.Term(d.name, f"`{d.name}`", d.role) for d in DESIGN.terms))
    one, two = ft.glm_fit(obs, treated, plain), ft.two_stage_fit(obs, treated, plain)
    assert np.allclose(by_voxel(one, DESIGN.names), by_voxel(two, DESIGN.names))
    assert np.allclose(by_voxel(dz.denormalize(one, DESIGN.names, t), DESIGN.names), by_voxel(ft.glm_fit(obs, subj, DESIGN), DESIGN.names))


def test_fit_over_the_subjects_that_a_variable_has(spark, study):
    """Missing rows, null values, subjects with a null term, strangers and repeated rows; also weighted and rank-deficient."""
    subj, obs, x, y = study
    subj = subj.unionByName(spark.createDataFrame([(99, 1, None, 1.0, 0.5)], subj.schema))
    gone = "(voxel_id = 1 AND subject_id IN (3, 4)) OR (voxel_id = 2 AND subject_id = 5) OR (voxel_id = 4 AND subject_id IN (3, 4))"
    nulls = fc.F.when(fc.F.expr("NOT (voxel_id = 3 AND subject_id < 9)"), fc.F.col("value"))
    extra = spark.createDataFrame([(99, 0, 5.0), (1000, 1, 7.0), (8, 5, float(y[8, 5]))], obs.schema)
    some = obs.where(f"NOT ({gone})").withColumn("value", nulls).unionByName(extra)
    held = {v: list(range(40)) for v in range(6)}
    held[1] = held[4] = [k for k in range(40) if k not in (3, 4)]
    held[2], held[3], held[5] = [k for k in range(40) if k != 5], list(range(9, 40)), [*range(40), 8]
    full = np.column_stack([np.ones(40), x])
    for weight, w in ((None, np.ones(40)), ("1.0 + sex", 1 + x[:, 1])):
        got = by_voxel(ft.glm_fit(some, subj, DESIGN, weight), DESIGN.names)
        for v, at in held.items():
            root = np.sqrt(w[at])[:, None]
            assert np.allclose(got[v], np.linalg.lstsq(full[at] * root, y[at, v] * root[:, 0], rcond=None)[0], rtol=1e-6)
    double = DESIGN + dz.Design((dz.Term("again", "2 * age"),))
    got = by_voxel(ft.glm_fit(some, subj, double), double.names)
    for v, at in held.items():
        assert np.allclose(got[v], np.linalg.lstsq(np.column_stack([full, 2 * x[:, 0]])[at], y[at, v], rcond=None)[0], atol=1e-6)
    params = ft.glm_fit(some, subj, DESIGN)
    t = by_voxel(score.tstat(some, subj, params, DESIGN, "biomarker"), ["tstat"])[:, 0]
    points = spark.createDataFrame([(0, 50.0, 1.0, 0.3)], "point long, age double, sex double, biomarker double")
    ends = by_voxel(score.curve_interval(spark, some, subj, params, DESIGN, points), ["se", "low", "high"])
    for v, at in held.items():
        b, inverse = np.linalg.lstsq(full[at], y[at, v], rcond=None)[0], np.linalg.inv(full[at].T @ full[at])
        rss = ((y[at, v] - full[at] @ b) ** 2).sum()
        assert np.isclose(t[v], b[3] / np.sqrt(rss / (len(at) - 1) * inverse[3, 3]), rtol=1e-5)
        p = np.array([1, 50, 1, 0.3])
        se = np.sqrt(rss / (len(at) - 4) * (p @ inverse @ p))
        q = ds.t_quantile(0.975, len(at) - 4)
        assert np.allclose(ends[v], [se, p @ b - q * se, p @ b + q * se], rtol=1e-5)
    assert ft.glm_fit(obs.limit(0), subj, DESIGN).count() == 0


def test_powers_far_from_zero(spark):
    """A cubic of values from 1,000 to 1,020, for all variables, for groups, and in a search; errors are sums of squares, not differences."""
    rng = np.random.default_rng(8)
    x = np.linspace(1000, 1020, 60)
    u = (x - 1010) / 10
    y = np.column_stack([3 + u - 2 * u**2 + 5 * u**3 + rng.normal(size=60) * s for s in (0.1, 1e-5)])
    subj = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "subject_id long, x double")
    obs = spark.createDataFrame([(k, v, float(y[k, v])) for k in range(60) for v in range(2)], "subject_id long, voxel_id long, value double")
    want = np.column_stack([np.polyval(np.polyfit(u, y[:, v], 3), u) for v in range(2)])
    design = dz.with_intercept(dz.poly_terms("x", 3), PREDICTOR)
    groups = ft.glm_fit_grouped(obs.join(subj, "subject_id"), ["voxel_id"], "value", design)
    for params in (ft.glm_fit(obs, subj, design), groups):
        got = {(r.subject_id, r.voxel_id): r.predicted for r in ft.predict(obs, subj, params, design).collect()}
        assert np.allclose([[got[k, v] for v in range(2)] for k in range(60)], want, atol=2e-5)
    found = {(r.voxel_id, r.combination): r for r in search.polynomial_errors(obs, subj, "x", (1, 3)).collect()}
    for v in range(2):
        for degree in (1, 3):
            e = y[:, v] - np.polyval(np.polyfit(u, y[:, v], degree), u)
            assert np.isclose(found[v, degree].mse, np.mean(e**2), rtol=1e-3) and np.isclose(found[v, degree].sse, e.var() * 60, rtol=1e-3)


def test_search_scores(spark, study):
    """mse, Cp and anova against the formulas; a combination without a score is not the best, and variables without one count."""
    subj, obs, x, y = study
    few = lambda s: search.polynomial_errors(s, subj, "sex", (1, 2, 5))  # noqa: E731  two values determine degree 1 only
    for name in search.SCORES:
        errors = search.grid_search(obs, 1, 4, 0.0, few, score=name)
        got = {r.combination: r.error for r in errors.collect()}
        assert got[1] is not None and got[2] is None and got[5] is None
        assert search.best(errors).first().combination == 1
        drawn = [r.voxel_id for r in search.sample_voxels(obs, 4, 0.0, 1).collect()]
        e = np.column_stack([y[:, v] - np.polyval(np.polyfit(x[:, 1], y[:, v], 1), x[:, 1]) for v in drawn])
        var, sst, sse = y[:, drawn].var(0), y[:, drawn].var(0) * 40, e.var(0) * 40
        f = ((sst - sse) / 2) / (sse / 37)
        want = {"mse": (e**2).mean(0), "cp": (e**2).mean(0) + 2 / 40 * 2 * (sse / 39).sum(), "anova": 1 - ds.f_cdf(f, 2, 37)}[name]
        assert np.isclose(got[1], (want / var).sum(), rtol=1e-4)
    nan = spark.createDataFrame([(1, 0, float("nan")), (1, 1, None), (1, 2, 4.0)], "iteration int, combination long, error double")
    assert tuple(search.best(nan).first()) == (2, 1, 4.0)


def test_degrees_of_freedom_of_fits(spark, study):
    subj, obs, x, _ = study
    rows = obs.join(subj, "subject_id")
    k = np.exp(-np.subtract.outer(x[:, 0], x[:, 0]) ** 2 / 18)
    s = k / k.sum(1, keepdims=True)
    got = score.fitted_df("kernel", rows, x="age", sigma=3.0).collect()
    assert len(got) == 6 and all(np.isclose(r.df, np.trace(s @ s.T)) for r in got)
    assert {r.df for r in score.fitted_df("polynomial", rows, degree=3).collect()} == {4.0}
    made = spark.createDataFrame([(1, 0.05, 0.0, 1.0), (1, 0.3, 0.1, 1.0), (1, -2.0, -1.0, 1.0)], "voxel_id long, residual double, alpha double, k double")
    assert [r.df for r in score.fitted_df("gaussian_svr", made, c=1.0, epsilon=0.1).collect()] == [1.0]


def test_grouped_fit_is_shared_fit_of_each_group(study):
    subj, obs, _, _ = study
    design = dz.with_intercept(dz.terms(["age"]), CORRECTOR)
    got = {(r.category, r.voxel_id): (r.intercept, r.age) for r in ft.fit_by_category(obs, subj, design).collect()}
    for c in range(3):
        for r in ft.glm_fit(obs, subj.where(f"category = {c}"), design).collect():
            assert np.allclose(got[c, r.voxel_id], (r.intercept, r.age))


def test_spline_bases(spark, study):
    subj, _, _, _ = study
    b = dz.bspline_basis(subj, "age", 6)
    x = matrix(subj.select("subject_id", *[t.column.alias(t.name) for t in b.terms]), b.names)
    assert x.shape[1] == 6 and (x >= -1e-12).all() and (x.sum(1) <= 1 + 1e-9).all()
    assert np.isclose(x.sum(1).max(), 1)  # the first function is left out and vanishes away from the low end
    n = dz.natural_cubic_basis(subj, "age", 4)
    assert len(n) == 4
    beyond = spark.createDataFrame([(k, 200.0 + k) for k in range(5)], "subject_id long, age double")
    z = matrix(beyond.select("subject_id", *[t.column.alias(t.name) for t in n.terms]), n.names)
    assert np.allclose(np.diff(z, 2, axis=0), 0, atol=1e-4)  # straight beyond the ends


def test_backfitting_limit(study):
    subj, obs, x, y = study
    smoothers = {"age": dz.poly_terms("age", 2), "biomarker": dz.poly_terms("biomarker", 2)}
    got = by_voxel(ft.gam_fit(obs, subj, smoothers), ["intercept", "age", "age^2", "biomarker", "biomarker^2"])
    parts = [np.column_stack([x[:, 0], x[:, 0] ** 2]), np.column_stack([x[:, 2], x[:, 2] ** 2])]
    parts = [p - p.mean(0) for p in parts]
    f = [np.zeros(len(x)), np.zeros(len(x))]
    for _ in range(300):
        for k in (0, 1):
            r = y[:, 0] - y[:, 0].mean() - f[1 - k]
            f[k] = parts[k] @ np.linalg.lstsq(parts[k], r, rcond=None)[0]
    assert np.allclose(parts[0] @ got[0, 1:3] + parts[1] @ got[0, 3:], f[0] + f[1], atol=1e-5) and np.isclose(got[0, 0], y[:, 0].mean())


def test_pls_of_all_components_is_least_squares(study):
    subj, obs, x, y = study
    features = ["age", "sex", "biomarker"]
    coef = by_voxel(pls.pls_fit(obs, subj, features, 3), [f"coef_{f}" for f in features])
    want = np.linalg.lstsq(x - x.mean(0), y - y.mean(0), rcond=None)[0].T
    assert np.allclose(coef, want, atol=1e-6)
    flat = obs.withColumn("value", fc.F.lit(2.5))
    assert np.allclose(by_voxel(pls.pls_fit(flat, subj, features, 2), ["mean", "coef_age", "rot_1_sex"]), [2.5, 0, 0])


def optimal(kernel, y, a, b, c, epsilon, slack):
    """The optimality conditions of a fit with a free intercept."""
    r = y - kernel @ a - b
    assert (np.abs(a) <= c * (1 + 1e-9)).all() and abs(a.sum()) < slack * c
    assert np.allclose(a[np.abs(r) < epsilon - slack], 0, atol=slack * c)
    free = (np.abs(a) > slack * c) & (np.abs(a) < c * (1 - slack))
    assert np.allclose(np.abs(r[free]), epsilon, atol=slack)
    assert (r[a >= c * (1 - 1e-6)] > epsilon - slack).all() and (r[a <= -c * (1 - 1e-6)] < -epsilon + slack).all()


def test_support_vectors(study):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2))
    y = x @ [1.0, -2.0] + 70.5 + rng.normal(size=30) * 0.05  # the intercept is far from zero and costs nothing
    for gamma in (None, 0.5):
        for c in (0.3, 5.0):
            factor = x if gamma is None else kernels.with_pivots(x, gamma).rows(x)
            a, b = svr.solve_dual(factor, y, c, 0.1, tolerance=1e-8)
            optimal(factor @ factor.T, y, a, b, c, 0.1, 2e-3)
    shifted = svr.solve_dual(x, y - 1000, 5.0, 0.1, tolerance=1e-8)
    plain = svr.solve_dual(x, y, 5.0, 0.1, tolerance=1e-8)
    assert np.isclose(plain[1] - shifted[1], 1000) and np.allclose(x.T @ plain[0], x.T @ shifted[0], atol=1e-3)
    flat = svr.solve_dual(x, np.full(30, 2.0), 5.0, 0.1)
    assert np.allclose(flat[0], 0) and np.isclose(flat[1], 2.0)


@pytest.mark.parametrize("gamma", [None, 0.7])
def test_support_vectors_of_all_variables(spark, study, gamma):
    """Fits in groups are those of each variable alone, with missing observations too; errors over a grid follow from them."""
    subj, obs, x, y = study
    obs = obs.where("subject_id <> 3 or voxel_id <> 2")
    z = (x[:, [0, 2]] - x[:, [0, 2]].mean(0)) / x[:, [0, 2]].std(0)
    factor = z if gamma is None else kernels.with_pivots(z, gamma).rows(z)
    fit = svr.svr_fit(obs, subj, ["age", "biomarker"], 2.0, 0.1, gamma, groups=2).collect()
    got, intercepts = {(r.voxel_id, r.subject_id): r.alpha for r in fit}, {r.voxel_id: r.intercept for r in fit}
    grid = spark.createDataFrame([(0, 2.0, 0.1, gamma), (1, 0.5, 0.3, gamma)], "combination long, c double, epsilon double, gamma double")
    errors = {(r.voxel_id, r.combination): r for r in svr.grid_errors(obs, subj, ["age", "biomarker"], grid if gamma else grid.drop("gamma"), groups=3).collect()}
    rest = {(r.voxel_id, r.subject_id): r.value for r in svr.svr_correct(obs, subj, ["age", "biomarker"], 2.0, 0.1, gamma).collect()}
    for v in range(6):
        at = [k for k in range(40) if (k, v) != (3, 2)]
        own = factor[at]
        a, b = svr.solve_dual(own, y[at, v], 2.0, 0.1, tolerance=1e-7)
        alone, mine = own @ (own.T @ a) + b, own @ (own.T @ np.array([got[v, k] for k in at])) + intercepts[v]
        assert np.allclose(mine, alone, atol=3e-2)
        assert np.allclose([rest[v, k] for k in at], y[at, v] - alone, atol=3e-2)
        e = errors[v, 0]
        assert np.isclose(e.mse, np.mean((y[at, v] - alone) ** 2), rtol=2e-2) and e.n == len(at)
        assert np.isclose(e.sst, ((y[at, v] - y[at, v].mean()) ** 2).sum()) and 0 <= e.df <= len(at)
    assert len(errors) == 12


def test_support_vectors_that_do_not_settle():
    with pytest.raises(ArithmeticError):
        svr.solve_dual(np.array([[1.0, 0.0], [0.999, 0.05]]), np.array([5.0, -5.0]), 1e6, 0.0, rounds=2)


def test_pivots_give_the_kernel(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(400, 2)), np.zeros((30, 2))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(5)
    factor = kernels.pivoted(df, ["a", "b"], 0.5, error=1e-7)
    rows = factor.rows(x)
    assert factor.rank < 150 and factor.error <= 1e-7
    assert np.abs(rows @ rows.T - kernels.gaussian(x, x, 0.5)).max() < 1e-3 and np.mean(1 - (rows**2).sum(1)) < 1e-6
    with pytest.raises(ArithmeticError):
        kernels.pivoted(df, ["a", "b"], 200.0, error=1e-7, most=20)
    assert kernels.pivoted(df.limit(0), ["a", "b"], 0.5).rank == 0


def test_pivots_take_few_rounds(spark):
    """Such a kernel took 38 jobs; rows that have nothing in common are all pivots."""
    rng = np.random.default_rng(7)
    x = rng.uniform(-2, 2, (3000, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(5)
    spark.sparkContext.setJobGroup("pivots", "")
    factor = kernels.pivoted(df, ["a", "b"], 0.5, 1e-12, worst=True)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = factor.rows(x)
    assert np.abs(rows @ rows.T - kernels.gaussian(x, x, 0.5)).max() < 1e-11 and factor.rank < 300
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pivots")) < 10
    far = spark.range(700).selectExpr("id * 10D AS a", "0D AS b").repartition(2)
    assert kernels.pivoted(far, ["a", "b"], 1.0, 1e-12, worst=True).rank == 700


def test_pivots_of_repeated_features(spark):
    """Copies of a row are one row with a number: 60 distinct rows took some twenty jobs, as tasks reported copies."""
    df = spark.range(12_000).selectExpr("20D + (id * 7919) % 60 AS a", "CAST(id % 2 AS DOUBLE) AS b").unionAll(spark.range(3000).selectExpr("200D AS a", "0D AS b"))
    scaled = df.selectExpr("(a - 50) / 17 AS a", "b").repartition(5)
    spark.sparkContext.setJobGroup("copies", "")
    factor = kernels.pivoted(scaled, ["a", "b"], 0.5)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    x = scaled.toPandas().to_numpy(float)
    left = 1 - (factor.rows(x) ** 2).sum(1)
    assert len(x) == 15_000 and factor.rank < 40 and np.isclose(factor.error, left.mean(), atol=1e-10) and factor.error <= 1e-8
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("copies")) <= 5


def test_support_vectors_of_repeated_features(spark, monkeypatch):
    """A factor has one row for the subjects of equal features, with the products of a row for each; held or made again."""
    rng = np.random.default_rng(11)
    distinct = rng.normal(size=(30, 2))
    x = distinct[rng.integers(0, 30, 2000)]
    y = np.column_stack([np.sin(x[:, 0]), x[:, 1] ** 2]) + rng.normal(size=(2000, 2)) * 0.2
    factor = kernels.with_pivots(distinct[:20], 0.3)
    some, which = svr._distinct(x)
    assert len(some) == 30 and (some[which] == x).all()
    each = svr.Rows(factor, x)
    w, a, mask = rng.normal(size=(20, 3)), rng.normal(size=(2000, 3)), rng.random((2000, 3)) < [0.5, 0.01, 0.0]
    for held in (svr.HELD, 0):
        monkeypatch.setattr(svr, "HELD", held)
        monkeypatch.setattr(svr, "CHUNK", 7)
        own = svr.Rows(factor, some, which)
        for f, v in ((svr.Rows.times, w), (svr.Rows.back, a), (svr.Rows.grams, mask)):
            assert np.allclose(f(own, v), f(each, v), atol=1e-8)
        assert np.allclose(own.diagonal(), each.diagonal()) and max(len(part) for _, part in own.parts()) <= 7
    (few, b), (all_rows, b_all) = svr.solve_dual(own, y, 1.0, 0.1), svr.solve_dual(each, y, 1.0, 0.1)
    assert np.allclose(few, all_rows, atol=1e-3) and np.allclose(b, b_all, atol=1e-4)
    subj = spark.createDataFrame([(k, float(r[0]), float(r[1])) for k, r in enumerate(x)], "subject_id long, a double, b double")
    shared = svr.Shared(subj, ["a", "b"], [None])
    assert len(shared.x) == 30 and np.allclose(shared.x[shared.which], (x - x.mean(0)) / x.std(0))
    assert len(svr._rows(shared.factors[None], shared, np.arange(1, 2000, 2)).x) <= 30


def test_support_vectors_of_many_subjects(spark):
    """20,000 subjects, for which a matrix of all pairs would be 3 GB."""
    n = 20_000
    subj = spark.range(n).selectExpr("id AS subject_id", "(id * 7919 % 20011) / 20011.0D AS dose")
    obs = subj.selectExpr("subject_id", "1L AS voxel_id", "40 + sin(6 * dose) + (subject_id * 104729 % 1009) / 20180.0D AS value")
    fit = svr.svr_fit(obs, subj, ["dose"], 1.0, 0.05, 0.5).toPandas().sort_values("subject_id")
    x = np.array([k * 7919 % 20011 / 20011 for k in range(n)])[:, None]
    x = (x - x.mean()) / x.std()
    factor = kernels.with_pivots(x[:: n // 60], 0.5)
    rows, a, b = factor.rows(x), fit.alpha.to_numpy(), fit.intercept.iloc[0]
    y = obs.orderBy("subject_id").toPandas().value.to_numpy()
    r = y - rows @ (rows.T @ a) - b
    assert len(fit) == n and abs(a.sum()) < 2 and np.abs(r).max() < 0.12
    assert (np.abs(a[np.abs(r) < 0.04]) < 1e-2).mean() > 0.99


def test_too_many_subjects(study, monkeypatch):
    monkeypatch.setattr(svr, "MOST_NUMBERS", 10)
    with pytest.raises(ValueError):
        svr.svr_fit(study[1], study[0], ["age"], 1.0, 0.1)


def test_two_stage_support_vectors(study):
    subj, obs, _, _ = study
    rest, alphas = svr.svr_two_stage(obs, subj, ["age", "sex"], ["biomarker"], 1.0, 0.1)
    direct = {(r.voxel_id, r.subject_id): r.alpha for r in svr.svr_fit(rest, subj, ["biomarker"], 1.0, 0.1).collect()}
    assert all(np.isclose(direct[r.voxel_id, r.subject_id], r.alpha, atol=1e-6) for r in alphas.collect())
    assert svr.svr_two_stage(obs, subj, [], ["biomarker"], 1.0, 0.1)[0] is obs


def test_grid_search_of_polynomials(study):
    subj, obs, x, y = study
    errors = {(r.iteration, r.combination): r.error for r in search.grid_search(obs, 2, 4, 0.0, lambda s: search.polynomial_errors(s, subj, "age", (1, 3))).collect()}
    for i in (1, 2):
        drawn = [r.voxel_id for r in search.sample_voxels(obs, 4, 0.0, i).collect()]
        for degree in (1, 3):
            fits = [np.polyval(np.polyfit(x[:, 0], y[:, v], degree), x[:, 0]) for v in drawn]
            assert np.isclose(errors[i, degree], sum(np.mean((y[:, v] - f) ** 2) / y[:, v].var() for v, f in zip(drawn, fits)), rtol=1e-4)


def test_keyed_bijections(spark):
    """Every size gives permutations, different ones for different keys, the same in columns and arrays; the inverse goes back."""
    for n in (1, 2, 3, 7, 40, 501):
        keys = np.arange(1, 60)
        p = pls.permuted_places(n, keys)
        assert (np.sort(p, axis=0) == np.arange(n)[:, None]).all()
        back = pls.permuted_places(n, keys, inverse=True)
        assert all((back[p[:, k], k] == np.arange(n)).all() for k in range(len(keys)))
        assert n < 40 or len({tuple(c) for c in p.T}) == len(keys)
    spread = pls.permuted_places(50, np.arange(1, 4001))[7]
    assert (np.abs(np.bincount(spread, minlength=50) - 80) < 60).all()
    ids = [10, 3, 77, 5, 21, 4, 900]
    got = {(r.perm_id, r.subject_id): r.source for r in pls.permutations(spark.createDataFrame([(k,) for k in ids], "subject_id long"), 4).collect()}
    p, order = pls.permuted_places(7, np.arange(1, 5)), sorted(ids)
    assert got == {(k, order[i]): order[p[i, k - 1]] for i in range(7) for k in range(1, 5)}
    assert pls.permutations(spark.createDataFrame([], "subject_id long"), 2).count() == 0


def test_latent_effects_against_numpy(spark, study):
    """All components, with observations missing; each permutation is fitted anew."""
    subj, obs, x, y = study
    some = obs.where("voxel_id <> 2 or subject_id <> 5").withColumn("value", fc.F.when(fc.F.expr("voxel_id <> 3 or subject_id > 8"), fc.F.col("value")))
    features, n = ["age", "biomarker"], 15
    got = {(r.voxel_id, r.component): r for r in pls.evaluate_latent(some, subj, features, n, -1e9, components=2).collect()}
    fits = {r.voxel_id: r for r in pls.pls_fit(some, subj, features, 2).collect()}
    u = {(r.voxel_id, r.subject_id): r for r in pls.pls_transform(some, subj, features, pls.pls_fit(some, subj, features, 2), 2).collect()}

    def effects(z, values):
        """By deflating the features themselves."""
        left, out, scores = z.copy(), [], []
        for _ in range(2):
            w = left.T @ values
            w /= np.linalg.norm(w)
            t = left @ w
            left = left - np.outer(t, left.T @ t / (t @ t))
            out.append((t @ (values - values.mean())) / (len(values) - 1) / (t.std() * values.std()))
            scores.append(t)
        return out, scores

    for v in range(6):
        at = [k for k in range(40) if not (v == 2 and k == 5 or v == 3 and k <= 8)]
        z, values = x[at][:, [0, 2]], y[at, v]
        z = z - z.mean(0)
        seen, scores = effects(z, values)
        places = pls.permuted_places(len(at), np.arange(1, n + 1))
        drawn = [effects(z, values[places[:, k]])[0] for k in range(n)]
        for c in range(2):
            r = got[v, c]
            assert np.isclose(r.strength, seen[c]) and np.isclose(r.p, np.mean([d[c] > seen[c] for d in drawn]))
            assert np.allclose([u[v, k][f"t_{c}"] for k in at], scores[c], atol=1e-6)
        w = z.T @ values
        assert np.allclose([got[v, 0].rot_age, got[v, 0].rot_biomarker], w / np.linalg.norm(w))
        line = np.linalg.lstsq(z, values - values.mean(), rcond=None)[0]
        assert np.allclose([fits[v].coef_age, fits[v].coef_biomarker], line) and np.isclose(fits[v].mean, values.mean())
    assert {(r.strength, r.p, r.rot_age) for r in pls.evaluate_latent(obs, subj, features, 3, 1e9).collect()} == {(0.0, 1.0, 0.0)}


def test_box_stats_and_slices_by_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.randrange(40)), k) for k in range(301)] + [("c", 7.0, 400), ("a", None, 401), (None, 3.0, 402), (None, 9.0, 403), ("d", None, 404)]
    df = spark.createDataFrame(rows, "flag string, price double, k long")
    for r in summary.box_stats(df, "price", ["flag"]).collect():
        v = np.array([x[1] for x in rows if x[0] == r.flag and x[1] is not None])
        q = np.percentile(v, [25, 50, 75])
        inside = v[(v >= q[0] - 1.5 * (q[2] - q[0])) & (v <= q[2] + 1.5 * (q[2] - q[0]))]
        assert np.allclose([r.q1, r.median, r.q3, r.low, r.high, r.outliers], [*q, inside.min(), inside.max(), len(v) - len(inside)])
    assert {r.flag for r in summary.box_stats(df, "price", ["flag"]).collect()} == {"a", "b", "c", None}
    assert [r.k for r in metadata.row_slice(df, "k", 290, 303).orderBy("k").collect()] == sorted(x[2] for x in rows)[290:303]
    assert metadata.row_slice(df.limit(0), "k", 0, 5).count() == 0


def test_kernel_degrees_of_freedom(spark):
    x = [0.0, 0.0, 1.0, 2.5, 90.0, 91.0]
    k = np.exp(-np.subtract.outer(x, x) ** 2 / 2)
    s = k / k.sum(1, keepdims=True)
    got = local.kernel_df(spark.createDataFrame([(v,) for v in x], "x double"), "x", 1.0).first().df
    assert np.isclose(got, np.trace(s @ s.T))


def test_kernel_sums(spark):
    """Against the sums themselves, over points far apart and close together, with and without a join of cells; a million values in seconds."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 3, 400), rng.normal(1e4, 0.01, 300), [5e5]])
    w = rng.normal(size=len(x))
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)] + [(None, 1.0), (3.0, None)], "x double, w double")
    g = np.concatenate([np.linspace(-12, 30, 60), [1e4, 1e4 + 0.4, 2e4]])
    at = spark.createDataFrame([(float(v),) for v in g], "g double")
    for sigma in (0.7, 5.0):
        want = (w * np.exp(-((g[:, None] - x) ** 2) / (2 * sigma**2))).sum(1)
        for few in (20_000, 0):
            gauss.FEW_CELLS = few
            got = {r.g: r.sum_w for r in gauss.kernel_sums(points, "x", ["w"], at, "g", sigma).collect()}
            assert np.abs(np.array([got[v] for v in g]) - want).max() < 1e-9 * np.abs(w).sum()
        gauss.FEW_CELLS = 20_000
    many = spark.range(1_000_000).selectExpr("id / 1e4 AS x")  # 10,000 values in a deviation
    erf = np.vectorize(math.erf)
    middle = (np.arange(100_000) + 0.5) / 1000
    once = np.sqrt(np.pi / 2) * (erf(middle / np.sqrt(2)) + erf((100 - middle) / np.sqrt(2)))
    both = np.sqrt(np.pi) / 2 * (erf(middle) + erf(100 - middle))
    assert np.isclose(local.kernel_df(many, "x", 1.0).first().df, (both / once**2).mean() * 100, rtol=1e-3)


def test_regions_of_stored_volumes(spark, tmp_path):
    """Boxes come out whole, and the scan of a small one reads few of the files' rows."""
    n = 16
    cubes = spark.range(3).select("id", fc.F.transform(fc.F.sequence(fc.F.lit(0), fc.F.lit(n**3 - 1)), lambda k: (k % 97) + fc.F.col("id") * 0.5).alias("a"))
    obs = volumes.explode_volume(cubes, "id", "a", (n, n, n))
    volumes.store_volumes(obs, str(tmp_path / "v"), side=4, files=16)
    for box in (((2, 5), (0, 16), (7, 8)), ((0, 4), (4, 8), (8, 12)), ((-3, 1), (3, 4), (15, 99)), ((5, 5), (0, 3), (0, 3))):
        want = sorted(map(tuple, volumes.region(obs, *box).collect()))
        assert sorted(map(tuple, volumes.read_region(spark, str(tmp_path / "v"), *box).select(*obs.columns).collect())) == want
        assert sorted(map(tuple, volumes.explode_region(cubes, "id", "a", (n, n, n), *box).collect())) == want
    plan = volumes.read_region(spark, str(tmp_path / "v"), (0, 4), (4, 8), (8, 12))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(block," in plan
    covered = volumes._curve_ranges([(0, 0), (1, 1), (2, 2)])
    assert covered == [(0b100010 , 0b100010)]
    for ends in ([(3, 9), (0, 30), (5, 6)], [(0, 1), (0, 1), (0, 1)]):
        ranges = volumes._curve_ranges(ends)
        code = lambda p: sum((c >> b & 1) << (3 * b + k) for b in range(20) for k, c in enumerate(p))
        assert len(ranges) <= 40 and all(any(a <= code((i, j, k)) <= b for a, b in ranges) for i in range(ends[0][0], ends[0][1] + 1) for j in range(ends[1][0], ends[1][1] + 1) for k in range(ends[2][0], ends[2][1] + 1))


def test_span_of_a_percentage(spark):
    df = spark.createDataFrame([(float(k), float(k * k % 7)) for k in range(41)], "x double, y double")
    grid = spark.createDataFrame([(float(g),) for g in (5, 20)], "g double")
    a, b = (sorted(map(tuple, local.lowess(df, "x", "y", span, grid, percent=p).collect())) for span, p in ((25, True), (10.0, False)))
    assert np.allclose(a, b)


def test_distributions():
    assert np.isclose(ds.f_cdf(4.9646, 1, 10), 0.95, atol=1e-4) and np.isclose(ds.f_cdf(2.7109, 5, 20), 0.95, atol=1e-4)
    assert np.isclose(ds.t_quantile(0.975, 10), 2.2281, atol=1e-4) and np.isclose(ds.t_cdf(-1.8125, 10), 0.05, atol=1e-4)
    assert np.isclose(ds.normal_quantile(0.975), 1.959964, atol=1e-5) and ds.f_cdf(0, 2, 3) == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(7, 7), (None, 3)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, k) for k in range(5001, 5200)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {a: root(a) for a in parent}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (8, 1)]
    got = dict(map(tuple, graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}


def brute_strong(edges):
    """By reach of every node from every other."""
    nodes = sorted({x for e in edges for x in e})
    out = {a: [b for x, b in edges if x == a] for a in nodes}

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    r = {a: reach(a) for a in nodes}
    return {a: min(b for b in r[a] if a in r[b]) for a in nodes}


@pytest.mark.parametrize("seed, n, m, small", [(0, 30, 30, 0), (1, 40, 55, 1000), (3, 60, 66, 20), (4, 12, 60, 1000)])
def test_strong_components_of_random_graphs(spark, seed, n, m, small):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [(100 + k, 101 + k) for k in range(9)] + [(109, 103), (200, 201), (201, 202), (202, 200), (203, 201), (199, 203), (rng.randrange(n), 100), (105, rng.randrange(n))]
    got = dict(map(tuple, graph.strong_components(spark.createDataFrame(edges, "src long, dst long"), small=small).collect()))
    assert got == brute_strong(edges)


def test_strong_components_of_long_paths(spark):
    """A path of 10,000 nodes, one there and back, and a circle with a tail: few jobs, and few doublings where edges aren't left to one task."""
    tracker = spark.sparkContext.statusTracker()
    n = 10_000
    path = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    spark.sparkContext.setJobGroup("path", "path")
    assert graph.strong_components(path).where("node <> component").count() == 0
    jobs = len(tracker.getJobIdsForGroup("path"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 60, jobs
    levels, ways = graph._doubled(path.selectExpr("src AS v", "dst AS to"))
    assert len(levels) <= 15 and ways.where("not done or to <> 9999").count() == 0
    both = path.unionAll(path.select("dst", "src"))
    assert graph.strong_components(both, small=0).where("component <> 0").count() == 0
    circle = spark.range(400).selectExpr("id + 5 AS src", "(id + 1) % 400 + 5 AS dst").unionAll(spark.range(3000, 3100).selectExpr("id AS src", "IF(id = 3099, 77L, id + 1) AS dst"))
    for small in (0, graph.SMALL):
        found = graph.strong_components(circle, small=small)
        assert found.where("component = 5").count() == 400 and found.where("node = component").count() == 101


def test_clusters_over_blocks(spark, monkeypatch):
    """Random voxels, also at negative places and with a place taken twice, in blocks of 4 and of 32, against edges between all neighbours."""
    rng = random.Random(9)
    spots = sorted({(rng.randrange(-6, 7), rng.randrange(-6, 7), rng.randrange(-6, 7)) for _ in range(260)})
    rows = [(k * 7 % 1009, *s) for k, s in enumerate(spots)] + [(2000, *spots[3]), (2001, 90, 90, 90), (2002, 90, 90, 90)]
    df = spark.createDataFrame(rows, "voxel_id long, x int, y int, z int")
    want = dict(map(tuple, graph.components(maps.neighbours(df)).collect()))
    want = {r[0]: want.get(r[0], r[0]) for r in rows}
    for side in (4, 32):
        monkeypatch.setattr(maps, "SIDE", side)
        assert dict(map(tuple, maps.cluster_components(df).collect())) == want
    monkeypatch.setattr(maps, "FEW_EDGES", 0)
    assert dict(map(tuple, maps.cluster_components(df).collect())) == want


def test_clusters(spark):
    rows = [(k, k // 25, k // 5 % 5, k % 5, 1.0 if k in (0, 1, 31, 124) else 0.0) for k in range(125)]
    df = spark.createDataFrame(rows, "voxel_id long, x int, y int, z int, value double")
    got = {r.voxel_id: r.label for r in maps.clusterize(df, lower=0.5, min_size=2).collect() if r.label}
    assert got == {0: 1, 1: 1, 31: 1}
    assert {r.label for r in maps.clusterize(df).collect()} == {1}
    assert maps.clusterize(df, lower=5.0).where("label > 0").count() == 0


def test_ranks_over_ranges(spark):
    rng = random.Random(5)
    values = [float(rng.randrange(40)) for _ in range(500)]
    got = [r.v for r in windows.sorted_values(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).orderBy("rank").collect()]
    assert got == sorted(values)


def test_ranks_of_a_column_of_zeros(spark):
    """19,000 of 20,000 rows have one value; no task gets them."""
    df = spark.range(20_000).selectExpr("CASE WHEN id % 20 = 0 THEN CAST(id AS DOUBLE) ELSE 0D END AS v", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g")
    counts = windows.value_counts(df, "v", ["g"])
    assert counts.count() < 1100 and {(r.g, r.size) for r in counts.select("g", "size").distinct().collect()} == {(None, 6667), (1, 6667), (2, 6666)}
    ranks = windows.sorted_values(df, ["v"])
    assert max(r[0] for r in ranks.groupBy(fc.F.spark_partition_id()).count().select("count").collect()) < 12_000
    values = sorted(float(k) if k % 20 == 0 else 0.0 for k in range(20_000))
    assert [r.v for r in ranks.orderBy("rank").collect()] == values
    assert windows.order_statistic(df, 0.96, "v").first().threshold == values[19_199]
    q = counts.groupBy("g").agg(windows.quantile("v", 0.97).alias("q")).collect()
    for r in q:
        own = [float(k) if k % 20 == 0 else 0.0 for k in range(20_000) if (k % 3 or None) == r.g]
        assert np.isclose(r.q, np.percentile(own, 97))


@pytest.mark.parametrize("degree", [1, 2])
def test_local_regression_against_numpy(spark, degree):
    """Weighted fits at each point, over dense and thin stretches, equal values, and points that have too few neighbours."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.uniform(0, 30, 300).round(1), rng.uniform(50.2, 50.4, 400), [90.0, 90.5, 200.0]])
    y = np.sin(x / 5) + rng.normal(size=len(x)) * 0.1
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)], "x double, y double").repartition(6)
    g = [0.0, 3.3, 14.0, 28.0, 35.0, 50.3, 51.0, 90.0, 120.0, 200.0]
    for span in (4.0, 0.3):
        got = {r.g: r.value for r in local.lowess(df, "x", "y", span, spark.createDataFrame([(v,) for v in g], "g double"), degree).collect()}
        assert set(got) == set(g)
        for v in g:
            w = np.clip(1 - (np.abs(x - v) / span) ** 3, 0, None) ** 3
            if len(set(x[w > 0])) <= degree:
                assert got[v] is None
                continue
            basis = np.vander((x - v) / span, degree + 1, increasing=True) * np.sqrt(w)[:, None]
            want = np.linalg.lstsq(basis, y * np.sqrt(w), rcond=None)[0][0]
            assert got[v] is None or np.isclose(got[v], want, atol=1e-5), (v, span)
            assert got[v] is not None or np.linalg.cond(basis) > 1e3
    assert local.lowess(df.limit(0), "x", "y", 1.0, spark.createDataFrame([(1.0,)], "g double")).first().value is None


def test_local_regression_of_a_line(spark):
    df = spark.createDataFrame([(float(k), 3.0 * k + 1) for k in range(50)], "x double, y double")
    grid = spark.createDataFrame([(g,) for g in (5.0, 20.5, 40.0)], "g double")
    for degree in (1, 2):
        for r in local.lowess(df, "x", "y", 6, grid, degree).collect():
            assert np.isclose(r.value, 3 * r.g + 1)


def test_metadata_edges(spark, tmp_path):
    (tmp_path / "s.csv").write_text(" ID ,Age,Junk\n1,40,x\n ,,\n2,n/a,y\n")
    df = metadata.read_metadata(spark, str(tmp_path / "s.csv"))
    assert df.columns == ["id", "age", "junk"]
    rows = [tuple(r) for r in metadata.typed_rows(df, {"id": "long", "age": "double", "none": "int"}).collect()]
    assert rows == [(1, 40.0, None), (2, None, None)]
    assert metadata.typed_rows(df, {"none": "int"}).count() == 0


def test_fill_and_affine(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (None,)], "v double")
    assert [r.v for r in df.select(fc.fill_non_finite(fc.F.col("v"), 7.0).alias("v")).collect()] == [1.0, 7.0, 7.0, 7.0]
    p = spark.createDataFrame([(0.5, 1.5, 2.5)], "x double, y double, z double")
    assert tuple(p.select(*fc.mm_to_voxel(tuple(fc.F.col(c) for c in "xyz"), np.eye(4))).first()) == (0, 2, 2)


def test_metric_registry(study):
    subj, obs, _, _ = study
    params = ft.glm_fit(obs, subj, DESIGN)
    score.register_metric("twice", lambda q: 2 * score.METRICS["mse"](q))
    for r in score.evaluate(obs, subj, params, DESIGN, ["mse", "twice", "r2"]).collect():
        assert np.isclose(r.twice, 2 * r.mse) and r.r2 <= 1


def test_components_of_a_long_path_take_many_rounds(spark, monkeypatch):
    """A path in mixed order needs more rounds than go without a table."""
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, own=graph.written: tables.append(1) or own(df))
    names = np.random.default_rng(3).permutation(600).tolist()
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(599) if i != 300], "src long, dst long")
    want = {(v, min(part)) for part in (names[:301], names[301:]) for v in part}
    assert {tuple(r) for r in graph.components(edges).collect()} == want and tables


def test_gaussian_predictions_make_no_pairs(spark, monkeypatch):
    """Predictions at all subjects follow from a factor; where it has too many columns, from pairs."""
    n = 3000
    scaled = spark.range(n).selectExpr("id AS subject_id", "(id * 7919 % 3001) / 1000.0D AS a", "IF(id = 7, NULL, IF(id = 8, 9.0D, (id * 104729 % 997) / 500.0D)) AS b")
    alphas = scaled.selectExpr("subject_id", "explode(sequence(0L, 2L)) AS voxel_id").selectExpr("voxel_id", "subject_id", "(subject_id * 31 + voxel_id) % 21 / 10.0D - 1 AS alpha", "voxel_id / 4.0D AS intercept")
    points = scaled.withColumnRenamed("subject_id", "point")
    monkeypatch.setattr(svr, "BLOCK_ROWS", 700)
    few = {(r.voxel_id, r.point): r.predicted for r in svr.gaussian_predict(alphas, scaled, points.where("point < 40"), ["a", "b"], 0.5, most=20).collect()}
    monkeypatch.setattr(svr, "gaussian_pairs", None)
    got = {(r.voxel_id, r.point): r.predicted for r in svr.gaussian_predict(alphas, scaled, points, ["a", "b"], 0.5).collect()}
    x = np.array([[k * 7919 % 3001 / 1000, 9.0 if k == 8 else k * 104729 % 997 / 500] for k in range(n)])
    has = np.arange(n) != 7
    kernel = kernels.gaussian(x, x[has], 0.5)
    assert len(got) == 3 * n and len(few) == 120
    for v in range(3):
        direct = kernel @ np.array([(k * 31 + v) % 21 / 10 - 1 for k in range(n)])[has] + v / 4
        assert got[v, 7] is None and few[v, 7] is None
        assert np.allclose([got[v, k] for k in range(n) if k != 7], direct[has], atol=1e-8)
        assert np.allclose([few[v, k] for k in range(40) if k != 7], direct[:40][has[:40]], atol=1e-8)


def test_neighbours_are_not_broadcast(spark):
    """However small the voxels' estimated size is, they don't go through the driver."""
    pairs = maps.neighbours(spark.range(200).selectExpr("id AS voxel_id", "id div 25 AS x", "id div 5 % 5 AS y", "id % 5 AS z"))
    assert pairs.count() == sum((8 - abs(a)) * (5 - abs(b)) * (5 - abs(c)) for a, b, c in maps._forward())
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_permuted_features_are_held_by_parts(spark, monkeypatch):
    """No array of all subjects times permutations, and permutations take several tasks."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(1000, 2)), rng.normal(size=(1000, 3))
    seen, asked, real = pls._permuted(x, y, 30, 2), [], pls.permuted_places

    def places(*args):
        asked.append(real(*args))
        return asked[-1]

    monkeypatch.setattr(pls, "permuted_places", places)
    monkeypatch.setattr(pls, "HELD", 64)
    parts = pls._permuted(x, y, 30, 2)
    assert np.allclose(seen, parts) and max(len(a) for a in asked) == 64
    assert (np.concatenate(asked) == real(1000, np.arange(1, 31), True)).all()
    monkeypatch.setattr(pls, "TASK_PLACES", 500)
    moved = pls.permutations(spark.range(1000).withColumnRenamed("id", "subject_id"), 2)
    got = sorted((r.perm_id, r.subject_id, r.source) for r in moved.collect())
    forward = real(1000, np.array([1, 2]))
    assert got == [(k + 1, i, int(forward[i, k])) for k in (0, 1) for i in range(1000)]


def test_support_vectors_settle_fast(monkeypatch):
    """The optimum, by duality, in few rounds; the same where the factor's rows are made in parts."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 2))
    y = np.column_stack([np.sin(x[:, 0]), x[:, 1] ** 2]) + rng.normal(size=(4000, 2)) * 0.2
    factor = kernels.with_pivots(x[:40], 0.3)
    held = svr.Rows(factor, x)
    monkeypatch.setattr(svr, "HELD", 0)
    monkeypatch.setattr(svr, "CHUNK", 700)
    for rows in (held, svr.Rows(factor, x)):
        a, b = svr.solve_dual(rows, y, 1.0, 0.1, rounds=400)
        w = rows.back(a)
        primal = (w**2).sum(0) / 2 + np.maximum(np.abs(y - rows.times(w) - b) - 0.1, 0).sum(0)
        dual = (y * a).sum(0) - (w**2).sum(0) / 2 - 0.1 * np.abs(a).sum(0)
        assert (np.abs(a) <= 1).all() and np.allclose(a.sum(0), 0, atol=1e-5) and (np.abs(primal - dual) < 1e-4 * primal).all()
