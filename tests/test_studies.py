import numpy as np

from gramian.operators import design as dz
from gramian.operators.design import CORRECTOR
from gramian.operators.fit import glm_fit_grouped
from gramian.plans.study import Study, spaced
from gramian.streaming.moments import fit_stream


def test_study(spark):
    rng = np.random.default_rng(0)
    subj = spark.createDataFrame([(k, float(rng.normal()), float(rng.normal())) for k in range(30)], "subject_id long, age double, dose double")
    obs = spark.createDataFrame([(k, v, float(rng.normal())) for k in range(30) for v in range(3)], "subject_id long, voxel_id long, value double")
    plain = Study(("dose",), ("age",), {"dose": 2})
    assert Study.from_json(plain.to_json()) == plain and plain.design().names == ["intercept", "age", "dose", "dose^2"]
    treated = Study(("dose",), ("age",), {"dose": 2}, treatment="orthonormalize")
    a, b = ({r.voxel_id: r.mse for r in s.score(obs, subj).collect()} for s in (plain, treated))
    assert all(np.isclose(a[v], b[v]) for v in a)


def test_study_of_some_categories(spark):
    """Fits and scores are those of the categories' subjects alone."""
    rng = np.random.default_rng(3)
    subj = spark.createDataFrame([(k, k % 3, float(rng.normal())) for k in range(30)], "subject_id long, grp int, dose double")
    obs = spark.createDataFrame([(k, v, float(rng.normal())) for k in range(30) for v in range(2)], "subject_id long, voxel_id long, value double")
    some, alone = Study(("dose",), category="grp", categories=(0, 2)), Study(("dose",))
    few = subj.where("grp <> 1")
    a, b = some.score(obs, subj).collect(), alone.score(obs, few).collect()
    assert {r.voxel_id: round(r.mse, 9) for r in a} == {r.voxel_id: round(r.mse, 9) for r in b}
    whole = {r.voxel_id: r.dose for r in alone.fit(obs, subj)[0].collect()}
    assert all(abs(r.dose - whole[r.voxel_id]) > 1e-6 for r in some.fit(obs, subj)[0].collect())


def test_search_of_a_study(spark):
    rng = np.random.default_rng(2)
    subj = spark.createDataFrame([(k, k % 3, float(rng.normal())) for k in range(24)], "subject_id long, grp int, dose double")
    obs = spark.createDataFrame([(k, v, float(rng.normal())) for k in range(24) for v in range(4)], "subject_id long, voxel_id long, value double")
    study = Study(("dose",), category="grp", categories=(0, 1), hyperparameters={"c": spaced("logarithmic", -1, 1, 3), "epsilon": spaced("linear", 0.1, 0.2, 2)}, iterations=2, sample=3)
    assert Study.from_json(study.to_json()) == study and study.members(subj).count() == 16
    assert np.allclose(study.hyperparameters["c"], (0.1, 1, 10)) and len(spaced("random", 0, 1, 5)) == 5
    got = study.search(obs, subj).collect()
    assert len(got) == 12 and all(r.error > 0 for r in got) and {(r.c, r.epsilon) for r in got} == {(c, e) for c in study.hyperparameters["c"] for e in study.hyperparameters["epsilon"]}


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k % 4, float(rng.normal()), float(rng.normal())) for k in range(80)], "grp long, x double, y double")
    design = dz.with_intercept(dz.terms(["x"]), CORRECTOR)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fit_stream(stream, ["grp"], "y", design, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = {r.grp: (r.intercept, r.x) for r in got.orderBy("batch").collect()}
    for r in glm_fit_grouped(rows, ["grp"], "y", design).collect():
        assert np.allclose(last[r.grp], (r.intercept, r.x))
