"""A study as one value: which columns are what, the model, and the jobs that follow from it."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.operators import design as dz
from gramian.operators import fit, score, search, svr
from gramian.operators.design import CORRECTOR, PREDICTOR, Design


@dataclass(frozen=True)
class Study:
    """Predictors and correctors by name, a polynomial degree for each that has one, where the intercept stands, the
    treatment of the design, and the metrics."""

    predictors: tuple[str, ...]
    correctors: tuple[str, ...] = ()
    degrees: dict[str, int] = field(default_factory=dict)
    intercept: str | None = CORRECTOR
    treatment: str | None = None
    metrics: tuple[str, ...] = ("mse", "r2", "fstat")
    #: The column that holds the subjects' category, and those that count (none: all).
    category: str | None = None
    categories: tuple[int, ...] = ()
    #: The values of each hyperparameter that a search tries; of a range, ``spaced`` gives them.
    hyperparameters: dict[str, tuple[float, ...]] = field(default_factory=dict)
    #: How a search samples: iterations, variables in each, and the least variance.
    iterations: int = 5
    sample: int = 100
    least_variance: float = 0.001

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Study:
        d = json.loads(text)
        d["hyperparameters"] = {k: tuple(v) for k, v in d.get("hyperparameters", {}).items()}
        return Study(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})

    def members(self, subjects: DataFrame) -> DataFrame:
        """The subjects of the study's categories."""
        return subjects.where(F.col(self.category).isin(*self.categories)) if self.category and self.categories else subjects

    def design(self) -> Design:
        parts = Design(())
        for role, names in ((CORRECTOR, self.correctors), (PREDICTOR, self.predictors)):
            for n in names:
                parts = parts + dz.poly_terms(n, self.degrees.get(n, 1), role)
        return dz.with_intercept(parts, self.intercept)

    def fit(self, obs: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame, Design]:
        """Parameters, the subjects table that they refer to (the study's categories), and its design."""
        subjects, design = self.members(subjects), self.design()
        if self.treatment is None:
            return fit.glm_fit(obs, subjects, design), subjects, design
        treated = dz.treat(subjects, design, dz.treatment(design.gram(subjects), self.treatment))
        plain = Design(tuple(dz.Term(t.name, f"`{t.name}`", t.role) for t in design.terms))
        return fit.glm_fit(obs, treated, plain), treated, plain

    def search(self, obs: DataFrame, subjects: DataFrame) -> DataFrame:
        """(combination, one column for each hyperparameter, iteration, error): support-vector fits of the predictors with every combination of
        hyperparameters (c, epsilon and, for Gaussian fits, gamma) on sampled variables."""
        grid = search.param_grid(obs.sparkSession, {k: list(v) for k, v in self.hyperparameters.items()})
        own = self.members(subjects)
        errors = search.grid_search(obs, self.iterations, self.sample, self.least_variance, lambda sampled: svr.grid_errors(sampled.join(own.select("subject_id"), "subject_id", "left_semi"), own, self.predictors, grid))
        return grid.join(errors, "combination")

    def score(self, obs: DataFrame, subjects: DataFrame) -> DataFrame:
        """(voxel_id, metrics)."""
        params, table, design = self.fit(obs, subjects)
        return score.evaluate(obs, table, params, design, list(self.metrics))


def spaced(method: str, start: float, end: float, n: int) -> tuple[float, ...]:
    """n values from start to end: ``linear``, ``logarithmic`` (start and end are powers of ten) or ``random`` (evenly at random, by a fixed seed)."""
    rng = random.Random(n)
    steps = [rng.random() if method == "random" else k / max(1, n - 1) for k in range(n)]
    values = [start + (end - start) * t for t in steps]
    return tuple(10.0**v if method == "logarithmic" else float(v) for v in values)
