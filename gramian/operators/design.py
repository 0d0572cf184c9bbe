"""Design matrices: named terms over the columns of a subjects table.

A treatment (normalise, orthogonalise, orthonormalise) is a matrix T of as many rows and columns as there are terms, so
that the treated columns are Z = X T.  It follows from the Gram matrix X'X, which one aggregation gives; the
driver holds numbers for each pair of terms, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramian.operators.windows import quantile, value_counts

CORRECTOR, PREDICTOR = "corrector", "predictor"


@dataclass(frozen=True)
class Term:
    """A column of the design: its name, the SQL expression that gives it, and its role."""

    name: str
    sql: str
    role: str = PREDICTOR

    @property
    def column(self) -> Column:
        return F.expr(self.sql).cast("double")


@dataclass(frozen=True)
class Design:
    terms: tuple[Term, ...]

    def __len__(self) -> int:
        return len(self.terms)

    def __add__(self, other: Design) -> Design:
        return Design(self.terms + other.terms)

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    def of(self, role: str) -> list[int]:
        return [k for k, t in enumerate(self.terms) if t.role == role]

    def gram(self, df: DataFrame, weight: str | None = None) -> np.ndarray:
        """X'X, or X'WX."""
        cols, w = [t.column for t in self.terms], F.expr(weight) if weight else F.lit(1.0)
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        row = df.agg(*[F.sum(w * cols[i] * cols[j]) for i, j in pairs]).first()
        g = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, row):
            g[i, j] = g[j, i] = v or 0.0
        return g


    def complete(self, df: DataFrame, weight: str | None = None) -> DataFrame:
        """The rows in which no term, and not the weight, is null."""
        cols = [t.column for t in self.terms] + ([F.expr(weight)] if weight else [])
        return df.where(F.coalesce(*[F.when(c.isNull(), F.lit(False)) for c in cols], F.lit(True))) if cols else df


@dataclass(frozen=True)
class Basis:
    """Columns Z = X T of a design, orthonormal over the rows that they come from: T has a row for each term and ``rank`` columns.
    gram: what Z'WZ is, nearly the unit matrix.  n, sign: how many rows there are, and the exclusive or of the hashes of their ids."""

    t: np.ndarray
    gram: np.ndarray
    n: int
    sign: int

    @property
    def rank(self) -> int:
        return self.t.shape[1]

    def columns(self, design: Design) -> list[Column]:
        cols = [x.column for x in design.terms]
        return [sum((float(self.t[i, k]) * c for i, c in enumerate(cols) if self.t[i, k]), F.lit(0.0)) for k in range(self.rank)]


def factored(df: DataFrame, design: Design, weight: str | None = None) -> Basis:
    """The basis of the complete rows of ``df``, by a triangular factor of their (weighted) columns.

    Each task factors the rows it has, and the factors, as many numbers as there are pairs of terms, are factored again.  No product X'X is
    formed, so it holds for powers of features far from zero.  The first columns of Z span the first terms.  Where columns depend on others, T gives the
    solution of smallest norm.
    """
    k, rows = len(design), design.complete(df, weight)
    root = F.sqrt(F.expr(weight).cast("double")) if weight else F.lit(1.0)

    def triangle(it):
        r, n, sign = np.zeros((0, k)), 0, 0
        for batch in it:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            w = cols[1].astype(float)
            r = np.linalg.qr(np.vstack([r, np.column_stack([c * w for c in cols[2:]])]) if k else r, mode="r")
            n, sign = n + batch.num_rows, sign ^ int(np.bitwise_xor.reduce(cols[0].view(np.uint64)))
        signed = sign - (1 << 64) if sign >> 63 else sign
        yield pa.record_batch([pa.array([n]), pa.array([signed]), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "sign", "r"])

    ids = F.xxhash64("subject_id") if "subject_id" in df.columns else F.lit(0).cast("long")
    got = rows.select(ids.alias("h"), root.alias("w"), *[t.column.alias(f"t{j}") for j, t in enumerate(design.terms)]).mapInArrow(triangle, "n long, sign long, r array<double>").collect()
    r = np.vstack([np.zeros((0, k)), *[np.array(x.r, float).reshape(-1, k) for x in got if k and len(x.r)]])
    r = np.linalg.qr(r, mode="r") if len(r) else np.zeros((k, k))
    sign = 0
    for x in got:
        sign ^= x.sign
    norms = np.sqrt((r**2).sum(axis=0))
    scale = np.where(norms > 0, norms, 1.0)
    s = np.linalg.svd(r / scale, compute_uv=False) if k else np.zeros(0)
    n = sum(x.n for x in got)
    if k and len(r) == k and (norms > 0).all() and s[-1] > max(n, k) * np.finfo(float).eps * s[0]:
        t = np.linalg.inv(r / scale) / scale[:, None]
        gram = np.eye(k)
        if s[0] > 1e5 * s[-1]:
            # T's rounding shows in Z: take what Z'WZ is instead of what it should be.
            z = Basis(t, gram, n, sign).columns(design)
            w = F.expr(weight) if weight else F.lit(1.0)
            row = rows.agg(*[F.sum(w * z[i] * z[j]) for i in range(k) for j in range(k)]).first()
            gram = np.array(row, float).reshape(k, k)
        return Basis(t, gram, n, sign)
    u, s, vt = np.linalg.svd(r) if k else (np.zeros((0, 0)), s, np.zeros((0, 0)))
    held = s > max(n, k) * np.finfo(float).eps * s.max(initial=0.0)
    return Basis((vt[: len(s)][held].T / s[held]) if k else np.zeros((0, 0)), np.eye(int(held.sum())), n, sign)


def terms(features: Sequence[str], role: str = PREDICTOR) -> Design:
    return Design(tuple(Term(f, f, role) for f in features))


def with_intercept(design: Design, role: str | None) -> Design:
    """A column of ones put first, in the given role; None: no intercept."""
    return design if role is None else Design((Term("intercept", "1.0", role), *design.terms))


def poly_terms(feature: str, degree: int, role: str = PREDICTOR) -> Design:
    """Powers 1 to degree."""
    return Design(tuple(Term(feature if d == 1 else f"{feature}^{d}", " * ".join([f"`{feature}`"] * d), role) for d in range(1, degree + 1)))


def polynomial(features: Sequence[str], degree: int, complete: bool = True, constant: bool = False, role: str = PREDICTOR) -> Design:
    """All products of features of the given degree, with repetition; ``complete``: of the lower degrees too."""
    out = [Term("1", "1.0", role)] if constant else []
    for d in range(1 if complete else degree, degree + 1):
        out += [Term("*".join(c), " * ".join(f"`{f}`" for f in c), role) for c in combinations_with_replacement(features, d)]
    return Design(tuple(out))


def submodel(design: Design, roles: dict[str, str | None]) -> Design:
    """Terms moved to another role, or dropped (None); those not named stay."""
    kept = (replace(t, role=roles.get(t.name, t.role)) for t in design.terms if roles.get(t.name, t.role) is not None)
    return Design(tuple(kept))


def treatment(gram: np.ndarray, kind: str, only: Sequence[int] | None = None, floor: float = 1e-14) -> np.ndarray:
    """T for ``kind`` normalize, orthogonalize or orthonormalize, on the columns ``only`` (in their order).

    A column that nothing is left of beside those before it becomes zero.
    """
    k = len(gram)
    t = np.eye(k)
    done: list[int] = []
    for c in range(k) if only is None else only:
        if kind != "normalize":
            for _ in range(2):  # the second pass takes off what rounding left
                for p in done:
                    norm = t[:, p] @ gram @ t[:, p]
                    if norm > 0:
                        t[:, c] -= (t[:, p] @ gram @ t[:, c]) / norm * t[:, p]
        norm = t[:, c] @ gram @ t[:, c]
        if norm <= floor * max(gram[c, c], 1e-300):
            t[:, c] = 0
        elif kind != "orthogonalize":
            t[:, c] /= np.sqrt(norm)
        done.append(c)
    return t


def treat(df: DataFrame, design: Design, t: np.ndarray) -> DataFrame:
    """(subject_id, one treated column for each term)."""
    cols = [x.column for x in design.terms]
    return df.select("subject_id", *[sum((float(t[i, k]) * c for i, c in enumerate(cols)), F.lit(0.0)).alias(n) for k, n in enumerate(design.names)])


def denormalize(params: DataFrame, names: Sequence[str], t: np.ndarray) -> DataFrame:
    """Coefficients of the original columns from those of the treated ones: X T b = X (T b)."""
    rest = [c for c in params.columns if c not in names]
    return params.select(*rest, *[sum((float(t[i, k]) * F.col(n) for k, n in enumerate(names)), F.lit(0.0)).alias(o) for i, o in enumerate(names)])


def standard_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant gives 0."""
    row = df.agg(*[f(n) for n in names for f in (F.avg, F.stddev_pop)]).first()
    cols = {n: (F.col(n) - row[2 * k]) / row[2 * k + 1] if row[2 * k + 1] else F.lit(0.0) for k, n in enumerate(names)}
    return df.withColumns(cols)


def _knots(df: DataFrame, feature: str, count: int) -> tuple[list[float], float, float]:
    """Interior knots at equal shares of the values, read at their ranks, and the ends."""
    counts = value_counts(df.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias(feature)), feature)
    row = counts.agg(F.min(feature), F.max(feature), *[quantile(feature, (k + 1) / (count + 1)) for k in range(count)]).first()
    return list(row[2:]), float(row[0]), float(row[1])


def bspline_basis(df: DataFrame, feature: str, df_terms: int, role: str = PREDICTOR) -> Design:
    """Cubic B-splines without the first one: ``df_terms`` columns, interior knots at quantiles (Cox-de Boor as SQL)."""
    inner, low, high = _knots(df, feature, max(0, df_terms - 3))
    knots = [low] * 4 + inner + [high] * 4
    x = f"CAST(`{feature}` AS DOUBLE)"
    level = []
    for a, b in zip(knots, knots[1:]):
        last = b == high and a < b
        level.append(f"(CASE WHEN {x} >= {a!r}D AND {x} <{'=' if last else ''} {b!r}D THEN 1D ELSE 0D END)" if a < b else None)
    for d in range(1, 4):
        up = []
        for i in range(len(level) - 1):
            parts = []
            if level[i] and knots[i + d] > knots[i]:
                parts.append(f"({x} - {knots[i]!r}D) / {knots[i + d] - knots[i]!r}D * {level[i]}")
            if level[i + 1] and knots[i + d + 1] > knots[i + 1]:
                parts.append(f"({knots[i + d + 1]!r}D - {x}) / {knots[i + d + 1] - knots[i + 1]!r}D * {level[i + 1]}")
            up.append(f"({' + '.join(parts)})" if parts else None)
        level = up
    return Design(tuple(Term(f"bs({feature})_{k}", sql or "0D", role) for k, sql in enumerate(level) if k))


def natural_cubic_basis(df: DataFrame, feature: str, df_terms: int, role: str = PREDICTOR) -> Design:
    """A natural cubic spline by truncated powers: linear beyond the ends, ``df_terms`` columns."""
    inner, low, high = _knots(df, feature, max(0, df_terms - 1))
    knots, x = [low, *inner, high], f"CAST(`{feature}` AS DOUBLE)"
    out = [Term(f"ns({feature})_1", x, role)]

    def cube(k: float) -> str:
        return f"pow(greatest({x} - {k!r}D, 0D), 3)"

    def d(k: int) -> str:
        return f"(({cube(knots[k])} - {cube(high)}) / {high - knots[k]!r}D)"

    out += [Term(f"ns({feature})_{k + 2}", f"({d(k)} - {d(len(knots) - 2)})", role) for k in range(len(knots) - 2)]
    return Design(tuple(out))


def leverage(df: DataFrame, design: Design) -> DataFrame:
    """(subject_id, leverage): x'(X'X)^-1 x."""
    inverse = np.linalg.pinv(design.gram(df))
    cols = [t.column for t in design.terms]
    h = sum((float(inverse[i, j]) * cols[i] * cols[j] for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))
    return df.select("subject_id", h.alias("leverage"))


def effective_df(df: DataFrame, design: Design) -> DataFrame:
    """(df): the trace of the hat matrix."""
    return leverage(df, design).agg(F.sum("leverage").alias("df"))


def covariance_df(pairs: DataFrame, variance: float) -> DataFrame:
    """(df): sum of (y - mean)(fit - mean) over the error variance, for rows (y, fit)."""
    return pairs.agg((F.covar_pop("y", "fit") * F.count("*") / F.lit(variance)).alias("df"))
