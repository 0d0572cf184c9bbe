"""One query for each operator, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramian import fixtures as fx
from gramian.fixtures import fit_sql, with_sql
from gramian.functions import columns as fc
from gramian.functions.distributions import f_cdf_column
from gramian.operators import design as dz
from gramian.operators import fit as ft
from gramian.operators import graph, local, maps, pls, score, search, summary, svr, windows
from gramian.operators.design import CORRECTOR, PREDICTOR, Design, Term
from gramian.runtime import checkpoint_dir, cut, written
from gramian.sources import metadata, results, volumes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and no negative zero), other numbers as longs."""
    cols = [(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*cols)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, which all executors share."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


BASE = Design((Term("intercept", "1.0", CORRECTOR), Term("age", "age", CORRECTOR), Term("sex", "sex", CORRECTOR), Term("biomarker", "biomarker", PREDICTOR)))
_D = "d AS (SELECT o.voxel_id, o.subject_id, o.value, s.age, s.sex, s.biomarker, s.category FROM obs o JOIN subj s USING (subject_id))"
_TERMS = ["1.0::DOUBLE", "age", "sex", "biomarker"]
_FIT = fit_sql("d", "voxel_id", _TERMS)
_R = "r AS (SELECT d.*, d.value - (b0 + b1*age + b2*sex) AS corrected, b3*biomarker AS predicted, b3 FROM d JOIN fit USING (voxel_id))"
_FITTED = with_sql("subj", "obs", _D, _FIT, _R)


_LINE = dz.with_intercept(dz.terms(["biomarker"]), PREDICTOR)


def _fitted(spark, d):
    obs, subj = fx.observations(spark, d), fx.subjects(spark, d)
    return obs, subj, ft.glm_fit(obs, subj, BASE)


# --- sources -------------------------------------------------------------------------------------------------


def _sheet(spark, d) -> str:
    """A dirty CSV sheet: padded and mixed-case headers, cells that are no numbers, blank ids."""
    path = scratch(spark, "sheet")
    c = fx.read(spark, d, "customer")
    odd = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("decimal(15,2)").cast("string"))
    ident = F.when(F.col("c_custkey") % 11 == 0, F.lit(" ")).otherwise(F.col("c_custkey").cast("string"))
    c.select(ident.alias(" ID "), F.col("c_nationkey").cast("string").alias("Category"), odd.alias("AcctBal "), F.col("c_name").alias(" NAME")).write.csv(path, header=True)
    return path


@query("s1_read_metadata", "SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS id, CAST(c_nationkey AS VARCHAR) AS category, CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) END AS acctbal, c_name AS name FROM customer")
def s1(spark, d):
    df = metadata.read_metadata(spark, _sheet(spark, d))
    return df.withColumn("id", F.when(F.trim("id") != "", F.trim("id")))


@query("s2_typed_rows", "SELECT CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS BIGINT) END AS id, CASE WHEN c_custkey % 7 <> 0 THEN round(CAST(c_acctbal AS DOUBLE), 2) END AS acctbal, CAST(NULL AS DOUBLE) AS missing FROM customer WHERE c_custkey % 77 <> 0")
def s2(spark, d):
    return rounded(metadata.typed_rows(metadata.read_metadata(spark, _sheet(spark, d)), {"id": "long", "acctbal": "double", "missing": "double"}), 2)


@query("s3_row_slice", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n > 10 AND n <= 60")
def s3(spark, d):
    return metadata.row_slice(fx.read(spark, d, "customer").select(F.col("c_custkey").cast("long"), "c_name"), "c_custkey", 10, 60)


@query("s4_subject_table", "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, CAST(c_nationkey AS BIGINT) AS category, round(CAST(c_acctbal AS DOUBLE), 2) AS acctbal, 'img/' || c_custkey || '.nii' AS image FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0")
def s4(spark, d):
    return rounded(metadata.subject_table(metadata.read_metadata(spark, _sheet(spark, d)), "id", "category", ["acctbal"], [], "img/", ".nii"), 2)


@query("s5_explode_volume", with_sql("obs") + "SELECT voxel_id, x, y, z, count(*) AS n, round(sum(value), 6) AS total FROM obs GROUP BY ALL")
def s5(spark, d):
    return rounded(fx.observations(spark, d).groupBy("voxel_id", "x", "y", "z").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("s6_region", with_sql("obs") + "SELECT subject_id, voxel_id, round(value, 6) AS value FROM obs WHERE x >= 0 AND x < 2 AND y >= 1 AND y < 3 AND z >= 2 AND z < 9")
def s6(spark, d):
    return rounded(volumes.region(fx.observations(spark, d), (-1, 2), (1, 3), (2, 9)).select("subject_id", "voxel_id", "value"))


_BOXED = "SELECT subject_id, voxel_id, x, y, z, round(value, 6) AS value FROM obs WHERE x >= 0 AND x < 2 AND y >= 1 AND y < 3 AND z >= 2 AND z < 9"


@query("s6_explode_region", with_sql("obs") + _BOXED)
def s6e(spark, d):
    """Taken out of the arrays before they are exploded."""
    return rounded(volumes.explode_region(fx.read(spark, d, "embeddings"), "vec_id", "embedding", (4, 4, 4), (-1, 2), (1, 3), (2, 9)))


@query("s6_stored_region", with_sql("obs") + _BOXED)
def s6s(spark, d):
    """From blocks along a space-filling curve."""
    path = scratch(spark, "volumes")
    volumes.store_volumes(fx.observations(spark, d), path, side=2, files=8)
    return rounded(volumes.read_region(spark, path, (-1, 2), (1, 3), (2, 9)))


@query("s7_vertex_range", with_sql("obs") + "SELECT subject_id, voxel_id, round(value, 6) AS value FROM obs WHERE voxel_id >= 5 AND voxel_id < 9")
def s7(spark, d):
    return rounded(volumes.vertex_range(fx.observations(spark, d), 5, 9).select("subject_id", "voxel_id", "value"))


@query("s8_feature_matrix", with_sql("subj") + "SELECT subject_id, round(age, 6) AS f0, round(sex, 6) AS f1, round(biomarker, 6) AS f2 FROM subj")
def s8(spark, d):
    m = volumes.feature_matrix(fx.subjects(spark, d), ["age", "sex", "biomarker"])
    return rounded(m.select("subject_id", *[F.col("features")[k].alias(f"f{k}") for k in range(3)]))


@query("s9_write_results", with_sql("subj", "obs", _D, fit_sql("d", "category, voxel_id", ["1.0::DOUBLE", "age"])) + "SELECT 'age' AS model, CAST(category AS BIGINT) AS category, voxel_id, round(b0, 4) AS intercept, round(b1, 4) AS age FROM fit")
def s9(spark, d):
    path = scratch(spark, "results")
    params = ft.fit_by_category(fx.observations(spark, d), fx.subjects(spark, d), dz.with_intercept(dz.terms(["age"]), CORRECTOR))
    results.write_results(params.withColumn("model", F.lit("age")), path)
    return rounded(spark.read.parquet(path).select("model", F.col("category").cast("long"), "voxel_id", "intercept", "age"), 4)


@query("s10_results_catalog", "SELECT 'glm_' || l_returnflag || '-category_' || (l_suppkey % 3) AS name, 'glm_' || l_returnflag AS model, CAST(l_suppkey % 3 AS BIGINT) AS category FROM lineitem GROUP BY ALL UNION SELECT 'glm_' || l_returnflag || '_vs_all', 'glm_' || l_returnflag, NULL FROM lineitem")
def s10(spark, d):
    path = scratch(spark, "catalog")
    li = fx.read(spark, d, "lineitem")
    names = li.select(F.concat(F.lit("glm_"), "l_returnflag", F.lit("-category_"), F.col("l_suppkey") % 3).alias("model")).union(li.select(F.concat(F.lit("glm_"), "l_returnflag", F.lit("_vs_all")))).distinct()
    results.write_results(names.withColumn("category", F.lit("all")).withColumn("beta", F.lit(0.0)), path)
    return rounded(results.results_catalog(spark, path))


@query("s11_read_roi", "SELECT CAST(n_nationkey AS BIGINT) AS roi_id, n_name AS roi_name FROM nation")
def s11(spark, d):
    path = scratch(spark, "roi")
    fx.read(spark, d, "nation").select(F.col("n_nationkey").alias("ROIid"), F.col("n_name").alias("ROIname")).write.csv(path, header=True, sep=";")
    return results.read_roi(spark, path, "ROIid", "ROIname")


@query("s12_write_error_table", "SELECT CAST(l_suppkey % 50 AS BIGINT) AS combination, round(avg(CAST(l_quantity AS DOUBLE)), 2) AS error FROM lineitem GROUP BY 1")
def s12(spark, d):
    path = scratch(spark, "errors")
    results.write_error_table(fx.read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).cast("long").alias("combination")).agg(F.avg(F.col("l_quantity").cast("double")).alias("error")), path)
    return spark.read.csv(path, header=True, sep=";", schema="combination long, error double")


@query("s13_collect_maps", with_sql("grid", "maps") + "SELECT 'a' AS map_name, voxel_id, round(a, 6) AS value FROM maps UNION ALL SELECT 'b', voxel_id, round(b, 6) FROM maps UNION ALL SELECT 'c', voxel_id, round(c, 6) FROM maps")
def s13(spark, d):
    return rounded(results.collect_maps(dict(zip("abc", fx.maps(spark, d)))))


# --- columns -------------------------------------------------------------------------------------------------


@query("p1_for_category", with_sql("subj") + "SELECT subject_id, round(age, 6) AS age FROM subj WHERE category = 3")
def p1(spark, d):
    return rounded(fc.for_category(fx.subjects(spark, d), 3).select("subject_id", "age"))


@query("p2_one_vs_all", with_sql("subj") + "SELECT subject_id, " + ", ".join(f"round(CASE WHEN category = {c} THEN biomarker ELSE 0 END, 6) AS biomarker_{c}" for c in (0, 1, 2)) + " FROM subj")
def p2(spark, d):
    return rounded(fc.one_vs_all(fx.subjects(spark, d), "biomarker", [0, 1, 2]).select("subject_id", "biomarker_0", "biomarker_1", "biomarker_2"))


@query("p3_field_transforms", "SELECT CAST(c_custkey AS BIGINT) AS k, split_part(c_name, '#', 1) AS token, CAST(c_nationkey - 1 AS BIGINT) AS shifted, CAST(2 * (c_nationkey % 2) - 1 AS BIGINT) AS recoded FROM customer")
def p3(spark, d):
    c = fx.read(spark, d, "customer")
    n = F.col("c_nationkey").cast("long")
    return c.select(F.col("c_custkey").cast("long").alias("k"), fc.first_token(F.concat(F.lit(" "), "c_name"), "#").alias("token"), fc.shifted(n).alias("shifted"), fc.recoded(n % 2).alias("recoded"))


@query("p4_file_key", "SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS file_key FROM customer")
def p4(spark, d):
    return fx.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), fc.file_key(F.concat(F.lit("/data/nc/"), "c_name", F.lit(".nii"))).alias("file_key"))


_AFFINE = np.array([[-1.5, 0, 0, 90], [0, 1.5, 0, -126], [0, 0, 1.5, -72], [0, 0, 0, 1.0]])


@query("p5_affine", with_sql("grid") + "SELECT voxel_id, -1.5::DOUBLE*x + 90 AS mx, 1.5::DOUBLE*y - 126 AS my, 1.5::DOUBLE*z - 72 AS mz, CAST(x AS BIGINT) AS vx, CAST(y AS BIGINT) AS vy, CAST(z AS BIGINT) AS vz FROM grid")
def p5(spark, d):
    g = fx.grid_map(spark, d)
    mm = g.select("voxel_id", *[c.alias(f"m{n}") for n, c in zip("xyz", fc.voxel_to_mm(tuple(F.col(a).cast("double") for a in "xyz"), _AFFINE))])
    return rounded(mm.select("*", *[c.alias(f"v{n}") for n, c in zip("xyz", fc.mm_to_voxel(tuple(F.col(f"m{a}") for a in "xyz"), _AFFINE))]))


@query("p6_fill_non_finite", with_sql("obs") + "SELECT subject_id, voxel_id, CASE WHEN voxel_id % 3 = 0 OR value <= 0 THEN -1.0::DOUBLE ELSE round(ln(value), 6) END AS value FROM obs")
def p6(spark, d):
    odd = F.when(F.col("voxel_id") % 3 == 0, F.lit(float("nan"))).when(F.col("value") == 0, F.lit(float("-inf"))).when(F.col("value") > 0, F.log("value"))
    return rounded(fx.observations(spark, d).select("subject_id", "voxel_id", fc.fill_non_finite(odd, -1.0).alias("value")))


@query("p7_mean_mask", with_sql("obs") + "SELECT voxel_id, CASE WHEN avg(value) < 0 THEN -9.0::DOUBLE ELSE round(max(value), 6) END AS value FROM obs GROUP BY voxel_id")
def p7(spark, d):
    obs = fx.observations(spark, d)
    return rounded(fc.mean_mask(obs.groupBy("voxel_id").agg(F.max("value").alias("value")), obs, 0.0, -9.0))


@query("p8_value_grid", "SELECT g AS i, round(pow(10.0::DOUBLE, -3 + g * (n / 5.0::DOUBLE) / 9), 6) AS value FROM range(10) t(g), (SELECT count(*) AS n FROM region)")
def p8(spark, d):
    return rounded(fc.value_grid(spark, -3, -3 + fx.read(spark, d, "region").count() / 5, 10, "logarithmic"))


@query("p9_min_max_scale", with_sql("grid") + "SELECT voxel_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM grid")
def p9(spark, d):
    return rounded(fc.min_max_scale(fx.grid_map(spark, d).select("voxel_id", "value")))


@query("p10_drop_background", with_sql("grid") + "SELECT voxel_id, round(value - 0.02::DOUBLE, 6) AS value FROM grid WHERE round(value - 0.02::DOUBLE, 6) <> 0")
def p10(spark, d):
    return fc.drop_background(rounded(fx.grid_map(spark, d).selectExpr("voxel_id", "value - 0.02D AS value")))


@query("p11_orthogonal_slice", with_sql("grid") + "SELECT CAST(9 - z AS BIGINT) AS row, CAST(x AS BIGINT) AS col, round(value, 6) AS value FROM grid WHERE y = 4")
def p11(spark, d):
    return rounded(fc.orthogonal_slice(fx.grid_map(spark, d), "y", 4, (1 << 30, 10, 10)))


# --- joins ---------------------------------------------------------------------------------------------------


@query("j1_subjects_observations", with_sql("subj", "obs", _D) + "SELECT voxel_id, CAST(category AS BIGINT) AS category, round(avg(value * age), 6) AS m FROM d GROUP BY ALL")
def j1(spark, d):
    return rounded(fx.observations(spark, d).join(fx.subjects(spark, d), "subject_id").groupBy("voxel_id", "category").agg(F.avg(F.col("value") * F.col("age")).alias("m")))


@query("j2_observations_parameters", _FITTED + "SELECT voxel_id, round(sum(value * b3), 4) AS s FROM r GROUP BY voxel_id")
def j2(spark, d):
    obs, _, params = _fitted(spark, d)
    return rounded(obs.join(params, "voxel_id").groupBy("voxel_id").agg(F.sum(F.col("value") * F.col("biomarker")).alias("s")), 4)


def _atlas(spark, d):
    roi = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("roi_id"), F.col("n_name").alias("roi_name"))
    g = fx.grid_map(spark, d)
    return g.select("voxel_id", "value"), g.select("voxel_id", (F.col("voxel_id") % 27).alias("roi_id")), roi


@query("j3_map_atlas", with_sql("grid") + "SELECT voxel_id, round(value, 6) AS value, voxel_id % 27 AS roi_id, n_name AS roi_name FROM grid LEFT JOIN nation ON n_nationkey = voxel_id % 27")
def j3(spark, d):
    return rounded(maps.name_regions(*_atlas(spark, d)))


@query("j4_map_map", with_sql("grid", "maps") + "SELECT voxel_id, round(a, 6) AS m0, round(b, 6) AS m1, round(c, 6) AS m2 FROM maps")
def j4(spark, d):
    return rounded(maps.joined_maps(fx.maps(spark, d)))


@query("j5_grid_voxels", with_sql("obs") + "SELECT voxel_id, CAST(c AS DOUBLE) AS c, CAST(e AS DOUBLE) AS e, c * 2 + e AS combination FROM (SELECT DISTINCT voxel_id FROM obs), range(3) a(c), range(2) b(e)")
def j5(spark, d):
    return fx.observations(spark, d).select("voxel_id").distinct().crossJoin(F.broadcast(search.param_grid(spark, {"c": [0, 1, 2], "e": [0, 1]})))


_BAND = "pts AS (SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part), gr AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS g FROM part), band AS (SELECT g, x, y, x - g AS dx, pow(1 - pow(abs(x - g)/9, 3), 3) AS w FROM pts JOIN gr ON abs(x - g) <= 9)"


def _scatter(spark, d):
    pts = fx.read(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    return pts, pts.select(F.col("x").alias("g")).distinct()  # sizes are 1 to 50


@query("j6_band_join", with_sql(_BAND) + "SELECT g, count(*) AS n, round(sum(y), 2) AS s FROM band GROUP BY g")
def j6(spark, d):
    pts, grid = _scatter(spark, d)
    return rounded(local.band_join(pts, "x", grid, 9).groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("s")), 2)


@query("j7_neighbours", with_sql("grid") + "SELECT least(a.voxel_id, b.voxel_id) AS lo, greatest(a.voxel_id, b.voxel_id) AS hi FROM grid a JOIN grid b ON a.voxel_id < b.voxel_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.z-b.z) <= 1")
def j7(spark, d):
    return maps.neighbours(fx.grid_map(spark, d)).select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))


_M = 2147483647
#: Places of subjects (from 0) under keyed bijections: in each turn a place and its partner change or don't.
_PERM = (
    "nn AS (SELECT count(*) AS n, CAST(6*ceil(log2(count(*))) AS BIGINT) AS turns FROM subj), pl AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS place FROM subj), "
    "sw AS (SELECT i AS perm_id, place AS start, place AS x, 1::BIGINT AS r FROM pl, range(1, {n} + 1) t(i) UNION ALL "
    f"SELECT perm_id, start, CASE WHEN (((t*t) % {_M} + h*16807 + r*7919) % {_M})*(((t*t) % {_M} + h*16807 + r*7919) % {_M}) % {_M} % 2 = 1 THEN o ELSE x END, r + 1 FROM ("
    f"SELECT *, (h*48271 + r*69621 + perm_id*40692 + 1) % {_M} AS t FROM (SELECT *, greatest(x, o) AS h FROM (SELECT *, (k + n - x) % n AS o FROM ("
    f"SELECT sw.*, n, (((r*69621 + perm_id*40692 + 12345) % {_M})*((r*69621 + perm_id*40692 + 12345) % {_M}) % {_M} * 48271 + r) % {_M} % n AS k FROM sw, nn WHERE r <= turns))))), "
    "perm AS (SELECT sw.perm_id, a.subject_id, b.subject_id AS source FROM sw JOIN nn ON r = turns + 1 JOIN pl a ON a.place = start JOIN pl b ON b.place = x)"
)


@query("j8_permuted_subjects", with_sql("subj", _PERM.format(n=3)) + "SELECT perm_id, subject_id, source FROM perm")
def j8(spark, d):
    return pls.permutations(fx.subjects(spark, d), 3).withColumn("perm_id", F.col("perm_id").cast("long"))


# --- designs -------------------------------------------------------------------------------------------------


def _columns(design: Design, df: DataFrame) -> DataFrame:
    return rounded(df.select("subject_id", *[t.column.alias(f"c{k}") for k, t in enumerate(design.terms)]))


@query("d1_with_intercept", with_sql("subj") + "SELECT subject_id, 1.0::DOUBLE AS c0, age AS c1 FROM subj")
def d1(spark, d):
    return _columns(dz.with_intercept(dz.terms(["age"]), CORRECTOR), fx.subjects(spark, d))


@query("d2_poly_terms", with_sql("subj") + "SELECT subject_id, round(biomarker, 6) AS c0, round(biomarker*biomarker, 6) AS c1, round(biomarker*biomarker*biomarker, 6) AS c2 FROM subj")
def d2(spark, d):
    return _columns(dz.poly_terms("biomarker", 3), fx.subjects(spark, d))


@query("d3_polynomial", with_sql("subj") + "SELECT subject_id, 1.0::DOUBLE AS c0, age AS c1, round(biomarker, 6) AS c2, age*age AS c3, round(age*biomarker, 6) AS c4, round(biomarker*biomarker, 6) AS c5 FROM subj")
def d3(spark, d):
    return _columns(dz.polynomial(["age", "biomarker"], 2, constant=True), fx.subjects(spark, d))


@query("d4_submodel", with_sql("subj") + "SELECT 'corrector' AS role, round(sum(biomarker*biomarker), 4) AS total FROM subj UNION ALL SELECT 'predictor', round(sum(biomarker), 4) FROM subj")
def d4(spark, d):
    m = dz.submodel(dz.poly_terms("biomarker", 3), {"biomarker^2": CORRECTOR, "biomarker^3": None})
    rows = fx.subjects(spark, d).agg(*[F.sum(t.column).alias(t.role) for t in m.terms])
    return rounded(rows.select(F.explode(F.array(*[F.struct(F.lit(t.role).alias("role"), F.col(t.role).alias("total")) for t in m.terms])).alias("r")).select("r.*"), 4)


_ABC = Design((Term("intercept", "1.0", CORRECTOR), Term("age", "age", CORRECTOR), Term("biomarker", "biomarker", PREDICTOR)))


def _treated(kind: str):
    def run(spark, d):
        subj = fx.subjects(spark, d)
        return rounded(dz.treat(subj, _ABC, dz.treatment(_ABC.gram(subj), kind)))

    return run


query("d5_normalize", with_sql("subj") + "SELECT subject_id, round(1/sqrt(count(*) OVER ()), 6) AS intercept, round(age/sqrt(sum(age*age) OVER ()), 6) AS age, round(biomarker/sqrt(sum(biomarker*biomarker) OVER ()), 6) AS biomarker FROM subj")(_treated("normalize"))
_GS = "gs AS (SELECT subject_id, 1.0::DOUBLE AS z0, age - (SELECT avg(age) FROM subj) AS z1, biomarker - (SELECT avg(biomarker) FROM subj) - (SELECT regr_slope(biomarker, age) FROM subj) * (age - (SELECT avg(age) FROM subj)) AS z2 FROM subj)"
query("d6_orthogonalize", with_sql("subj", _GS) + "SELECT subject_id, z0 AS intercept, round(z1, 6) AS age, round(z2, 6) AS biomarker FROM gs")(_treated("orthogonalize"))
query("d7_orthonormalize", with_sql("subj", _GS) + "SELECT subject_id, round(z0/sqrt(count(*) OVER ()), 6) AS intercept, round(z1/sqrt(sum(z1*z1) OVER ()), 6) AS age, round(z2/sqrt(sum(z2*z2) OVER ()), 6) AS biomarker FROM gs")(_treated("orthonormalize"))


@query("d8_denormalize", with_sql("subj", "obs", _D, fit_sql("d", "voxel_id", ["1.0::DOUBLE", "age", "biomarker"])) + "SELECT voxel_id, round(b0, 4) AS intercept, round(b1, 4) AS age, round(b2, 4) AS biomarker FROM fit")
def d8(spark, d):
    subj, obs = fx.subjects(spark, d), fx.observations(spark, d)
    t = dz.treatment(_ABC.gram(subj), "orthonormalize")
    params = ft.glm_fit(obs, dz.treat(subj, _ABC, t), dz.terms(_ABC.names))
    return rounded(dz.denormalize(params, _ABC.names, t), 4)


@query("d9_standard_scale", with_sql("subj") + "SELECT subject_id, round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 6) AS age, round((biomarker - avg(biomarker) OVER ()) / stddev_pop(biomarker) OVER (), 6) AS biomarker FROM subj")
def d9(spark, d):
    return rounded(dz.standard_scale(fx.subjects(spark, d), ["age", "biomarker"]).select("subject_id", "age", "biomarker"))


@query("d10_bspline_basis", with_sql("subj", "u AS (SELECT subject_id, (age - (SELECT min(age) FROM subj)) / ((SELECT max(age) FROM subj) - (SELECT min(age) FROM subj)) AS u FROM subj)") + "SELECT subject_id, round(3*u*(1-u)*(1-u), 6) AS c0, round(3*u*u*(1-u), 6) AS c1, round(u*u*u, 6) AS c2 FROM u")
def d10(spark, d):
    subj = fx.subjects(spark, d)
    return _columns(dz.bspline_basis(subj, "age", 3), subj)


@query("d10_bspline_basis_knots")
def d10k(spark, d):
    subj = fx.subjects(spark, d)
    return _columns(dz.bspline_basis(subj, "age", 6), subj)


@query("d11_natural_cubic_basis")
def d11(spark, d):
    subj = fx.subjects(spark, d)
    return _columns(dz.natural_cubic_basis(subj, "biomarker", 4), subj)


@query("d12_leverage", with_sql("subj") + "SELECT subject_id, round(1.0/count(*) OVER () + pow(age - avg(age) OVER (), 2) / (var_pop(age) OVER () * count(*) OVER ()), 6) AS leverage FROM subj")
def d12(spark, d):
    return rounded(dz.leverage(fx.subjects(spark, d), dz.with_intercept(dz.terms(["age"]), CORRECTOR)))


@query("d12_effective_df", "SELECT 4.0::DOUBLE AS df FROM embeddings LIMIT 1")
def d12e(spark, d):
    return rounded(dz.effective_df(fx.subjects(spark, d), BASE))


@query("d12_effective_df_shares", with_sql("subj") + "SELECT CAST(category AS BIGINT) AS category, round(sum(leverage), 6) AS df FROM (SELECT category, 1.0/count(*) OVER () + pow(age - avg(age) OVER (), 2) / (var_pop(age) OVER () * count(*) OVER ()) AS leverage FROM subj) GROUP BY category")
def d12s(spark, d):
    """What each category's subjects have of the effective degrees of freedom."""
    subj = fx.subjects(spark, d)
    own = dz.leverage(subj, dz.with_intercept(dz.terms(["age"]), CORRECTOR)).join(subj.select("subject_id", "category"), "subject_id")
    return rounded(own.groupBy("category").agg(F.sum("leverage").alias("df")))


@query("d12_covariance_df", with_sql("subj") + "SELECT round(covar_pop(biomarker, age) * count(*) / 2.5, 4) AS df FROM subj")
def d12c(spark, d):
    return rounded(dz.covariance_df(fx.subjects(spark, d).selectExpr("biomarker AS y", "age AS fit"), 2.5), 4)


# --- fits ----------------------------------------------------------------------------------------------------


@query("g1_glm_fit", _FITTED.rsplit(", r AS", 1)[0] + " SELECT voxel_id, round(b0, 4) AS intercept, round(b1, 4) AS age, round(b2, 4) AS sex, round(b3, 4) AS biomarker FROM fit")
def g1(spark, d):
    return rounded(_fitted(spark, d)[2], 4)


@query("g1_glm_fit_weighted", with_sql("subj", "obs", _D, fit_sql("d", "voxel_id", ["1.0::DOUBLE", "biomarker"], weight="(1 + sex)")) + "SELECT voxel_id, round(b0, 4) AS intercept, round(b1, 4) AS biomarker FROM fit")
def g1w(spark, d):
    return rounded(ft.glm_fit(fx.observations(spark, d), fx.subjects(spark, d), dz.with_intercept(dz.terms(["biomarker"]), CORRECTOR), weight="1.0 + sex"), 4)


def _lacking(spark, d):
    """Observations of which three variables in four lack subjects, by three rules, and a value is null here and there."""
    obs = fx.observations(spark, d)
    kept = obs.where("voxel_id % 4 = 0 OR (subject_id*7919 + voxel_id % 4) % 11 <> 0")
    return kept.withColumn("value", F.when(F.expr("voxel_id % 32 <> 5 OR subject_id % 7 <> 1"), F.col("value")))


_LACKING = "have AS (SELECT * FROM d WHERE (voxel_id % 4 = 0 OR (subject_id*7919 + voxel_id % 4) % 11 <> 0) AND (voxel_id % 32 <> 5 OR subject_id % 7 <> 1))"


@query("g1_glm_fit_lacking", with_sql("subj", "obs", _D, _LACKING, fit_sql("have", "voxel_id", _TERMS)) + "SELECT voxel_id, round(b0, 4) AS intercept, round(b1, 4) AS age, round(b2, 4) AS sex, round(b3, 4) AS biomarker FROM fit")
def g1m(spark, d):
    return rounded(ft.glm_fit(_lacking(spark, d), fx.subjects(spark, d), BASE), 4)


@query("e5_tstat_lacking", with_sql("subj", "obs", _D, _LACKING, fit_sql("have", "voxel_id", ["1.0::DOUBLE", "biomarker"]), "rs AS (SELECT voxel_id, any_value(b1) AS b1, sum(pow(value - b0 - b1*biomarker, 2)) AS rss, count(*) AS n, var_pop(biomarker)*count(*) AS sxx FROM have JOIN fit USING (voxel_id) GROUP BY voxel_id)") + "SELECT voxel_id, round(b1/sqrt(rss/(n - 2)/sxx), 4) AS tstat FROM rs")
def e5m(spark, d):
    obs, subj = _lacking(spark, d), fx.subjects(spark, d)
    return rounded(score.tstat(obs, subj, ft.glm_fit(obs, subj, _LINE), _LINE, "biomarker"), 4)


_FAR = "f AS (SELECT voxel_id, subject_id, value, age + 1000 AS far, age - 49.5 AS near FROM d)"


@query("g3_polyglm_fit_far", with_sql("subj", "obs", _D, _FAR, fit_sql("f", "voxel_id", ["1.0::DOUBLE", "near", "near*near", "near*near*near"])) + "SELECT voxel_id, subject_id, round(b0 + b1*near + b2*near*near + b3*near*near*near, 4) AS predicted FROM f JOIN fit USING (voxel_id)")
def g3f(spark, d):
    """A cubic of a feature far from zero, by its predictions, against the same cubic about the middle."""
    obs, subj = fx.observations(spark, d), fx.subjects(spark, d).withColumn("far", F.col("age") + 1000)
    params, design = ft.polyglm_fit(obs, subj, dz.with_intercept(Design(()), PREDICTOR), {"far": 3})
    return rounded(ft.predict(obs, subj, params, design), 4)


_LI = Design((Term("intercept", "1.0", CORRECTOR), Term("discount", "discount", CORRECTOR), Term("tax", "tax", CORRECTOR), Term("quantity", "quantity", PREDICTOR)))


@query("g2_glm_fit_grouped", with_sql("li", fit_sql("li", "grp", ["1.0::DOUBLE", "discount", "tax", "quantity"], y="price")) + "SELECT grp, round(b0, 2) AS intercept, round(b1, 2) AS discount, round(b2, 2) AS tax, round(b3, 3) AS quantity FROM fit")
def g2(spark, d):
    out = ft.glm_fit_grouped(fx.groups(spark, d), ["grp"], "price", _LI)
    return out.select("grp", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("intercept", 2), ("discount", 2), ("tax", 2), ("quantity", 3))])


@query("g3_polyglm_fit", with_sql("subj", "obs", _D, fit_sql("d", "voxel_id", ["1.0::DOUBLE", "age", "biomarker", "biomarker*biomarker"])) + "SELECT voxel_id, round(b0, 4) AS intercept, round(b1, 4) AS age, round(b2, 4) AS biomarker, round(b3, 4) AS biomarker2 FROM fit")
def g3(spark, d):
    params, _ = ft.polyglm_fit(fx.observations(spark, d), fx.subjects(spark, d), dz.with_intercept(dz.terms(["age"], CORRECTOR), CORRECTOR), {"biomarker": 2})
    return rounded(params.withColumnRenamed("biomarker^2", "biomarker2"), 4)


_TWO = with_sql("subj", "obs", _D, fit_sql("d", "voxel_id", ["1.0::DOUBLE", "age"], out="f1"), "e AS (SELECT d.voxel_id, d.biomarker, d.value - b0 - b1*age AS rest FROM d JOIN f1 USING (voxel_id))")


@query("g4_two_stage_fit", _TWO + "SELECT e.voxel_id, round(any_value(b0), 4) AS intercept, round(any_value(b1), 4) AS age, round(sum(biomarker*rest)/sum(biomarker*biomarker), 4) AS biomarker FROM e JOIN f1 USING (voxel_id) GROUP BY e.voxel_id")
def g4(spark, d):
    return rounded(ft.two_stage_fit(fx.observations(spark, d), fx.subjects(spark, d), _ABC), 4)


@query("g5_predict", _FITTED + "SELECT voxel_id, subject_id, round(predicted, 4) AS predicted FROM r")
def g5(spark, d):
    obs, subj, params = _fitted(spark, d)
    return rounded(ft.predict(obs, subj, params, BASE), 4)


@query("g6_correct", _FITTED + "SELECT voxel_id, subject_id, round(corrected, 4) AS value FROM r")
def g6(spark, d):
    obs, subj, params = _fitted(spark, d)
    return rounded(ft.correct(obs, subj, params, BASE), 4)


_GAM = "c AS (SELECT d.*, age - (SELECT avg(age) FROM subj) AS g1, biomarker - (SELECT avg(biomarker) FROM subj) AS g2, biomarker*biomarker - (SELECT avg(biomarker*biomarker) FROM subj) AS g3 FROM d)"
_GAM_FIT = with_sql("subj", "obs", _D, _GAM, fit_sql("c", "voxel_id", ["1.0::DOUBLE", "g1", "g2", "g3"]))


def _smoothers():
    return {"age": dz.poly_terms("age", 1), "biomarker": dz.poly_terms("biomarker", 2)}


@query("g7_gam_fit", _GAM_FIT + "SELECT voxel_id, round(b0, 4) AS intercept, round(b1, 4) AS age, round(b2, 4) AS biomarker, round(b3, 4) AS biomarker2 FROM fit")
def g7(spark, d):
    return rounded(ft.gam_fit(fx.observations(spark, d), fx.subjects(spark, d), _smoothers()).withColumnRenamed("biomarker^2", "biomarker2"), 4)


@query("g8_gam_splines")
def g8(spark, d):
    subj = fx.subjects(spark, d)
    out = ft.gam_fit(fx.observations(spark, d), subj, {"age": dz.bspline_basis(subj, "age", 4), "biomarker": dz.natural_cubic_basis(subj, "biomarker", 3)})
    return rounded(out.toDF("voxel_id", *[f"b{k}" for k in range(len(out.columns) - 1)]), 4)


@query("g9_gam_predict", _GAM_FIT + "SELECT voxel_id, p AS point, round(b0 + b1*(30 + p - (SELECT avg(age) FROM subj)) + b2*(p/10.0::DOUBLE - (SELECT avg(biomarker) FROM subj)) + b3*(p/10.0::DOUBLE*(p/10.0::DOUBLE) - (SELECT avg(biomarker*biomarker) FROM subj)), 4) AS predicted FROM fit, range(5) t(p)")
def g9(spark, d):
    subj = fx.subjects(spark, d)
    points = spark.range(5).selectExpr("id AS point", "30.0D + id AS age", "id / 10.0D AS biomarker")
    return rounded(ft.gam_predict(ft.gam_fit(fx.observations(spark, d), subj, _smoothers()), points, subj, _smoothers()), 4)


@query("g10_kernel_smooth", with_sql(_BAND) + "SELECT g, round(sum(exp(-pow(g - x, 2)/18) * y) / sum(exp(-pow(g - x, 2)/18)), 4) AS value FROM pts, gr GROUP BY g")
def g10(spark, d):
    pts, grid = _scatter(spark, d)
    return rounded(local.kernel_smooth(pts, "x", "y", 3.0, grid), 4)


@query("g11_kernel_df", with_sql("p AS (SELECT row_number() OVER () AS i, CAST(p_size AS DOUBLE) AS x FROM part)", "k AS (SELECT a.i, exp(-pow(a.x - b.x, 2)/18) AS w FROM p a, p b)", "s AS (SELECT i, sum(w*w)/pow(sum(w), 2) AS s FROM k GROUP BY i)") + "SELECT round(sum(s), 4) AS df FROM s")
def g11(spark, d):
    return rounded(local.kernel_df(_scatter(spark, d)[0], "x", 3.0), 4)


_S = lambda k, y="": f"sum(w*pow(dx,{k}){y})"


@query("g12_lowess", with_sql(_BAND) + f"SELECT g, round(({_S(2)}*{_S(0, '*y')} - {_S(1)}*{_S(1, '*y')}) / ({_S(0)}*{_S(2)} - {_S(1)}*{_S(1)}), 3) AS value FROM band GROUP BY g")
def g12(spark, d):
    pts, grid = _scatter(spark, d)
    return rounded(local.lowess(pts, "x", "y", 9, grid), 3)


@query("g13_loess", with_sql(_BAND, fit_sql("band", "g", ["1.0::DOUBLE", "dx", "dx*dx"], y="y", weight="w")) + "SELECT g, round(b0, 3) AS value FROM fit")
def g13(spark, d):
    pts, grid = _scatter(spark, d)
    return rounded(local.lowess(pts, "x", "y", 9, grid, degree=2), 3)


_PERCENT_BAND = _BAND.replace("(x - g)/9", "(x - g)/sp").replace("JOIN gr ON abs(x - g) <= 9", "JOIN gr ON true JOIN (SELECT 0.2*(max(x) - min(x)) AS sp FROM pts) ON abs(x - g) <= sp")


@query("g12_lowess_percent", with_sql(_PERCENT_BAND) + f"SELECT g, round(({_S(2)}*{_S(0, '*y')} - {_S(1)}*{_S(1, '*y')}) / ({_S(0)}*{_S(2)} - {_S(1)}*{_S(1)}), 3) AS value FROM band GROUP BY g")
def g12b(spark, d):
    pts, grid = _scatter(spark, d)
    return rounded(local.lowess(pts, "x", "y", 20, grid, percent=True), 3)


@query("g13_loess_percent", with_sql(_PERCENT_BAND, fit_sql("band", "g", ["1.0::DOUBLE", "dx", "dx*dx"], y="y", weight="w")) + "SELECT g, round(b0, 3) AS value FROM fit")
def g13b(spark, d):
    pts, grid = _scatter(spark, d)
    return rounded(local.lowess(pts, "x", "y", 20, grid, degree=2, percent=True), 3)


_SVR_FEATURES = ["age", "biomarker"]


def _svr(spark, d, gamma=None):
    """Observations and scaled features; the fit's results are kept, as others follow from them."""
    obs, subj = fx.observations(spark, d), fx.subjects(spark, d)
    scaled = dz.standard_scale(subj, _SVR_FEATURES).select("subject_id", *_SVR_FEATURES)
    return obs, scaled, written(svr.svr_fit(obs, subj, _SVR_FEATURES, 1.0, 0.1, gamma, groups=16))


@query("g14_poly_svr_fit")
def g14(spark, d):
    return rounded(_svr(spark, d)[2], 4)


@query("g15_poly_svr_predict")
def g15(spark, d):
    obs, scaled, alphas = _svr(spark, d)
    return rounded(svr.linear_predict(svr.linear_coefficients(alphas, scaled, _SVR_FEATURES), scaled, obs, _SVR_FEATURES), 4)


@query("g16_svr_linear_df")
def g16(spark, d):
    obs, scaled, alphas = _svr(spark, d)
    fitted = svr.linear_predict(svr.linear_coefficients(alphas, scaled, _SVR_FEATURES), scaled, obs, _SVR_FEATURES)
    rows = obs.join(fitted, ["voxel_id", "subject_id"]).join(alphas, ["voxel_id", "subject_id"]).join(scaled, "subject_id")
    k = sum((F.col(f) ** 2 for f in _SVR_FEATURES), F.lit(0.0))
    return svr.svr_df(rows.select("voxel_id", (F.col("value") - F.col("predicted")).alias("residual"), "alpha", k.alias("k")), 1.0, 0.1)


@query("g17_gaussian_svr_fit")
def g17(spark, d):
    return rounded(_svr(spark, d, 0.5)[2], 4)


@query("g18_gaussian_svr_predict")
def g18(spark, d):
    _, scaled, alphas = _svr(spark, d, 0.5)
    points = spark.range(9).selectExpr("id AS point", "id / 4.0D - 1 AS age", "0.5D AS biomarker")
    return rounded(svr.gaussian_predict(alphas, scaled, points, _SVR_FEATURES, 0.5), 4)


@query("g19_gaussian_svr_df")
def g19(spark, d):
    obs, scaled, alphas = _svr(spark, d, 0.5)
    points = scaled.withColumnRenamed("subject_id", "point")
    fitted = svr.gaussian_predict(alphas, scaled, points, _SVR_FEATURES, 0.5).withColumnRenamed("point", "subject_id")
    rows = obs.join(fitted, ["voxel_id", "subject_id"]).join(alphas, ["voxel_id", "subject_id"])
    return svr.svr_df(rows.select("voxel_id", (F.col("value") - F.col("predicted")).alias("residual"), "alpha", F.lit(1.0).alias("k")), 1.0, 0.1)


_GIVEN = "sc AS (SELECT subject_id, (age - (SELECT avg(age) FROM subj))/(SELECT stddev_pop(age) FROM subj) AS a, (biomarker - (SELECT avg(biomarker) FROM subj))/(SELECT stddev_pop(biomarker) FROM subj) AS b FROM subj), al AS (SELECT voxel_id, subject_id, value, ((subject_id*7919 + voxel_id*104729) % 21 - 10)/10.0::DOUBLE AS alpha, voxel_id/64.0::DOUBLE AS intercept FROM obs)"
_LINEAR = _GIVEN + ", co AS (SELECT voxel_id, any_value(intercept) AS c0, sum(alpha*a) AS c1, sum(alpha*b) AS c2 FROM al JOIN sc USING (subject_id) GROUP BY voxel_id), pr AS (SELECT al.*, a, b, c0 + c1*a + c2*b AS predicted FROM al JOIN sc USING (subject_id) JOIN co USING (voxel_id))"
_RADIAL = _GIVEN + ", ke AS (SELECT p.subject_id AS point, t.subject_id, exp(-0.5*(pow(p.a - t.a, 2) + pow(p.b - t.b, 2))) AS k FROM sc p, sc t), pr AS (SELECT voxel_id, point AS subject_id, sum(alpha*k) + any_value(intercept) AS predicted FROM al JOIN ke USING (subject_id) GROUP BY voxel_id, point)"


def _given(spark, d):
    """Observations, scaled features, and dual coefficients by a rule instead of a fit."""
    obs, subj = fx.observations(spark, d), fx.subjects(spark, d)
    scaled = dz.standard_scale(subj, _SVR_FEATURES).select("subject_id", *_SVR_FEATURES)
    alphas = obs.selectExpr("voxel_id", "subject_id", "((subject_id*7919 + voxel_id*104729) % 21 - 10)/10.0D AS alpha", "voxel_id/64.0D AS intercept")
    return obs, scaled, alphas


@query("g15_svr_predict_given", with_sql("subj", "obs", _LINEAR) + "SELECT voxel_id, subject_id, round(predicted, 4) AS predicted FROM pr")
def g15g(spark, d):
    obs, scaled, alphas = _given(spark, d)
    return rounded(svr.linear_predict(svr.linear_coefficients(alphas, scaled, _SVR_FEATURES), scaled, obs, _SVR_FEATURES), 4)


def _df_rows(obs, fitted, alphas, k):
    rows = obs.join(fitted, ["voxel_id", "subject_id"]).join(alphas, ["voxel_id", "subject_id"]).join(k, "subject_id")
    return rows.select("voxel_id", (F.col("value") - F.col("predicted")).alias("residual"), "alpha", "k")


@query("g16_svr_df_given", with_sql("subj", "obs", _LINEAR) + "SELECT voxel_id, count(*) FILTER (abs(value - predicted + alpha*(a*a + b*b)) BETWEEN 0.1 AND 0.1 + (a*a + b*b)) AS df FROM pr GROUP BY voxel_id")
def g16g(spark, d):
    obs, scaled, alphas = _given(spark, d)
    fitted = svr.linear_predict(svr.linear_coefficients(alphas, scaled, _SVR_FEATURES), scaled, obs, _SVR_FEATURES)
    return svr.svr_df(_df_rows(obs, fitted, alphas, scaled.select("subject_id", sum((F.col(f) ** 2 for f in _SVR_FEATURES), F.lit(0.0)).alias("k"))), 1.0, 0.1)


@query("g18_gaussian_predict_given", with_sql("subj", "obs", _RADIAL) + "SELECT voxel_id, subject_id AS point, round(predicted, 4) AS predicted FROM pr WHERE subject_id % 20 = 0")
def g18g(spark, d):
    """Predictions at the subjects whose id is divisible by 20, from all."""
    _, scaled, alphas = _given(spark, d)
    return rounded(svr.gaussian_predict(alphas, scaled, scaled.where("subject_id % 20 = 0").withColumnRenamed("subject_id", "point"), _SVR_FEATURES, 0.5), 4)


@query("g19_gaussian_df_given", with_sql("subj", "obs", _RADIAL) + "SELECT voxel_id, count(*) FILTER (abs(value - predicted + alpha) BETWEEN 0.1 AND 1.1) AS df FROM pr JOIN al USING (voxel_id, subject_id) GROUP BY voxel_id")
def g19g(spark, d):
    obs, scaled, alphas = _given(spark, d)
    fitted = svr.gaussian_predict(alphas, scaled, scaled.withColumnRenamed("subject_id", "point"), _SVR_FEATURES, 0.5).withColumnRenamed("point", "subject_id")
    return svr.svr_df(_df_rows(obs, fitted, alphas, scaled.select("subject_id", F.lit(1.0).alias("k"))), 1.0, 0.1)


@query("g14_svr_two_stage")
def g14b(spark, d):
    """Correctors first, then the predictor on what they leave."""
    return rounded(svr.svr_two_stage(fx.observations(spark, d), fx.subjects(spark, d), ["age", "sex"], ["biomarker"], 1.0, 0.1, groups=16)[1], 4)


@query("g15_svr_correct")
def g15b(spark, d):
    return rounded(svr.svr_correct(fx.observations(spark, d), fx.subjects(spark, d), ["age", "sex"], 1.0, 0.1, groups=16), 4)


@query("g18_gaussian_svr_correct")
def g18b(spark, d):
    return rounded(svr.svr_correct(fx.observations(spark, d), fx.subjects(spark, d), ["age", "sex"], 1.0, 0.1, 0.5, groups=16), 4)


_X = ["age", "sex", "biomarker"]
_PLS = with_sql("subj", "obs", _D, "c AS (SELECT d.voxel_id, d.subject_id, value, " + ", ".join(f"{f} - (SELECT avg({f}) FROM subj) AS x_{f}" for f in _X) + " FROM d)", "s AS (SELECT voxel_id, avg(value) AS mean, " + ", ".join(f"sum(x_{f}*value) AS s_{f}" for f in _X) + " FROM c GROUP BY voxel_id)", "w AS (SELECT voxel_id, mean, " + ", ".join(f"s_{f}/sqrt(s_age*s_age + s_sex*s_sex + s_biomarker*s_biomarker) AS w_{f}" for f in _X) + " FROM s)", "t AS (SELECT c.voxel_id, c.subject_id, mean, value - mean AS u, " + " + ".join(f"w_{f}*x_{f}" for f in _X) + " AS t, " + ", ".join(f"w_{f}" for f in _X) + " FROM c JOIN w USING (voxel_id))", "q AS (SELECT voxel_id, sum(t*u)/sum(t*t) AS q FROM t GROUP BY voxel_id)")


@query("g20_pls_fit", _PLS + "SELECT voxel_id, round(mean, 4) AS mean, " + ", ".join(f"round(w_{f}, 4) AS rot_0_{f}, round(w_{f}*q, 4) AS coef_{f}" for f in _X) + " FROM w JOIN q USING (voxel_id)")
def g20(spark, d):
    return rounded(pls.pls_fit(fx.observations(spark, d), fx.subjects(spark, d), _X, 1), 4).drop(*[f"at_{f}" for f in _X])


def _pls_two_sql() -> str:
    """Two components from the sums of products: the second from what the first has left."""
    quad = lambda a, b: " + ".join(f"g_{i}_{j}*{a}_{i}*{b}_{j}" for i in _X for j in _X)
    dot = lambda a, b: " + ".join(f"{a}_{f}*{b}_{f}" for f in _X)
    every = lambda text: ", ".join(text.replace("#", f) for f in _X)
    steps = [
        "gm AS (SELECT " + ", ".join(f"sum(({i} - (SELECT avg({i}) FROM subj))*({j} - (SELECT avg({j}) FROM subj))) AS g_{i}_{j}" for i in _X for j in _X) + " FROM subj)",
        "c1 AS (SELECT s.*, gm.*, " + every(f"s_#/sqrt({dot('s', 's')}) AS r_#") + " FROM s, gm)",
        f"c2 AS (SELECT *, {quad('r', 'r')} AS tr, {dot('r', 's')} AS rs FROM c1)",
        "c3 AS (SELECT *, " + ", ".join(f"s_{f} - rs/tr*({' + '.join(f'g_{f}_{j}*r_{j}' for j in _X)}) AS d_{f}" for f in _X) + " FROM c2)",
        "c4 AS (SELECT *, " + every(f"d_#/sqrt({dot('d', 'd')}) AS w_#") + " FROM c3)",
        "c5 AS (SELECT *, " + every(f"w_# - r_#*({quad('r', 'w')})/tr AS v_#") + " FROM c4)",
        f"c6 AS (SELECT *, ({dot('v', 's')})/({quad('v', 'v')}) AS q FROM c5)",
    ]
    head = _PLS[: _PLS.index(", w AS (")]
    return head + ", " + ", ".join(steps) + " SELECT voxel_id, round(mean, 4) AS mean, " + every("round(r_#, 4) + 0.0 AS rot_0_#, round(v_#, 4) + 0.0 AS rot_1_#, round(r_#*rs/tr + v_#*q, 4) + 0.0 AS coef_#") + " FROM c6"


@query("g20_pls_fit_two", _pls_two_sql())
def g20b(spark, d):
    return rounded(pls.pls_fit(fx.observations(spark, d), fx.subjects(spark, d), _X, 2), 4).drop(*[f"at_{f}" for f in _X])


def _pls(spark, d):
    obs, subj = fx.observations(spark, d), fx.subjects(spark, d)
    return obs, subj, pls.pls_fit(obs, subj, _X, 1)


@query("g21_pls_predict", _PLS + "SELECT voxel_id, subject_id, round(mean + q*t, 4) AS predicted FROM t JOIN q USING (voxel_id)")
def g21(spark, d):
    obs, subj, params = _pls(spark, d)
    return rounded(pls.pls_predict(obs, subj, _X, params), 4)


@query("g22_pls_transform", _PLS + "SELECT voxel_id, subject_id, round(t, 4) AS t_0, round(u, 4) AS u FROM t")
def g22(spark, d):
    obs, subj, params = _pls(spark, d)
    return rounded(pls.pls_transform(obs, subj, _X, params, 1), 4)


_CURVE = "ends AS (SELECT min(biomarker) AS lo, max(biomarker) AS hi FROM subj), cv AS (SELECT voxel_id, p AS point, lo + p*(hi - lo)/19 AS t, b3*(lo + p*(hi - lo)/19) + b4*pow(lo + p*(hi - lo)/19, 2) AS predicted FROM fit, ends, range(20) g(p))"
_QUAD = with_sql("subj", "obs", _D, fit_sql("d", "voxel_id", [*_TERMS, "biomarker*biomarker"]), _CURVE)


def _quadratic(spark, d):
    obs, subj = fx.observations(spark, d), fx.subjects(spark, d)
    base = Design(tuple(t for t in BASE.terms if t.role == CORRECTOR))
    params, design = ft.polyglm_fit(obs, subj, base, {"biomarker": 2})
    return obs, subj, params, design, ft.curve(spark, params, subj, "biomarker", design, 20)


@query("g23_curve", _QUAD + "SELECT voxel_id, point, round(t, 4) AS t, round(predicted, 4) AS predicted FROM cv")
def g23(spark, d):
    return rounded(_quadratic(spark, d)[4], 4)


@query("g24_two_sample_ttest", with_sql("subj", "obs", _D, "g AS (SELECT voxel_id, avg(value) AS m, " + ", ".join(f"CAST(count(*) FILTER (sex = {k}) AS DOUBLE) AS n{k}, avg(value) FILTER (sex = {k}) AS m{k}, var_samp(value) FILTER (sex = {k}) AS v{k}" for k in (0, 1)) + " FROM d GROUP BY voxel_id)") + "SELECT voxel_id, CASE WHEN m < 0 THEN 0 ELSE round((m1 - m0)/sqrt(((n0-1)*v0 + (n1-1)*v1)/(n0+n1-2)*(1/n0 + 1/n1)), 4) END AS t FROM g")
def g24(spark, d):
    groups = fx.subjects(spark, d).select("subject_id", F.col("sex").cast("int").alias("group"))
    return rounded(ft.two_sample_ttest(fx.observations(spark, d), groups, 0.0), 4)


@query("g25_fit_by_category", with_sql("subj", "obs", _D, fit_sql("d", "category, voxel_id", ["1.0::DOUBLE", "age", "biomarker"])) + "SELECT CAST(category AS BIGINT) AS category, voxel_id, round(b0, 3) AS intercept, round(b1, 3) AS age, round(b2, 3) AS biomarker FROM fit")
def g25(spark, d):
    return rounded(ft.fit_by_category(fx.observations(spark, d), fx.subjects(spark, d), _ABC), 3)


# --- scores --------------------------------------------------------------------------------------------------

_E = "(corrected - predicted)"
_RSS = f"sum({_E}*{_E})"
_METRIC_SQL = {
    "mse": f"avg({_E}*{_E})",
    "r2": f"1 - {_RSS}/(var_pop(corrected)*count(*))",
    "fstat": f"(sum(corrected*corrected) - {_RSS})/1/({_RSS}/(count(*) - 4))",
    "aic": f"2*5 + count(*)*(ln(2*pi()) + ln({_RSS}) - ln(count(*)) + 1)",
}


def _metric(name: str):
    def run(spark, d):
        return rounded(score.evaluate(*_fitted(spark, d), BASE, [name]), 4)

    return run


for _n, _key in enumerate(("mse", "r2", "fstat")):
    query(f"e{_n + 1}_{_key}", _FITTED + f"SELECT voxel_id, round({_METRIC_SQL[_key]}, 4) AS {_key} FROM r GROUP BY voxel_id")(_metric(_key))
query("e6_aic", _FITTED + f"SELECT voxel_id, round({_METRIC_SQL['aic']}, 4) AS aic FROM r GROUP BY voxel_id")(_metric("aic"))


_EVEN = "m AS (SELECT count(*) - 4 AS m FROM subj), co AS (SELECT 0 AS k, 1.0::DOUBLE AS c UNION ALL SELECT k, exp(sum(ln((2*k - 1)/(2.0::DOUBLE*k))) OVER (ORDER BY k)) AS c FROM (SELECT unnest(range(1, CAST(m//2 AS BIGINT))) AS k FROM m)), fs AS (SELECT voxel_id, (sum(corrected*corrected) - sum(pow(corrected - predicted, 2)))/(sum(pow(corrected - predicted, 2))/(count(*) - 4)) AS f FROM r GROUP BY voxel_id)"


@query("e4_ftest", _FITTED.rstrip() + ", " + _EVEN + " SELECT voxel_id, round(any_value(f), 4) AS fstat, round(sqrt(any_value(f)/(any_value(f) + any_value(m)))*sum(c*pow(any_f, k)), 4) AS ftest FROM (SELECT voxel_id, f, m, k, c, m/(m + f) AS any_f FROM fs, m, co) GROUP BY voxel_id")
def e4(spark, d):
    obs, subj, params = _fitted(spark, d)
    return rounded(score.ftest(score.evaluate(obs, subj, params, BASE, ["fstat"]), 1, subj.count() - 4), 4)


_INV = "g AS (SELECT 1 AS one, " + ", ".join(f"sum(({a})*({b})) AS a_{i}_{j}" for i, a in enumerate(_TERMS) for j, b in enumerate(_TERMS)) + ", " + ", ".join(f"{1 if i == 3 else 0}.0::DOUBLE AS b_{i}" for i in range(4)) + " FROM subj)"


@query("e5_tstat", with_sql("subj", "obs", _D, _FIT, _R, _INV, fx.gauss("g", "one", 4, "inv")) + f"SELECT voxel_id, round(any_value(r.b3)/sqrt({_RSS}/(count(*) - 1) * (SELECT b3 FROM inv)), 4) AS tstat FROM r GROUP BY voxel_id")
def e5(spark, d):
    obs, subj, params = _fitted(spark, d)
    return rounded(score.tstat(obs, subj, params, BASE, "biomarker"), 4)


_ROUGH = _QUAD.rstrip() + ", dd AS (SELECT *, predicted - 2*lag(predicted) OVER (PARTITION BY voxel_id ORDER BY point) + lag(predicted, 2) OVER (PARTITION BY voxel_id ORDER BY point) AS second FROM cv), ro AS (SELECT voxel_id, sum(second*second)/pow((max(t) - min(t))/19, 4) AS rough, var_pop(predicted) AS spread FROM dd GROUP BY voxel_id), ms AS (SELECT voxel_id, avg(pow(value - (b0 + b1*age + b2*sex) - b3*biomarker - b4*biomarker*biomarker, 2)) AS mse FROM d JOIN fit USING (voxel_id) GROUP BY voxel_id) "


def _penalised(spark, d):
    obs, subj, params, design, curves = _quadratic(spark, d)
    return score.prss(score.evaluate(obs, subj, params, design, ["mse"]), curves, 1e-3)


@query("e7_prss", _ROUGH + "SELECT voxel_id, round(mse + 1e-3*rough, 3) AS prss FROM ms JOIN ro USING (voxel_id)")
def e7(spark, d):
    return rounded(_penalised(spark, d).select("voxel_id", "prss"), 3)


@query("e8_vnprss", _ROUGH + "SELECT voxel_id, round(1/((mse + 1e-3*rough)/spread), 4) AS inverse FROM ms JOIN ro USING (voxel_id)")
def e8(spark, d):
    return rounded(_penalised(spark, d).select("voxel_id", (1 / F.col("vnprss")).alias("inverse")), 4)


@query("e9_model_df", with_sql("subj") + "SELECT CAST(category AS BIGINT) AS category, 4.0::DOUBLE AS glm, 1.0::DOUBLE AS pls, 3.0::DOUBLE AS polynomial FROM subj GROUP BY category")
def e9(spark, d):
    return fx.subjects(spark, d).select(F.col("category").cast("long")).distinct().select("category", F.lit(score.model_df("glm", columns=len(BASE))).alias("glm"), F.lit(score.model_df("pls", components=1)).alias("pls"), F.lit(score.model_df("polynomial", degree=2)).alias("polynomial"))


_DF_KERNEL = "k AS (SELECT a.subject_id, exp(-pow(a.age - b.age, 2)/18) AS w FROM subj a, subj b), ks AS (SELECT subject_id, sum(w*w)/pow(sum(w), 2) AS s FROM k GROUP BY subject_id)"


@query("e9_fitted_df", with_sql("subj", "obs", _RADIAL, _DF_KERNEL) + "SELECT 'gaussian_svr' AS kind, voxel_id, CAST(count(*) FILTER (abs(value - predicted + alpha) BETWEEN 0.1 AND 1.1) AS DOUBLE) AS df FROM pr JOIN al USING (voxel_id, subject_id) GROUP BY voxel_id UNION ALL SELECT 'kernel', voxel_id, (SELECT round(sum(s), 4) FROM ks) FROM obs GROUP BY voxel_id UNION ALL SELECT 'polynomial', voxel_id, 3.0::DOUBLE FROM obs GROUP BY voxel_id")
def e9f(spark, d):
    """Degrees of freedom of fits of three kinds."""
    obs, scaled, alphas = _given(spark, d)
    fitted = svr.gaussian_predict(alphas, scaled, scaled.withColumnRenamed("subject_id", "point"), _SVR_FEATURES, 0.5).withColumnRenamed("point", "subject_id")
    rows = _df_rows(obs, fitted, alphas, scaled.select("subject_id", F.lit(1.0).alias("k")))
    whole = obs.join(fx.subjects(spark, d), "subject_id")
    parts = [score.fitted_df("gaussian_svr", rows, c=1.0, epsilon=0.1), score.fitted_df("kernel", whole, x="age", sigma=3.0), score.fitted_df("polynomial", whole, degree=2)]
    return rounded(reduce(DataFrame.unionByName, [p.select(F.lit(kind).alias("kind"), "voxel_id", "df") for kind, p in zip(("gaussian_svr", "kernel", "polynomial"), parts)]), 4)


@query("e10_evaluate_fit", _FITTED + f"SELECT voxel_id, CASE WHEN avg(value) < 0 THEN 0 ELSE round({_METRIC_SQL['fstat']}, 4) END AS value FROM r GROUP BY voxel_id")
def e10(spark, d):
    return rounded(score.evaluate_fit(*_fitted(spark, d), BASE, "fstat", threshold=0.0), 4)


@query("e11_registered_metric", _FITTED + f"SELECT voxel_id, round(avg(abs{_E}), 4) AS mae, round(sqrt(avg({_E}*{_E})), 4) AS rmse FROM r GROUP BY voxel_id")
def e11(spark, d):
    score.register_metric("mae", lambda q: F.avg(F.abs(q["corrected"] - q["predicted"])))
    score.register_metric("rmse", lambda q: F.sqrt(score.METRICS["mse"](q)))
    return rounded(score.evaluate(*_fitted(spark, d), BASE, ["mae", "rmse"]), 4)


_Z = 1.959963984540054  # the normal law's quantile at 0.975
_T = " + ".join(f"{c!r}::DOUBLE/pow(n - 2, {k})" for k, c in enumerate((_Z, (_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384)))
_INTERVAL = with_sql("subj", "obs", _D, fit_sql("d", "voxel_id", ["1.0::DOUBLE", "biomarker"]), "rs AS (SELECT voxel_id, sum(pow(value - b0 - b1*biomarker, 2)) AS rss, CAST(count(*) AS DOUBLE) AS n, any_value(b0) AS b0, any_value(b1) AS b1 FROM d JOIN fit USING (voxel_id) GROUP BY voxel_id)", f"iv AS (SELECT voxel_id, p AS point, b0 + b1*p/5 AS predicted, {_T} AS t, sqrt(rss/(n-2)*(1/n + pow(p/5.0::DOUBLE - (SELECT avg(biomarker) FROM subj), 2)/(SELECT var_pop(biomarker)*count(*) FROM subj))) AS se FROM rs, range(6) t(p))")


@query("e12_curve_interval", _INTERVAL + "SELECT voxel_id, point, round(predicted, 4) AS predicted, round(se, 4) AS se, round(predicted - t*se, 4) AS low, round(predicted + t*se, 4) AS high FROM iv")
def e12(spark, d):
    obs, subj = fx.observations(spark, d), fx.subjects(spark, d)
    points = spark.range(6).selectExpr("id AS point", "id / 5.0D AS biomarker")
    return rounded(score.curve_interval(spark, obs, subj, ft.glm_fit(obs, subj, _LINE), _LINE, points), 4)


# --- windows -------------------------------------------------------------------------------------------------


@query("w1_differences", _QUAD + "SELECT voxel_id, point, round(predicted - lag(predicted) OVER w, 4) AS first, round(predicted - 2*lag(predicted) OVER w + lag(predicted, 2) OVER w, 4) AS second FROM cv WINDOW w AS (PARTITION BY voxel_id ORDER BY point)")
def w1(spark, d):
    return rounded(windows.differences(_quadratic(spark, d)[4]).select("voxel_id", "point", "first", "second"), 4)


@query("w2_sorted_values", with_sql("subj", "a AS (SELECT row_number() OVER (ORDER BY age) AS rank, age FROM subj)", "b AS (SELECT row_number() OVER (ORDER BY biomarker) AS rank, biomarker FROM subj)") + "SELECT rank, age, round(biomarker, 6) AS biomarker FROM a JOIN b USING (rank)")
def w2(spark, d):
    return rounded(windows.sorted_values(fx.subjects(spark, d), ["age", "biomarker"]))


@query("w3_order_statistic", with_sql("grid", "maps") + "SELECT round(b, 6) AS threshold FROM (SELECT b, row_number() OVER (ORDER BY b) AS n FROM maps) WHERE n = (SELECT CAST(ceil(0.05*count(*)) AS BIGINT) FROM maps)")
def w3(spark, d):
    return rounded(windows.order_statistic(fx.maps(spark, d)[1], 0.05))


@query("w4_numbered_groups", with_sql("grid") + "SELECT CAST(value*50 AS BIGINT) AS size, row_number() OVER (ORDER BY min(voxel_id)) AS number FROM grid GROUP BY 1")
def w4(spark, d):
    g = fx.grid_map(spark, d).select(F.round(F.col("value") * 50).cast("long").alias("size"), "voxel_id")
    return windows.numbered_groups(g, "size", "voxel_id")


# --- maps ----------------------------------------------------------------------------------------------------


@query("m1_p_to_z")
def m1(spark, d):
    b = fx.maps(spark, d)[1]
    return rounded(maps.p_to_z(b.withColumn("value", F.when(F.col("value") >= 0.95, F.col("value")).otherwise(F.lit(0.0))), 0.05), 4)


def _cc_sql(lower: str, min_size: int) -> str:
    """Clusters by a recursive search from every voxel."""
    return with_sql("grid", f"kept AS (SELECT * FROM grid WHERE value >= {lower})", "e AS (SELECT a.voxel_id AS a, b.voxel_id AS b FROM kept a JOIN kept b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.z-b.z) <= 1)", "reach AS (SELECT voxel_id AS a, voxel_id AS b FROM kept UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)", "comp AS (SELECT a AS voxel_id, min(b) AS component FROM reach GROUP BY a)", f"big AS (SELECT component, row_number() OVER (ORDER BY component) AS label FROM comp GROUP BY component HAVING count(*) >= {min_size})")


@query("m2_threshold_clusters")
def m2(spark, d):
    return rounded(maps.threshold_clusters(fx.grid_map(spark, d), [0.05, 0.08], 3), 4)


_LABELS = "SELECT {p}::DOUBLE AS p, g.voxel_id, coalesce(label, 0) AS label FROM grid g LEFT JOIN comp USING (voxel_id) LEFT JOIN big USING (component)"


@query("m2_threshold_labels", f"SELECT * FROM ({_cc_sql('0.95', 3)}{_LABELS.format(p=0.05)}) UNION ALL SELECT * FROM ({_cc_sql('0.92', 3)}{_LABELS.format(p=0.08)})")
def m2b(spark, d):
    return maps.threshold_clusters(fx.grid_map(spark, d), [0.05, 0.08], 3).select("p", "voxel_id", "label")


@query("m3_invert_best_fraction", with_sql("grid", "maps", "t AS (SELECT b AS t FROM (SELECT b, row_number() OVER (ORDER BY b) AS n FROM maps) WHERE n = (SELECT CAST(ceil(0.1*count(*)) AS BIGINT) FROM maps))") + "SELECT voxel_id, CASE WHEN b <= t THEN round(t - b, 6) ELSE 0 END AS value FROM maps, t")
def m3(spark, d):
    return rounded(maps.invert_best_fraction(fx.maps(spark, d)[1], 0.1))


@query("m4_aic_rescale", with_sql("grid", "maps", "s AS (SELECT min(abs(c)) AS lo, max(abs(c)) AS hi, avg(abs(c)) AS mean FROM maps WHERE c <> 0)") + "SELECT voxel_id, CASE WHEN c <> 0 AND abs(c) >= mean THEN round((abs(c) - lo)/(hi - lo), 6) ELSE 0 END AS value FROM maps, s")
def m4(spark, d):
    return rounded(maps.aic_rescale(fx.maps(spark, d)[2]))


@query("m5_best_fit", with_sql("grid", "maps") + "SELECT voxel_id, round(greatest(a, b, c), 6) AS value, CAST(CASE WHEN a <= 0 AND greatest(a, b, c) <= a THEN 0 WHEN a = greatest(a, b, c) THEN 1 WHEN b = greatest(a, b, c) THEN 2 ELSE 3 END AS BIGINT) AS label FROM maps")
def m5(spark, d):
    return rounded(maps.best_fit(fx.maps(spark, d)))


@query("m6_rgb", with_sql("grid", "maps") + "SELECT voxel_id, round(b, 6) AS r, round(c, 6) AS g, 0.0::DOUBLE AS b, greatest(b, c) > 0 AS mask FROM maps")
def m6(spark, d):
    return rounded(maps.rgb(fx.maps(spark, d)[1:]))


@query("m7_abs_diff", with_sql("grid", "maps") + "SELECT voxel_id, round(abs(a - b), 6) AS value FROM maps")
def m7(spark, d):
    return rounded(maps.abs_diff(*fx.maps(spark, d)[:2]))


@query("m8_squared_error", with_sql("grid", "maps") + "SELECT voxel_id, round((a - b)*(a - b), 6) AS value FROM maps")
def m8(spark, d):
    return rounded(maps.squared_error(*fx.maps(spark, d)[:2]))


@query("m9_same_data", with_sql("grid", "maps") + "SELECT bool_and(abs(a - b) <= 1e-8 + 1e-5*abs(b)) AS same, round(max(abs(a - b)), 6) AS max_difference FROM maps")
def m9(spark, d):
    return rounded(maps.same_data(*fx.maps(spark, d)[:2]))


@query("m10_roi_summary", with_sql("grid") + "SELECT n_name AS roi_name, count(*) AS n, round(avg(value), 6) AS mean FROM grid LEFT JOIN nation ON n_nationkey = voxel_id % 27 GROUP BY 1")
def m10(spark, d):
    return rounded(maps.roi_summary(*_atlas(spark, d)))


# --- graphs --------------------------------------------------------------------------------------------------


@query("c1_clusterize", _cc_sql("0.92", 3) + "SELECT g.voxel_id, CASE WHEN label IS NOT NULL THEN round(value, 6) ELSE 0 END AS value, coalesce(label, 0) AS label FROM grid g LEFT JOIN comp USING (voxel_id) LEFT JOIN big USING (component)")
def c1(spark, d):
    return rounded(maps.clusterize(fx.grid_map(spark, d), lower=0.92, min_size=3))


_SEQUENCES = "w AS (SELECT o_orderkey AS node, o_custkey, min(o_orderkey) OVER s AS least, count(*) OVER s AS n FROM orders WINDOW s AS (PARTITION BY o_custkey, (o_orderkey // 4) % 3))"


@query("c2_connected_components", with_sql(_SEQUENCES) + "SELECT node, least AS component FROM w WHERE n > 1")
def c2(spark, d):
    return graph.components(fx.edges(spark, d, False))


@query("c3_strong_components", with_sql(_SEQUENCES) + "SELECT node, CASE WHEN o_custkey % 2 = 0 THEN least ELSE node END AS component FROM w WHERE n > 1 OR o_custkey % 2 = 0")
def c3(spark, d):
    return graph.strong_components(fx.edges(spark, d, True))


# --- latent models -------------------------------------------------------------------------------------------

_STRENGTH = "sum(t*u)/(count(*) - 1)/(stddev_pop(t)*stddev_pop(u))"


@query("l1_effect_strength", _PLS + f"SELECT voxel_id, round({_STRENGTH}, 5) AS strength FROM t GROUP BY voxel_id")
def l1(spark, d):
    obs, subj, params = _pls(spark, d)
    return rounded(pls.effect_strength(pls.pls_transform(obs, subj, _X, params, 1), 0), 5)


_PERMUTED = with_sql("subj", "obs", _PERM.format(n=20), "x AS (SELECT subject_id, age - (SELECT avg(age) FROM subj) AS x1, biomarker - (SELECT avg(biomarker) FROM subj) AS x2 FROM subj)", "xx AS (SELECT sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, CAST(count(*) AS DOUBLE) AS n FROM x)", "pall AS (SELECT 0 AS perm_id, subject_id, subject_id AS source FROM subj UNION ALL SELECT * FROM perm)", "s AS (SELECT perm_id, voxel_id, stddev_pop(value) AS sd, sum(x1*value) AS s1, sum(x2*value) AS s2 FROM obs JOIN pall ON obs.subject_id = pall.source JOIN x ON x.subject_id = pall.subject_id GROUP BY perm_id, voxel_id)", "st AS (SELECT perm_id, voxel_id, (s1*s1 + s2*s2)/(n - 1)/(sqrt((s1*s1*a + 2*s1*s2*b + s2*s2*c)/n)*sd) AS strength FROM s, xx)")


@query("l2_permutation_p", _PERMUTED + "SELECT b.voxel_id, round(a.strength, 5) AS strength, round(avg(CASE WHEN b.strength > a.strength THEN 1.0 ELSE 0.0 END), 4) AS p FROM st a JOIN st b ON a.voxel_id = b.voxel_id AND a.perm_id = 0 AND b.perm_id > 0 GROUP BY b.voxel_id, a.strength")
def l2(spark, d):
    out = pls.permutation_p(fx.observations(spark, d), fx.subjects(spark, d), ["age", "biomarker"], 20)
    return out.select("voxel_id", F.round("strength", 5).alias("strength"), F.round("p", 4).alias("p"))


def _two_components_sql() -> str:
    """Effects of two components in every permutation, from X'y and X'X: the second of what the first has left."""
    head = _PERMUTED[: _PERMUTED.index(", st AS (")]
    steps = [
        "k1 AS (SELECT *, sqrt(s1*s1 + s2*s2) AS w FROM s, xx)",
        "k2 AS (SELECT *, s1/w AS r1, s2/w AS r2 FROM k1)",
        "k3 AS (SELECT *, r1*r1*a + 2*r1*r2*b + r2*r2*c AS tt, r1*s1 + r2*s2 AS tu FROM k2)",
        "k4 AS (SELECT *, s1 - tu/tt*(a*r1 + b*r2) AS d1, s2 - tu/tt*(b*r1 + c*r2) AS d2 FROM k3)",
        "k5 AS (SELECT *, d1/sqrt(d1*d1 + d2*d2) AS u1, d2/sqrt(d1*d1 + d2*d2) AS u2 FROM k4)",
        "k6 AS (SELECT *, u1 - r1*(a*r1*u1 + b*(r1*u2 + r2*u1) + c*r2*u2)/tt AS v1, u2 - r2*(a*r1*u1 + b*(r1*u2 + r2*u1) + c*r2*u2)/tt AS v2 FROM k5)",
        "st AS (SELECT perm_id, voxel_id, 0 AS component, tu/(n - 1)/(sqrt(tt/n)*sd) AS strength FROM k6 UNION ALL SELECT perm_id, voxel_id, 1, (v1*s1 + v2*s2)/(n - 1)/(sqrt((v1*v1*a + 2*v1*v2*b + v2*v2*c)/n)*sd) FROM k6)",
    ]
    return head + ", " + ", ".join(steps) + " SELECT b.voxel_id, CAST(b.component AS BIGINT) AS component, round(a.strength, 5) AS strength, round(avg(CASE WHEN b.strength > a.strength*(1 + sign(a.strength)*1e-12) THEN 1.0 ELSE 0.0 END), 4) AS p FROM st a JOIN st b ON a.voxel_id = b.voxel_id AND a.component = b.component AND a.perm_id = 0 AND b.perm_id > 0 GROUP BY b.voxel_id, b.component, a.strength"


@query("l2_permutation_p_two", _two_components_sql())
def l2b(spark, d):
    out = pls.permutation_p(fx.observations(spark, d), fx.subjects(spark, d), ["age", "biomarker"], 20, components=2)
    return rounded(out, 5).withColumn("p", F.round("p", 4))


@query("l3_effect_type", _PLS + " UNION ALL ".join(f"SELECT voxel_id, '{f}' AS predictor, round(w_{f}, 4) AS rotation FROM w" for f in _X))
def l3(spark, d):
    return rounded(pls.effect_type(_pls(spark, d)[2], 0, _X), 4)


@query("l4_cluster_effect_type")
def l4(spark, d):
    params = _pls(spark, d)[2]
    return pls.cluster_effect_type(params.select("voxel_id", *[f"rot_0_{f}" for f in _X]), 3)


_DRAWN = _PERMUTED.rstrip() + ", pv AS (SELECT b.voxel_id, a.strength, avg(CASE WHEN b.strength > a.strength THEN 1.0 ELSE 0.0 END) AS p FROM st a JOIN st b ON a.voxel_id = b.voxel_id AND a.perm_id = 0 AND b.perm_id > 0 GROUP BY b.voxel_id, a.strength), mv AS (SELECT voxel_id, avg(value) AS mean FROM obs GROUP BY voxel_id) "


@query("l5_evaluate_latent", _DRAWN + "SELECT voxel_id, CASE WHEN mean < 0 THEN 0 ELSE round(strength, 5) END AS strength, CASE WHEN mean < 0 THEN 1 ELSE round(p, 4) END AS p, CASE WHEN mean < 0 THEN 0 ELSE round(s1/sqrt(s1*s1 + s2*s2), 4) + 0.0 END AS rot_age, CASE WHEN mean < 0 THEN 0 ELSE round(s2/sqrt(s1*s1 + s2*s2), 4) + 0.0 END AS rot_biomarker FROM pv JOIN mv USING (voxel_id) JOIN (SELECT voxel_id, s1, s2 FROM s WHERE perm_id = 0) USING (voxel_id)")
def l5(spark, d):
    out = pls.evaluate_latent(fx.observations(spark, d), fx.subjects(spark, d), ["age", "biomarker"], 20, 0.0)
    return out.select("voxel_id", F.round("strength", 5).alias("strength"), F.round("p", 4).alias("p"), *[(F.round(f"rot_{f}", 4) + 0.0).alias(f"rot_{f}") for f in ("age", "biomarker")])


# --- search --------------------------------------------------------------------------------------------------

_SAMPLE = "v{i} AS (SELECT voxel_id, var_pop(value) AS variance FROM obs WHERE x >= 0 GROUP BY voxel_id HAVING var_pop(value) > 0.001 ORDER BY ((voxel_id + 1)*7919 + {i}*104729) % 100003, voxel_id LIMIT 10)"


@query("h1_sample_voxels", with_sql("obs", _SAMPLE.format(i=1)) + "SELECT voxel_id, round(variance, 6) AS variance FROM v1")
def h1(spark, d):
    return rounded(search.sample_voxels(fx.observations(spark, d), 10, 0.001, seed=1))


@query("h1_sample_in_box", with_sql("obs") + "SELECT voxel_id, round(var_pop(value), 6) AS variance FROM obs WHERE x < 3 AND y >= 1 AND y < 3 AND z >= 1 GROUP BY voxel_id HAVING var_pop(value) > 0.001 ORDER BY ((voxel_id + 1)*7919 + 104729) % 100003, voxel_id LIMIT 8")
def h1b(spark, d):
    return rounded(search.sample_voxels(fx.observations(spark, d), 8, 0.001, seed=1, box={"x": (None, 3), "y": (1, 3), "z": (1, None)}))


@query("h2_param_grid", "SELECT CAST(a AS DOUBLE) AS degree, CAST(b AS DOUBLE) / 10 AS gamma, a*3 + b - 3 AS combination, n FROM range(1, 3) t(a), range(3) u(b), (SELECT count(*) AS n FROM supplier)")
def h2(spark, d):
    n = fx.read(spark, d, "supplier").agg(F.count("*").alias("n"))
    return search.param_grid(spark, {"degree": [1, 2], "gamma": [0, 0.1, 0.2]}).crossJoin(F.broadcast(n))


@query("h2_param_grid_of_data", with_sql("subj") + "SELECT CAST(a AS DOUBLE) AS degree, g AS gamma, (a - 1)*3 + r - 1 AS combination FROM range(1, 3) t(a), (SELECT row_number() OVER (ORDER BY g) AS r, g FROM (SELECT unnest([round(min(biomarker), 6), round(avg(biomarker), 6), round(max(biomarker), 6)]) AS g FROM subj))")
def h2b(spark, d):
    """Values between the ends of a feature."""
    row = fx.subjects(spark, d).agg(*[F.round(f("biomarker"), 6) for f in (F.min, F.avg, F.max)]).first()
    return search.param_grid(spark, {"degree": [1, 2], "gamma": list(row)})


_ERR = _FITTED.rstrip() + f", er AS (SELECT voxel_id, value, {_E} AS error FROM r) "


def _errors(spark, d):
    return ft.joined(*_fitted(spark, d), BASE).select("voxel_id", "value", (F.col("corrected") - F.col("predicted")).alias("error"))


@query("h3_mse_score", _ERR + "SELECT voxel_id, round(avg(error*error), 4) AS score FROM er GROUP BY voxel_id")
def h3(spark, d):
    return rounded(search.mse_score(_errors(spark, d), ["voxel_id"]), 4)


@query("h4_cp_score", _ERR + "SELECT voxel_id, round(avg(error*error) + 2*4*(SELECT sum(error*error)/count(*) FROM er)/count(*), 4) AS score FROM er GROUP BY voxel_id")
def h4(spark, d):
    return rounded(search.cp_score(_errors(spark, d), ["voxel_id"], 4.0), 4)


@query("h5_anova_statistic", _ERR + "SELECT voxel_id, round(((var_pop(value) - var_pop(error))*count(*)/3 + 1e-12)/(var_pop(error)*count(*)/(count(*) - 4) + 1e-12), 4) AS f FROM er GROUP BY voxel_id")
def h5(spark, d):
    return rounded(search.anova_statistic(_errors(spark, d), ["voxel_id"], 3.0), 4)


@query("h5_anova_score")
def h5s(spark, d):
    return rounded(search.anova_score(_errors(spark, d), ["voxel_id"], 3.0, fx.subjects(spark, d).count()), 4)


def _search_sql() -> str:
    """Errors of polynomial degrees 1 to 3 over two iterations of sampled variables."""
    terms = ["1.0::DOUBLE", "biomarker", "biomarker*biomarker", "biomarker*biomarker*biomarker"]
    fits = [fit_sql("d", "voxel_id", terms[: k + 1], out=f"p{k}") for k in (1, 2, 3)]
    scores = [f"e{k} AS (SELECT voxel_id, avg(pow(value - ({' + '.join(f'b{j}*{t}' for j, t in enumerate(terms[: k + 1]))}), 2)) AS score FROM d JOIN p{k} USING (voxel_id) GROUP BY voxel_id)" for k in (1, 2, 3)]
    sums = " UNION ALL ".join(f"SELECT {i} AS iteration, {k} AS combination, sum(score/variance) AS error FROM e{k} JOIN v{i} USING (voxel_id)" for i in (1, 2) for k in (1, 2, 3))
    return with_sql("subj", "obs", _D, *fits, *scores, _SAMPLE.format(i=1), _SAMPLE.format(i=2), f"es AS ({sums})")


def _searched(spark, d):
    subj = fx.subjects(spark, d)
    return search.grid_search(fx.observations(spark, d), 2, 10, 0.001, lambda sampled: search.polynomial_errors(sampled, subj, "biomarker", (1, 2, 3)))


@query("h6_svr_grid_search")
def h6s(spark, d):
    """Eight combinations of C, epsilon and gamma over sampled variables of an inner box."""
    subj = fx.subjects(spark, d)
    grid = search.param_grid(spark, {"c": [0.5, 2.0], "epsilon": [0.05, 0.2], "gamma": [0.2, 1.0]})
    box = {"x": (0, 3), "y": (1, 3), "z": (1, None)}
    return rounded(search.grid_search(fx.observations(spark, d), 2, 4, 0.001, lambda sampled: svr.grid_errors(sampled, subj, _SVR_FEATURES, grid, groups=4), box), 4)


@query("h6_grid_search", _search_sql() + "SELECT CAST(iteration AS BIGINT) AS iteration, CAST(combination AS BIGINT) AS combination, round(error, 4) AS error FROM es")
def h6(spark, d):
    return rounded(_searched(spark, d), 4)


def _cp_sql() -> str:
    head = _search_sql()
    head = head[: head.index(", es AS (")]
    terms = ["1.0::DOUBLE", "biomarker", "biomarker*biomarker", "biomarker*biomarker*biomarker"]
    own = [f"q{k} AS (SELECT voxel_id, {k} AS combination, count(*) AS n, avg(e*e) AS mse, var_pop(e)*count(*)/(count(*) - 1) AS s FROM (SELECT voxel_id, value - ({' + '.join(f'b{j}*{t}' for j, t in enumerate(terms[: k + 1]))}) AS e FROM d JOIN p{k} USING (voxel_id)) GROUP BY voxel_id)" for k in (1, 2, 3)]
    rows = " UNION ALL ".join(f"SELECT {i} AS iteration, q{k}.*, variance FROM q{k} JOIN v{i} USING (voxel_id)" for i in (1, 2) for k in (1, 2, 3))
    return head + ", " + ", ".join(own) + f", ro AS ({rows}) SELECT CAST(iteration AS BIGINT) AS iteration, CAST(combination AS BIGINT) AS combination, round(sum(mse/variance) + sum(s)*sum(2.0::DOUBLE*(combination + 1)/n/variance), 4) AS error FROM ro GROUP BY 1, 2"


@query("h6_grid_search_cp", _cp_sql())
def h6c(spark, d):
    subj = fx.subjects(spark, d)
    return rounded(search.grid_search(fx.observations(spark, d), 2, 10, 0.001, lambda sampled: search.polynomial_errors(sampled, subj, "biomarker", (1, 2, 3)), score="cp"), 4)


@query("h6_grid_search_anova")
def h6a(spark, d):
    subj = fx.subjects(spark, d)
    return rounded(search.grid_search(fx.observations(spark, d), 2, 10, 0.001, lambda sampled: search.polynomial_errors(sampled, subj, "biomarker", (1, 2, 3)), score="anova"), 4)


@query("h6_best", _search_sql() + "SELECT CAST(combination AS BIGINT) AS combination, CAST(iteration AS BIGINT) AS iteration, round(error, 4) AS error FROM es ORDER BY error LIMIT 1")
def h6b(spark, d):
    return rounded(search.best(_searched(spark, d)), 4)


@query("h7_error_surface", _search_sql() + "SELECT CAST(combination AS BIGINT) AS combination, round(avg(error), 4) AS error FROM es GROUP BY 1")
def h7(spark, d):
    return rounded(search.error_surface(_searched(spark, d)), 4)


# --- summaries -----------------------------------------------------------------------------------------------


@query("x1_histogram", with_sql("li") + "SELECT CASE WHEN quantity < 0 THEN 0 WHEN quantity >= 50 THEN 11 ELSE CAST(floor(quantity/5) AS BIGINT) + 1 END AS bin, count(*) AS n FROM li GROUP BY 1")
def x1(spark, d):
    return summary.histogram(fx.groups(spark, d), "quantity", 0.0, 50.0, 10)


@query("x1_density", with_sql("li") + "SELECT CAST(g*5 AS DOUBLE) AS g, round(avg(exp(-pow(g*5 - quantity, 2)/8)/(2*sqrt(2*pi()))), 6) AS density FROM li, range(11) t(g) GROUP BY 1")
def x1d(spark, d):
    return rounded(summary.density(fx.groups(spark, d), "quantity", spark.range(11).selectExpr("CAST(id*5 AS DOUBLE) AS g"), 2.0))


@query("x2_density2d", with_sql("li") + "SELECT CAST(a*10 AS DOUBLE) AS gx, CAST(b AS DOUBLE)/50 AS gy, round(avg(exp(-pow(a*10 - quantity, 2)/8 - pow(b/50.0::DOUBLE - discount, 2)/(2*0.02*0.02))/(2*pi()*2*0.02)), 5) AS density FROM li, range(6) t(a), range(6) u(b) GROUP BY 1, 2")
def x2(spark, d):
    grid = spark.range(36).selectExpr("CAST(id div 6 * 10 AS DOUBLE) AS gx", "CAST(id % 6 AS DOUBLE)/50 AS gy")
    return rounded(summary.density2d(fx.groups(spark, d), "quantity", "discount", grid, 2.0, 0.02), 5)


def _box_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    return with_sql("li", f"q AS (SELECT {keys}quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3 FROM li {'GROUP BY ' + by if by else ''})") + f"SELECT {keys}round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(price) FILTER (price BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)), 4) AS low, round(max(price) FILTER (price BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)), 4) AS high, count(*) FILTER (price NOT BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS outliers FROM li {'JOIN q USING (' + by + ')' if by else ', q'} GROUP BY {keys}q1, median, q3"


@query("x3_box_stats", _box_sql(""))
def x3(spark, d):
    return rounded(summary.box_stats(fx.groups(spark, d), "price"), 4)


@query("x4_box_stats_by_category", _box_sql("flag"))
def x4(spark, d):
    return rounded(summary.box_stats(fx.groups(spark, d), "price", ["flag"]), 4)


@query("x5_partial_residual", _FITTED + "SELECT r.voxel_id, r.subject_id, round(r.value - (b0 + b2*r.sex + fit.b3*r.biomarker), 4) AS value FROM r JOIN fit USING (voxel_id)")
def x5(spark, d):
    obs, subj, params = _fitted(spark, d)
    other = Design(tuple(Term(t.name, t.sql, PREDICTOR if t.name == "age" else CORRECTOR) for t in BASE.terms))
    return rounded(ft.correct(obs, subj, params, other), 4)
