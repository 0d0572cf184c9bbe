"""Tables for the queries, derived from the given ones by Spark, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramian.sources.volumes import explode_volume


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS subject_id", "label AS category", "CAST(20 + (vec_id*7919) % 60 AS DOUBLE) AS age", "CAST(vec_id % 2 AS DOUBLE) AS sex", "CAST(label AS DOUBLE)/10 + CAST((vec_id*104729) % 1000 AS DOUBLE)/5000 AS biomarker")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_volume(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS grp", "CAST(l_extendedprice AS DOUBLE) AS price", "CAST(l_quantity AS DOUBLE) AS quantity", "CAST(l_discount AS DOUBLE) AS discount", "CAST(l_tax AS DOUBLE) AS tax", "l_returnflag AS flag")


def grid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS voxel_id", "p_partkey div 100 AS x", "(p_partkey div 10) % 10 AS y", "p_partkey % 10 AS z", "p_size/50.0D AS value")


def maps(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    g = grid_map(spark, sf_dir).select("voxel_id", "value")
    return [g, g.selectExpr("voxel_id", "((voxel_id*7919)%1000)/1000.0D AS value"), g.selectExpr("voxel_id", "((voxel_id*104729)%1000)/1000.0D - 0.2D AS value")]


def edges(spark: SparkSession, sf_dir: str, closed: bool) -> DataFrame:
    """Orders of one customer, dealt into three sequences, each linked to the next one; ``closed``: with even customers the last to the first."""
    sequence = Window.partitionBy("o_custkey", F.pmod(F.expr("o_orderkey div 4"), F.lit(3))).orderBy("o_orderkey")
    first = F.min("o_orderkey").over(sequence.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.when(F.col("o_custkey") % 2 == 0, first) if closed else F.lit(None)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.coalesce(F.lead("o_orderkey").over(sequence), last).alias("dst"))


#: The same tables as SQL.
SQL = {
    "subj": "subj AS (SELECT vec_id AS subject_id, label AS category, CAST(20 + (vec_id*7919) % 60 AS DOUBLE) AS age, CAST(vec_id % 2 AS DOUBLE) AS sex, CAST(label AS DOUBLE)/10 + CAST((vec_id*104729) % 1000 AS DOUBLE)/5000 AS biomarker FROM embeddings)",
    "obs": "obs AS (SELECT vec_id AS subject_id, v AS voxel_id, v//16 AS x, (v//4)%4 AS y, v%4 AS z, CAST(embedding[v+1] AS DOUBLE) AS value FROM embeddings, range(64) t(v))",
    "li": "li AS (SELECT l_suppkey AS grp, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, l_returnflag AS flag FROM lineitem)",
    "grid": "grid AS (SELECT p_partkey AS voxel_id, p_partkey//100 AS x, (p_partkey//10)%10 AS y, p_partkey%10 AS z, p_size/50.0::DOUBLE AS value FROM part)",
    "maps": "maps AS (SELECT voxel_id, value AS a, ((voxel_id*7919)%1000)/1000.0::DOUBLE AS b, ((voxel_id*104729)%1000)/1000.0::DOUBLE - 0.2::DOUBLE AS c FROM grid)",
}


def gauss(source: str, keys: str, k: int, out: str = "fit") -> str:
    """SQL that solves the k normal equations of each row of ``source`` (keys, a_i_j for all i and j, b_i): out(keys, b0, ...)."""
    steps, before = [], source
    for p in range(k):
        cols = []
        for i in range(k):
            for j in [*range(k), "b"]:
                name = f"b_{i}" if j == "b" else f"a_{i}_{j}"
                pivot = f"b_{p}" if j == "b" else f"a_{p}_{j}"
                cols.append(f"{pivot}/a_{p}_{p} AS {name}" if i == p else f"{name} - a_{i}_{p}/a_{p}_{p}*{pivot} AS {name}")
        steps.append(f"{out}_{p} AS (SELECT {keys}, {', '.join(cols)} FROM {before})")
        before = f"{out}_{p}"
    steps.append(f"{out} AS (SELECT {keys}, {', '.join(f'b_{i} AS b{i}' for i in range(k))} FROM {before})")
    return ", ".join(steps)


def fit_sql(source: str, keys: str, terms: list[str], y: str = "value", out: str = "fit", weight: str = "1.0::DOUBLE") -> str:
    """SQL for a least-squares fit of ``terms`` (SQL over ``source``) in each group of keys."""
    k = len(terms)
    sums = [f"sum({weight}*({terms[i]})*({terms[j]})) AS a_{i}_{j}" for i in range(k) for j in range(k)] + [f"sum({weight}*({t})*{y}) AS b_{i}" for i, t in enumerate(terms)]
    return f"{out}_m AS (SELECT {keys}, {', '.join(sums)} FROM {source} GROUP BY {keys}), " + gauss(f"{out}_m", keys, k, out)


def with_sql(*parts: str) -> str:
    """WITH these tables and subqueries."""
    return "WITH RECURSIVE " + ", ".join(SQL.get(p, p) for p in parts) + " "
