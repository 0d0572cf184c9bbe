"""Statistical maps: thresholds, comparisons and labels.  A map is (voxel_id, value), with x, y, z where clusters are asked for."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.functions.distributions import normal_quantile, normal_quantile_column
from gramian.operators.graph import components, least_labels
from gramian.operators.windows import numbered, order_statistic
from gramian.runtime import cut


def _forward() -> list[tuple[int, int, int]]:
    """Half of the 26 directions."""
    return [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def neighbours(voxels: DataFrame) -> DataFrame:
    """(src, dst): pairs among ``voxels`` that touch by a face, an edge or a corner; thirteen of the 26 directions, each an equi-join.
    Both sides are shuffled: the voxels' estimated size is that of a compressed file, and as a broadcast they went through the driver whole."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "dz"), o)]) for o in _forward()])
    moved = voxels.select(F.col("voxel_id").alias("src"), "x", "y", "z", F.explode(steps).alias("o"))
    moved = moved.select("src", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "xyz"])
    return moved.join(voxels.select(F.col("voxel_id").alias("dst"), "x", "y", "z").hint("merge"), ["x", "y", "z"]).select("src", "dst")


#: Voxels along each side of a block, which one task labels, and edges between blocks that one task joins.
SIDE, FEW_EDGES = 32, 200_000


def _block_labels(rows: pd.DataFrame) -> pd.DataFrame:
    """The voxels of one block with the smallest voxel of each one's cluster inside the block."""
    side = SIDE + 2
    place = ((rows["x"].to_numpy() % SIDE + 1) * side + rows["y"].to_numpy() % SIDE + 1) * side + rows["z"].to_numpy() % SIDE + 1
    places, at = np.unique(place, return_inverse=True)
    where = np.full(side**3, -1)
    where[places] = np.arange(len(places))
    pairs = [(np.arange(len(places)), where[places + (dx * side + dy) * side + dz]) for dx, dy, dz in _forward()]
    a, b = (np.concatenate([p[k][p[1] >= 0] for p in pairs]) for k in (0, 1))
    label = least_labels(len(places), a, b)
    ids, alone = rows["voxel_id"].to_numpy(), np.bincount(label, minlength=len(places)) == 1
    least = np.full(len(places), np.iinfo(np.int64).max)
    np.minimum.at(least, label[at], ids)
    # Voxels that share a place touch by way of others only.
    return rows[["voxel_id", "x", "y", "z"]].assign(label=np.where(alone[label[at]], ids, least[label[at]]))


def cluster_components(voxels: DataFrame) -> DataFrame:
    """(voxel_id, component): the smallest voxel of each one's 26-connected cluster.

    Blocks of SIDE voxels a side are labelled each in one task; then labels that touch across the borders of blocks are joined, so
    that what is shuffled after the blocks are made are voxels at borders and edges between labels.
    """
    whole = voxels.select(*[F.col(c).cast("long").alias(c) for c in ("voxel_id", "x", "y", "z")])
    block = [F.floor(F.col(c) / SIDE).alias(f"b{c}") for c in "xyz"]
    labelled = cut(whole.groupBy(*block).applyInPandas(_block_labels, "voxel_id long, x long, y long, z long, label long"))
    edge = reduce(lambda a, b: a | b, [F.pmod(F.col(c), F.lit(SIDE)).isin(0, SIDE - 1) for c in "xyz"])
    touching = neighbours(labelled.where(edge).select(F.col("label").alias("voxel_id"), "x", "y", "z")).where("src <> dst").distinct()
    joined = components(touching, small=FEW_EDGES)
    return labelled.join(joined, F.col("label") == F.col("node"), "left").select("voxel_id", F.coalesce("component", "label").alias("component"))


def clusterize(df: DataFrame, lower: float | None = None, upper: float | None = None, min_size: int = 1, default: float = 0.0) -> DataFrame:
    """(voxel_id, value, label): voxels with lower <= value < upper in 26-connected clusters of ``min_size`` or more, the rest
    with the default and label 0; labels from 1 by the smallest voxel.  Without bounds everything is one cluster."""
    if lower is None and upper is None:
        return df.select("voxel_id", "value", F.lit(1).cast("long").alias("label"))
    inside = F.lit(True)
    inside = inside & (F.col("value") >= lower) if lower is not None else inside
    inside = inside & (F.col("value") < upper) if upper is not None else inside
    found = cut(cluster_components(df.where(inside)))
    large = found.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    # A component is named after its smallest voxel.
    numbers = numbered(large.select("component"), F.col("component"), as_number="label")
    labelled = found.join(numbers, "component").select("voxel_id", "label")
    out = df.select("voxel_id", "value").join(labelled, "voxel_id", "left")
    return out.select("voxel_id", F.when(F.col("label").isNotNull(), F.col("value")).otherwise(F.lit(default)).alias("value"), F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def p_to_z(df: DataFrame, p: float) -> DataFrame:
    """Kept values v (not 0) as the normal quantile of v, less that of 1 - p, plus 0.2."""
    z = normal_quantile_column(F.col("value")) - normal_quantile(1 - p) + 0.2
    return df.withColumn("value", F.when(F.col("value") != 0, z).otherwise(F.lit(0.0)))


def threshold_clusters(df: DataFrame, thresholds: list[float], min_size: int) -> DataFrame:
    """(p, voxel_id, value, label): for each p the clusters at 1 - p, as z values."""
    return reduce(DataFrame.unionByName, [p_to_z(clusterize(df, lower=1 - p, min_size=min_size), p).withColumn("p", F.lit(p)) for p in thresholds])


def invert_best_fraction(df: DataFrame, share: float) -> DataFrame:
    """The lowest ceil(share * n) finite scores as threshold - score, others 0."""
    t = order_statistic(df, share)
    return df.crossJoin(F.broadcast(t)).select("voxel_id", F.when(F.col("value") <= F.col("threshold"), F.col("threshold") - F.col("value")).otherwise(F.lit(0.0)).alias("value"))


def aic_rescale(df: DataFrame) -> DataFrame:
    """Absolute values, zeros left out, scaled to [0, 1]; below their mean, and zeros: 0."""
    size = F.when(F.col("value") != 0, F.abs("value"))
    ends = df.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.avg(size).alias("mean"))
    scaled = (size - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).select("voxel_id", F.when(size >= F.col("mean"), F.coalesce(scaled, F.lit(0.0))).otherwise(F.lit(0.0)).alias("value"))


def joined_maps(maps: list[DataFrame]) -> DataFrame:
    """(voxel_id, m0, m1, ...)."""
    named = [m.select("voxel_id", F.col("value").alias(f"m{k}")) for k, m in enumerate(maps)]
    return reduce(lambda a, b: a.join(b, "voxel_id"), named)


def best_fit(maps: list[DataFrame]) -> DataFrame:
    """(voxel_id, value, label): the greatest value, and the number from 1 of the first map that has it; label 0 if no map exceeds 0
    beyond the first."""
    df, cols = joined_maps(maps), [F.col(f"m{k}") for k in range(len(maps))]
    top = F.greatest(*cols)
    label = F.when((cols[0] <= 0) & (top <= cols[0]), F.lit(0))
    for k, c in enumerate(cols):
        label = label.when(c == top, F.lit(k + 1))
    return df.select("voxel_id", top.alias("value"), label.cast("long").alias("label"))


def rgb(maps: list[DataFrame]) -> DataFrame:
    """(voxel_id, r, g, b, mask): two or three maps as channels; mask: any channel above 0."""
    df = joined_maps(maps)
    channels = [F.col(f"m{k}") if k < len(maps) else F.lit(0.0) for k in range(3)]
    return df.select("voxel_id", *[c.alias(n) for n, c in zip("rgb", channels)], (F.greatest(*channels) > 0).alias("mask"))


def abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined_maps([a, b]).select("voxel_id", F.abs(F.col("m0") - F.col("m1")).alias("value"))


def squared_error(a: DataFrame, b: DataFrame) -> DataFrame:
    return joined_maps([a, b]).select("voxel_id", ((F.col("m0") - F.col("m1")) ** 2).alias("value"))


def same_data(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(same, max_difference)."""
    gap = F.abs(F.col("m0") - F.col("m1"))
    return joined_maps([a, b]).agg(F.bool_and(gap <= atol + rtol * F.abs("m1")).alias("same"), F.max(gap).alias("max_difference"))


def name_regions(df: DataFrame, atlas: DataFrame, roi: DataFrame) -> DataFrame:
    """(voxel_id, value, roi_id, roi_name): null names where the atlas has none."""
    return df.join(atlas, "voxel_id", "left").join(roi, "roi_id", "left").select("voxel_id", "value", "roi_id", "roi_name")


def roi_summary(df: DataFrame, atlas: DataFrame, roi: DataFrame) -> DataFrame:
    """(roi_name, n, mean)."""
    return name_regions(df, atlas, roi).groupBy("roi_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
