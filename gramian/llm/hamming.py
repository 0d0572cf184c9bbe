"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments of at most log2(number of codes) bits.  Round r probes, for every query still
open and every segment, the values at exactly r bits from the query's own, and verifies what it meets, inside the
join: what is farther than the query's kth distance so far does not leave it.
A code not met by then differs by more than r bits in each of m segments, so by m * (r + 1) or more in all:
a query is closed once its kth verified distance is at most m * (r + 1) - 1.

A pair of codes is verified once: in the round of its nearest segment, for the first such segment.
Equal codes are searched for once and stand for all their rows; of those only the k smallest ids can be among
the results.  Ties in distance go to the smaller id.  A row is not its own neighbour, but others with the same code
are.  Null vectors, and rows without an id, are neither searched nor found; fewer than k other rows give fewer
neighbours.  Rows that repeat both id and code are one row; an id with several codes is a row for each.  A null
component counts as not positive.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramian.runtime import cut

BITS = 64


def sign_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code long): bit j is 1 if component j is positive; vectors of up to 64 components."""
    v = F.col(vector_col)
    # Bits as an array of longs that are shifted to their places and added.
    shifted = F.transform(v, lambda x, j: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    bits = F.aggregate(shifted, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    too_long = F.raise_error(F.lit("vectors of more than 64 components have no 64-bit code"))
    code = F.when(F.size(v) > BITS, too_long.cast("long")).otherwise(bits)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), code.alias("code")).where("id is not null and v is not null").select("id", "code").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _literal(x: int):
    return F.lit(_signed(x)).cast("long")


def segments(n: int) -> list[tuple[int, int]]:
    """(first bit, end) of the segments for n codes."""
    count = math.ceil(BITS / min(BITS, max(4.0, math.log2(max(2, n)))))
    return [(BITS * k // count, BITS * (k + 1) // count) for k in range(count)]


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest rows of ``codes`` (id, code) to each row of ``queries``."""
    codes, queries = codes.select("id", "code").distinct(), queries.select("id", "code").distinct()
    ids = Window.partitionBy("code").orderBy("id")
    # One more than k, as one of them may be the query itself.
    held = cut(codes.withColumn("nth", F.row_number().over(ids)).where(F.col("nth") <= k + 1).drop("nth"))
    database = cut(codes.groupBy("code").agg(F.least(F.count("*"), F.lit(k + 1)).alias("copies")))
    n = database.count()
    parts = segments(n)
    masks = [(1 << b) - (1 << a) for a, b in parts]
    m = len(parts)

    index = database.select("code", "copies", F.posexplode(F.array(*[_literal(x) for x in masks])).alias("part", "mask")).select("code", "copies", "part", F.col("code").bitwiseAND(F.col("mask")).alias("key"))
    open_ = cut(queries.select("code").distinct().withColumn("far", F.lit(BITS)))
    best, longest = None, max(b - a for a, b in parts)
    for r in range(longest + 1):
        probes = None
        for j, (a, b) in enumerate(parts):
            flips = [sum(1 << x for x in chosen) for chosen in combinations(range(a, b), r)]
            if not flips:
                continue
            flip = F.explode(F.expr("array(" + ",".join(f"{_signed(x)}L" if x != 1 << 63 else "(-9223372036854775807L - 1L)" for x in flips) + ")"))
            p = open_.select("code", "far", flip.alias("flip")).select(F.col("code").alias("query"), "far", F.lit(j).alias("part"), F.col("code").bitwiseAND(_literal(masks[j])).bitwiseXOR(F.col("flip")).alias("key"))
            probes = p if probes is None else probes.unionAll(p)
        met = probes.join(index, ["part", "key"])
        apart = F.col("query").bitwiseXOR(F.col("code"))
        by_part = [F.bit_count(apart.bitwiseAND(_literal(x))) for x in masks]
        first = F.lit(True)
        for j, d in enumerate(by_part):
            first = first & (F.when(F.col("part") > j, d > r).otherwise(d >= r))
        found = met.where(first & (F.bit_count(apart) <= F.col("far"))).select("query", "code", F.bit_count(apart).alias("distance"), "copies")
        merged = found if best is None else best.unionAll(found)
        # Codes in order until they stand for more than k rows.
        order = Window.partitionBy("query").orderBy("distance", "code")
        ranked = merged.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
        before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # All codes at the distance of the last one needed stay, for ties between ids.
        kept = ranked.withColumn("before", before)
        limit = kept.where(F.col("before") <= k).groupBy("query").agg(F.max("distance").alias("far"), F.sum("copies").alias("total"))
        covered = m * (r + 1) - 1
        last = cut(merged.join(limit, "query").where(F.col("distance") <= F.col("far")).select("query", "code", "distance", "copies", "far", "total"))
        best = last.select("query", "code", "distance", "copies")
        so_far = last.where(F.col("total") > k).groupBy(F.col("query").alias("code")).agg(F.min("far").alias("now"))
        open_ = open_.join(so_far, "code", "left").select("code", F.coalesce("now", "far").alias("far"))
        open_ = cut(open_.where((F.col("far") > covered) | (F.col("far") == BITS)))
        if open_.isEmpty():
            break
    rows = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(best, "query").join(held, "code")
    rows = rows.where((F.col("query_id") != F.col("id")) | (F.col("distance") > 0))
    order = Window.partitionBy("query_id", "query").orderBy("distance", "id", "code")
    out = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("neighbour_id"), F.col("distance").cast("long").alias("distance"))
