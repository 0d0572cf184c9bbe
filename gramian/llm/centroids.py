"""Centroid clustering over subvector dictionaries, in whole numbers throughout.

Vectors are turned into integers and their dimensions dealt into blocks.  The distinct values of a block, its subvectors, form a
dictionary that loses nothing: a vector is one code for each block.  In each round the squared distance of every subvector from
every centroid is worked out once; a vector's distance is the sum of its codes' partial distances, and a cluster's
sum is the sum of subvectors times how often its vectors have them.

Dictionaries are found bottom-up: first the distinct values of each dimension, then two neighbouring blocks become one as long as the product of
their dictionaries' sizes, which bounds the new one, is MOST_CODES or less.  So the driver and every task hold at most
MOST_CODES subvectors a block, whatever the number of vectors.  A dimension with more values than that has no dictionary; its part of
a distance is computed from the value itself, which is as exact.

The vectors are read once for each level of blocks and once to be encoded and written down; a round is one pass over the codes, which
sends one row for each cluster and dimension from each task.  No vector is shuffled.

Not kept: vectors that are null, of another number of components, with a component null or not finite, or beyond LARGEST after
scaling (a squared distance would leave 64 bits).  A null id counts as empty text in the hash that chooses the first centroids; ties of the hash (repeated
ids) go by the vector.  With fewer than ``k`` kept vectors each is a centroid; with none the result is empty.  Every row of a repeated
vector or id is a row of the result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches
from gramian.runtime import cut

#: A block's dictionary has so many subvectors at most.
MOST_CODES = 4096
#: Components lie within this after scaling.
LARGEST = 1 << 27

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass(frozen=True)
class Block:
    """The dictionary of some dimensions: ``entries`` (codes x dimensions).  A block of two parts finds its codes by those of the parts."""

    dims: tuple[int, ...]
    entries: np.ndarray
    parts: tuple[Block, Block] | None = None
    lookup: np.ndarray | None = None

    def codes(self, v: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.searchsorted(self.entries[:, 0], v[:, self.dims[0]])
        return self.lookup[_pair_codes(self.parts, v)]

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """The exact squared distance of every subvector from every centroid."""
        apart = self.entries[:, None, :] - centroids[None, :, list(self.dims)]
        return (apart * apart).sum(axis=2)


def _pair_codes(parts: tuple[Block, Block], v: np.ndarray) -> np.ndarray:
    return parts[0].codes(v) * len(parts[1].entries) + parts[1].codes(v)


def integers(df: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the kept vectors."""
    batches.small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < LARGEST))
    return rows.where(F.col("x").isNotNull() & (F.size("x") == dims) & fine).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def dictionaries(kept: DataFrame, dims: int, most: int = MOST_CODES) -> list[Block]:
    """The blocks that cover all dimensions with ``most`` values or fewer."""
    values = kept.select(F.posexplode("v").alias("dim", "value")).distinct()
    few = values.groupBy("dim").count().where(F.col("count") <= most)
    held = few.select("dim").toArrow()["dim"].to_pylist()  # a number for each dimension at most
    got = values.where(F.col("dim").isin(held)).toArrow() if held else pa.table({"dim": [], "value": []})
    dim, value = got["dim"].to_numpy(), got["value"].to_numpy()
    blocks = [Block((d,), np.sort(value[dim == d]).astype(np.int64)[:, None]) for d in range(dims) if d in set(held)]
    while True:
        level = _merged(kept, blocks, dims, most)
        if len(level) == len(blocks):
            return blocks
        blocks = level


def _merged(kept: DataFrame, blocks: list[Block], dims: int, most: int) -> list[Block]:
    """Neighbours made one where their dictionaries' product allows it, with the subvectors that there are."""
    pairs, at = [], 0
    while at + 1 < len(blocks):
        if len(blocks[at].entries) * len(blocks[at + 1].entries) <= most:
            pairs.append(at)
            at += 1
        at += 1
    if not pairs:
        return blocks
    shared = kept.sparkSession.sparkContext.broadcast([(blocks[a], blocks[a + 1]) for a in pairs])

    def seen(it):
        present = [np.zeros(len(a.entries) * len(b.entries), bool) for a, b in shared.value]
        for batch in it:
            v = _matrix(batch.column(0), dims)
            for p, parts in zip(present, shared.value):
                p[_pair_codes(parts, v)] = True
        for k, p in enumerate(present):
            codes = np.flatnonzero(p)
            yield pa.record_batch([pa.array(np.full(len(codes), k, np.int32)), pa.array(codes.astype(np.int32))], names=["pair", "code"])

    got = kept.select("v").mapInArrow(seen, "pair int, code int").distinct().toArrow()  # ``most`` rows a pair at most
    pair, code = got["pair"].to_numpy(), got["code"].to_numpy()
    out, done = [], set()
    for k, a in enumerate(pairs):
        left, right, codes = blocks[a], blocks[a + 1], np.sort(code[pair == k])
        lookup = np.full(len(left.entries) * len(right.entries), -1, np.int64)
        lookup[codes] = np.arange(len(codes))
        entries = np.hstack([left.entries[codes // len(right.entries)], right.entries[codes % len(right.entries)]])
        out.append((a, Block(left.dims + right.dims, entries, (left, right), lookup)))
        done |= {a, a + 1}
    out += [(a, b) for a, b in enumerate(blocks) if a not in done]
    return [b for _, b in sorted(out, key=lambda x: x[0])]


def encoded(kept: DataFrame, blocks: list[Block], dims: int) -> DataFrame:
    """(vec_id, codes array<int>, rest array<long>): a code for each block, and the values of dimensions that no block has."""
    shared = kept.sparkSession.sparkContext.broadcast(blocks)
    rest = _rest(blocks, dims)

    def run(it):
        for batch in it:
            v = _matrix(batch.column(1), dims)
            codes = np.stack([b.codes(v) for b in shared.value], axis=1).astype(np.int32) if shared.value else np.zeros((len(v), 0), np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (codes, v[:, rest])]
            yield pa.record_batch([batch.column(0), *lists], names=["vec_id", "codes", "rest"])

    return kept.mapInArrow(run, "vec_id long, codes array<int>, rest array<long>")


def _rest(blocks: list[Block], dims: int) -> list[int]:
    return sorted(set(range(dims)) - {d for b in blocks for d in b.dims})


class _Round:
    """What a task needs to assign vectors: each block's partial distances from the centroids, worked out once."""

    def __init__(self, blocks: list[Block], centroids: np.ndarray, dims: int):
        self.tables, self.centroids, self.rest = [b.distances(centroids) for b in blocks], centroids, _rest(blocks, dims)

    def assign(self, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the first of equal ones, and the distance."""
        total = np.zeros((len(codes), len(self.centroids)), np.int64)
        for k, table in enumerate(self.tables):
            total += table[codes[:, k]]
        for k, d in enumerate(self.rest):
            total += (rest[:, k, None] - self.centroids[None, :, d]) ** 2
        chosen = total.argmin(axis=1)
        return chosen, total[np.arange(len(total)), chosen]


def _sums(rows: DataFrame, blocks: list[Block], state, dims: int) -> dict[tuple[int, int], int]:
    """{(cluster, dimension): sum over the cluster's vectors}, and their number under dimension -1."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(it):
        now = state.value
        k, sizes = len(now.centroids), [len(b.entries) for b in shared.value]
        counts, times = np.zeros(k, np.int64), [np.zeros(k * n, np.int64) for n in sizes]
        total = np.zeros((k, dims), np.int64)
        for batch in it:
            codes, rest = _matrix(batch.column(0), len(sizes)), _matrix(batch.column(1), len(now.rest))
            cluster, _ = now.assign(codes, rest)
            counts += np.bincount(cluster, minlength=k)
            for b, n in enumerate(sizes):
                times[b] += np.bincount(cluster * n + codes[:, b], minlength=k * n)
            for c in range(k) if now.rest else ():
                total[c, now.rest] += rest[cluster == c].sum(axis=0)
        for b, t in zip(shared.value, times):
            total[:, list(b.dims)] += t.reshape(k, -1) @ b.entries
        held = np.hstack([counts[:, None], total])
        c, d = np.nonzero(np.broadcast_to(counts[:, None] > 0, held.shape))
        yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array((d - 1).astype(np.int32)), pa.array(held[c, d])], names=["cluster", "dim", "total"])

    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    got = rows.select("codes", "rest").mapInArrow(run, "cluster int, dim int, total long").groupBy("cluster", "dim").agg(exact)
    return {(r.cluster, r.dim): int(r.total) for r in got.collect()}  # a row for each centroid and dimension


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0, most: int = MOST_CODES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after ``rounds`` of assigning all vectors to the
    nearest centroid (ties: the smaller number) and moving every centroid that has some to floor(sum / count), and a last assignment."""
    spark = df.sparkSession
    kept = integers(df, dims, scale, id_col, vector_col)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    blocks = dictionaries(kept, dims, most)
    rows = cut(encoded(kept, blocks, dims))
    state = spark.sparkContext.broadcast(_Round(blocks, centroids, dims))
    for _ in range(rounds):
        sums = _sums(rows, blocks, state, dims)
        for c in range(len(centroids)):
            if n := sums.get((c, -1)):
                centroids[c] = [sums[c, d] // n for d in range(dims)]
        state = spark.sparkContext.broadcast(_Round(blocks, centroids, dims))

    def assigned(it):
        for batch in it:
            now = state.value
            chosen, distance = now.assign(_matrix(batch.column(1), len(now.tables)), _matrix(batch.column(2), len(now.rest)))
            yield pa.record_batch([batch.column(0), pa.array(chosen.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    out = cut(rows.mapInArrow(assigned, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(inertia.values())
    shown = [(c, s, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    table = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select(*[x.split()[0] for x in RESULT.split(", ")])
