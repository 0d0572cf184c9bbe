"""SimHash near-duplicates by the generalised pigeonhole principle.

Two forms.  ``group`` links 64-bit fingerprints within ``distance`` bits of each other, exactly.  The bits are dealt into
partitions, correlated bits into the same one, and partition i gets a threshold t_i; if the sum of t_i + 1 is
distance + 1, two linked fingerprints agree up to t_i bits in at least one partition i.  The thresholds
(-1: the partition isn't probed) and the number of partitions come from a dynamic programme over
estimated numbers of probes and candidates; a partition's candidates are estimated from the distances of sampled pairs.
Every fingerprint probes the keys within t_i bits of its own in each partition, and candidates are verified inside that join.

``group_similar`` links texts by the similarity of their shingles.  At a similarity of 0.8 a seventh of all bits differ,
and no 64 bits tell such texts from others; so the fingerprint is ``width`` words of 64 bits, and two texts are linked if so few
of all its bits differ as that similarity lets expect.  No thresholds could cover every pattern of so many differing
bits; the dynamic programme takes the cheapest ones by which a pair at that similarity is met in some
partition with probability ``recall``.  With the texts at hand nothing rests on that: every link that the fingerprints give is held against the sets of
shingles, and what they miss is found by the sets themselves.  Two sets of a similarity share one of the first shingles of each, in any order that is the same
for all; so texts of different groups that share such a shingle, and whose sizes and parities don't rule it out, are held against each other too.

Buckets with very many fingerprints aren't joined with themselves.  ``group`` links them by way
of all values within distance/2 bits of each (two linked fingerprints have one in common), which grows
with the number of fingerprints only; beyond MOST_NEIGHBOURS values, by dealing the bucket again over its other bits.
``group_similar`` first links every fingerprint to the most central one of each bucket; then only fingerprints of different components are
compared, and in a bucket the members of a large component are compared with those outside it only.

Null texts count as empty; a text without words has fingerprint zero and is linked like any other.
Rows that repeat an id are linked as rows of their own.  A null id is never a component's id unless
all ids of the component are null.  Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches
from gramian.operators.graph import components
from gramian.runtime import cut

BITS = 64
#: Costs of a probe and of a candidate pair, in the same unit.
PROBE_COST, CANDIDATE_COST = 1.0, 0.02
#: Candidates are estimated from all pairs of so many sampled fingerprints.
SAMPLE = 1024
#: A component of so many fingerprints is large.
LARGE = 64
#: One text of so many is looked at to tell which shingles come last in the order; so many shingles, seen in so many of them, are told apart.
ONE_OF, MOST_COMMON, SEEN = 32, 1 << 17, 3
#: Parities of a set of shingles, at least.
PARITIES = 512
#: So many links are joined to components in one task.
FEW_LINKS = 200_000
#: A table of so many rows is sent to all tasks; of a few numbers a row, so many.
FEW, MOST_SENT = 10_000, 1 << 20
#: A fingerprint of a crowded bucket is linked by way of so many values within distance/2 bits at most.
MOST_NEIGHBOURS = 5000
_ODD = 0x9E3779B97F4A7C15


def _shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 with seed 42 of the word shingles of a text, repeats included; of all its words if there are fewer; none without words."""
    import xxhash

    tokens = text.split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    xx = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([xx(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return np.array([xx(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], "<u8")


def fingerprint(text: bytes, words: int, width: int = 1) -> np.ndarray:
    """The SimHash of one text (UTF-8, A-Z in lower case), ``width`` words of 64 bits; the first is that of the hashes themselves,
    the others of hashes of them."""
    return _simhash(_shingle_hashes(text, words), width)


def _simhash(hashes: np.ndarray, width: int) -> np.ndarray:
    ones = np.zeros(BITS * width, np.int64)
    for a in range(0, len(hashes), 4096):
        part = np.empty((len(hashes[a : a + 4096]), width), "<u8")
        for k in range(width):
            part[:, k] = hashes[a : a + 4096]
            if k:
                part[:, k] *= np.uint64(_ODD * (2 * k + 1) & (1 << 64) - 1)
                batches.mix(part[:, k])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def _fingerprints(df: DataFrame, words: int, width: int, id_col: str, text_col: str, schema: str) -> DataFrame:
    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                fp = [fingerprint((t or "").encode().lower(), words, width) for t in part.column(1).to_pylist()]
                flat = pa.array(np.concatenate(fp).view(np.int64))
                column = flat if width == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * width), flat)
                yield pa.record_batch([part.column(0), column, *part.columns[2:]], names=["doc_id", "fp", *part.schema.names[2:]])

    rows = batches.by_id_text(df, id_col, text_col)
    return (rows if width == 1 else _marked(rows)).mapInArrow(run, schema)


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with a hash of the text, by which a text is found again."""
    return rows.withColumn("mark", F.xxhash64("text"))


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every whole text; fp holds the 64 bits as a signed number."""
    return _fingerprints(df, words, 1, id_col, text_col, "doc_id long, fp long")


def wide_fingerprints(df: DataFrame, words: int = 5, width: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp array<long>, mark) of every whole text, ``width`` (two or more) words of 64 bits each; mark: a hash of the text."""
    return _fingerprints(df, words, width, id_col, text_col, "doc_id long, fp array<long>, mark long")


def common_shingles(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that very many texts have, ascending, and in how many of the texts looked at.  They only decide an order, so what is left out costs
    time and no link."""

    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                found = [np.unique(_shingle_hashes((t or "").encode().lower(), words)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    some = batches.by_id_text(docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("common")), F.lit(ONE_OF)) == 0), id_col, text_col)
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    got = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    shingle, n = got["shingle"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _parities(own: np.ndarray, n: int) -> np.ndarray:
    """Of the hashes with each remainder by n: whether their number is odd."""
    return np.packbits(np.bincount((own % np.uint64(n)).astype(np.int64), minlength=n) & 1, bitorder="little").view("<i8")


def _kin(own: np.ndarray) -> int:
    """A hash of a set of hashes, which ascend."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(own.tobytes(), 42))


def set_fingerprints(docs: DataFrame, words: int = 5, width: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``wide_fingerprints`` with what the set of a text's shingles is known by: kin (a hash of the set), size, parities (of the shingles with each of
    PARITIES remainders) and, for sets of more shingles than that, more (the same with a power of two of remainders that is their number or more)."""

    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                fps, kin, size, parities, more = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    hashes = _shingle_hashes((t or "").encode().lower(), words)
                    own = np.unique(hashes)
                    fps.append(_simhash(hashes, width).view(np.int64))
                    kin.append(_kin(own))
                    size.append(len(own))
                    parities.append(_parities(own, PARITIES))
                    more.append(_parities(own, 1 << (len(own) - 1).bit_length()) if len(own) > PARITIES else None)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (fps, parities, more)]
                columns = [part.column(0), lists[0], part.column(2), pa.array(kin, pa.int64()), pa.array(size, pa.int64()), *lists[1:]]
                yield pa.record_batch(columns, names=["doc_id", "fp", "mark", "kin", "size", "parities", "more"])

    rows = _marked(batches.by_id_text(docs, id_col, text_col))
    return rows.mapInArrow(run, "doc_id long, fp array<long>, mark long, kin long, size long, parities array<long>, more array<long>")


def leading_shingles(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kin, shingle): of the set of every text the first shingles in an order of all shingles, common ones last; so many that every set of the
    similarity has one of them among its own."""
    common, often = common_shingles(docs, words, id_col, text_col)

    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                kin, leading = [], []
                for t in part.column(1).to_pylist():
                    own = np.unique(_shingle_hashes((t or "").encode().lower(), words))
                    kin.append(_kin(own))
                    if len(common):
                        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        own = own[np.argsort(np.where(common[at] == own, often[at], 0), kind="stable")]
                    leading.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1])
                columns = np.repeat(np.array(kin, np.int64), [len(x) for x in leading]), np.concatenate(leading).view(np.int64)
                yield pa.record_batch([pa.array(c) for c in columns], names=["kin", "shingle"])

    return batches.by_id_text(docs, id_col, text_col).mapInArrow(run, "kin long, shingle long")


@dataclass(frozen=True)
class Plan:
    """Bit positions and threshold of each partition that is probed."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def grouped_bits(correlation: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The bits in ``parts`` groups of nearly equal size; a group takes the bits most correlated with what it has."""
    strength = np.abs(np.nan_to_num(correlation))
    np.fill_diagonal(strength, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: strength[b, list(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(tuple(sorted(group)))
    return out


def near_share(bits: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    """share[t]: of pairs that differ in at most t of the bits of ``part``, among the sampled rows of ``bits`` (0 or 1); no less than
    among pairs whose bits are independent and even, which the sample is too small to show for many bits."""
    x = bits[:, list(part)].astype(np.float32)
    both = x @ x.T
    held = x.sum(axis=1)
    apart = np.rint(held[:, None] + held[None, :] - 2 * both).astype(np.int64)[np.triu_indices(len(x), 1)]
    seen = np.bincount(apart, minlength=len(part) + 1) / max(1, len(apart))
    even = np.array([math.comb(len(part), t) for t in range(len(part) + 1)]) / 2.0 ** len(part)
    return np.maximum(np.cumsum(seen), np.cumsum(even))


def _costs(n: int, bits: np.ndarray, part: tuple[int, ...], most: int) -> list[float]:
    """The cost of thresholds -1, 0, ..., ``most`` in one partition of n fingerprints."""
    share, size = near_share(bits, part), len(part)
    probes = np.cumsum([math.comb(size, t) for t in range(size + 1)])
    return [0.0] + [PROBE_COST * n * float(probes[min(t, size)]) + CANDIDATE_COST * n * n / 2 * float(share[min(t, size)]) for t in range(most + 1)]


def plan(n: int, correlation: np.ndarray, bits: np.ndarray, distance: int) -> Plan:
    """The cheapest partitions and thresholds for n fingerprints that cover every pattern of ``distance`` differing bits.
    correlation: of the bits; bits: those of sampled fingerprints."""
    best: tuple[float, Plan] | None = None
    for parts in range(1, min(distance + 1, 8) + 1):
        groups = grouped_bits(correlation, parts)
        # table[u]: the least cost of the groups so far if they take u of the distance + 1 units.
        table: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(math.inf, ())] * (distance + 1)
        for g in groups:
            c = _costs(n, bits, g, distance)
            table = [min((table[u - take][0] + c[take], (*table[u - take][1], take - 1)) for take in range(u + 1)) for u in range(distance + 2)]
        total, thresholds = table[distance + 1]
        if best is None or total < best[0]:
            best = (total, _probed(groups, thresholds))
    return best[1]


def _probed(groups, thresholds) -> Plan:
    used = [k for k, t in enumerate(thresholds) if t >= 0]
    return Plan(tuple(groups[k] for k in used), tuple(thresholds[k] for k in used))


def differing(similarity: float) -> float:
    """The share of differing bits that a Jaccard similarity of shingle sets lets expect: the angle between two sets of equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_plan(n: int, correlations: list[np.ndarray], bits: np.ndarray, similarity: float, recall: float) -> Plan:
    """The cheapest partitions (inside words) and thresholds for n wide fingerprints by which a pair at ``similarity``
    is met with probability ``recall``, if its bits differ independently.  As much of it as there is if the width allows no more."""
    p, units, most, n = differing(similarity), 400, 2, max(n, 1)
    need = -math.log(max(1e-9, 1 - recall))
    best: tuple[float, float, Plan] | None = None
    for parts in (2, 3, 4, 5, 6):
        groups = [tuple(BITS * w + b for b in g) for w, c in enumerate(correlations) for g in grouped_bits(c, parts)]
        table: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(math.inf, ())] * units
        for g in groups:
            hit = np.cumsum([math.comb(len(g), t) * p**t * (1 - p) ** (len(g) - t) for t in range(most + 1)])
            worth = [0] + [min(units, int(units * -math.log(max(1e-12, 1 - h)) / need)) for h in hit]
            new = [(x[0], (*x[1], -1)) for x in table]
            for take, c in enumerate(_costs(n, bits, g, most)[1:], 1):
                for u, (cost, chosen) in enumerate(table):
                    to = min(units, u + worth[take])
                    if cost + c < new[to][0]:
                        new[to] = (cost + c, (*chosen, take - 1))
            table = new
        reached = max(u for u, x in enumerate(table) if x[0] < math.inf)
        if best is None or (-reached, table[reached][0]) < best[:2]:
            best = (-reached, table[reached][0], _probed(groups, table[reached][1]))
    return best[2]


def bit_statistics(fps: DataFrame, width: int = 1) -> tuple[int, list[np.ndarray]]:
    """The number of rows and, for each word of the column fp, the correlations of its bits, over all rows."""

    def count(it):
        both, n = np.zeros((width, BITS, BITS)), 0
        for batch in it:
            x = _words(batch.column(0), width)
            for a in range(0, len(x), 8192):
                bits = np.unpackbits(x[a : a + 8192].view(np.uint8), axis=1, bitorder="little").astype(np.float32).reshape(-1, width, BITS)
                for w in range(width):
                    both[w] += bits[:, w].T @ bits[:, w]
            n += len(x)
        yield pa.record_batch([pa.array(np.arange(both.size + 1, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(width * BITS * BITS + 1)
    cells[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    out = []
    for both in cells[:-1].reshape(width, BITS, BITS) / max(1, cells[-1]):
        p = both.diagonal()
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        out.append((both - np.outer(p, p)) / np.outer(sd, sd))
    return int(cells[-1]), out


def _words(column: pa.Array, width: int) -> np.ndarray:
    flat = column if width == 1 else column.flatten()
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False)).reshape(-1, width)


def sampled_bits(fps: DataFrame, width: int = 1) -> np.ndarray:
    """The bits of SAMPLE fingerprints at most, those with the smallest hashes."""
    got = fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow()["fp"].combine_chunks()
    return np.unpackbits(_words(got, width).view(np.uint8), axis=1, bitorder="little") if len(got) else np.zeros((0, BITS * width), np.uint8)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits, most: int) -> list[int]:
    """All masks of at most ``most`` of these bits."""
    return [_signed(sum(1 << b for b in chosen)) for t in range(most + 1) for chosen in combinations(bits, t)]


def _masks(values: list[int]):
    """A constant array column."""
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def _mask(part: tuple[int, ...]) -> int:
    """The bits of one word that ``part`` has."""
    return _signed(sum(1 << b % BITS for b in part))


def links(fps: DataFrame, distance: int = 4, heavy: int = 20_000, chosen: Plan | None = None) -> DataFrame:
    """(src, dst): pairs of different fingerprints, src < dst, at most ``distance`` bits apart; at least enough
    of them to connect all that are linked.  ``fps``: distinct values in a column fp.
    A pair may come more than once.  Buckets of more than ``heavy`` fingerprints are linked by way of shared
    neighbours, and there only links to the smallest of those that share one are given, or dealt again."""
    if chosen is None:
        n, (correlation,) = bit_statistics(fps)
        chosen = plan(n, correlation, sampled_bits(fps), distance)
    whole = [_mask(part) for part in chosen.parts]
    at = lambda part, key: F.xxhash64(part, key).alias("at")
    homes = fps.select("fp", F.posexplode(_masks(whole)).alias("part", "used")).select("fp", "used", at("part", F.col("fp").bitwiseAND(F.col("used"))))
    probes = None
    for k, (part, most) in enumerate(zip(chosen.parts, chosen.thresholds)):
        key = F.col("fp").bitwiseAND(F.lit(whole[k])).bitwiseXOR(F.col("flip"))
        p = fps.select("fp", F.explode(_masks(_flips(part, most))).alias("flip")).select("fp", F.lit(whole[k]).alias("used"), at(F.lit(k), key))
        probes = p if probes is None else probes.unionAll(p)
    by_way = sum(math.comb(BITS, t) for t in range(distance - distance // 2 + 1)) <= MOST_NEIGHBOURS
    crowded = cut(homes.groupBy("at").count().where(F.col("count") > heavy).select("at"))
    if crowded.isEmpty():
        return _met(homes, probes, distance)
    out = _met(homes.join(crowded, "at", "left_anti"), probes, distance)
    homes, probes = homes.join(crowded, "at", "left_semi"), probes.join(crowded, "at", "left_semi")
    if by_way:
        return out.unionAll(_by_neighbours(probes.select("fp").distinct(), distance))
    return out.unionAll(_dealt_again(homes, probes, distance, heavy))


def _met(homes: DataFrame, probes: DataFrame, distance: int) -> DataFrame:
    apart = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("h.fp")))
    same = (F.col("h.at") == F.col("p.at")) & (F.col("p.fp") < F.col("h.fp")) & (apart <= distance)
    return probes.alias("p").join(homes.alias("h"), same).select(F.col("p.fp").alias("src"), F.col("h.fp").alias("dst"))


def _dealt_again(homes: DataFrame, probes: DataFrame, distance: int, heavy: int, levels: int = 5) -> DataFrame:
    """The links inside buckets: of the bits that a bucket hasn't ``used``, dealt into distance + 1 parts, two linked fingerprints
    agree in one part; buckets that are still crowded are dealt again, otherwise, as long as there are bits."""
    out = None
    for level in range(levels):
        deal = [_mask(tuple(b for b in range(BITS) if b * (2 * level + 3) % 67 % (distance + 1) == k)) for k in range(distance + 1)]

        def into(rows: DataFrame) -> DataFrame:
            new = F.col("mask").bitwiseAND(F.bitwise_not("used"))
            return rows.select("fp", "used", "at", F.posexplode(_masks(deal)).alias("k", "mask")).select("fp", F.col("used").bitwiseOR(F.col("mask")).alias("used"), F.xxhash64("at", "k", F.col("fp").bitwiseAND(new)).alias("at"))

        homes, probes = cut(into(homes)), cut(into(probes))
        crowded = cut(homes.groupBy("at").count().where(F.col("count") > heavy).select("at"))
        last = level == levels - 1 or crowded.isEmpty()
        got = _met(homes if last else homes.join(crowded, "at", "left_anti"), probes, distance)
        out = got if out is None else out.unionAll(got)
        if last:
            break
        homes, probes = homes.join(crowded, "at", "left_semi"), probes.join(crowded, "at", "left_semi")
    return out.distinct()


def _by_neighbours(fps: DataFrame, distance: int) -> DataFrame:
    """Links from each fingerprint to the smallest one that shares a value within distance/2 bits of both.
    For an odd distance one side goes one bit further, which is another set of values."""
    near, far = distance // 2, distance - distance // 2
    ball = lambda most: fps.select("fp", F.explode(_masks(_flips(range(BITS), most))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    inner = ball(near)
    least = inner.groupBy("at").agg(F.min("fp").alias("src"))
    out = inner.join(least, "at").where("src < fp").select("src", F.col("fp").alias("dst"))
    if far > near:
        met = ball(far).join(least, "at").where("src <> fp")
        out = out.unionAll(met.select(F.least("src", "fp").alias("src"), F.greatest("src", "fp").alias("dst")))
    return out.distinct()


def group(prints: DataFrame, distance: int = 4, heavy: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): the smallest doc_id reachable over links, the row's own included."""
    prints = cut(prints)
    values = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(cut(links(values.select("fp"), distance, heavy).distinct()))
    joined = values.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _bits_apart(a: str, b: str, words) -> Column:
    """The number of differing bits in the given words of two arrays."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in words), F.lit(0))


def _at_most(similarity: float, bits: int, deviations: float) -> int:
    """So many of ``bits`` differ at most between texts of a similarity, but for chances beyond some standard deviations."""
    p = differing(similarity)
    return int(p * bits + deviations * math.sqrt(p * (1 - p) * bits))


class Shingles:
    """Holds pairs of nodes against the sets of shingles of their texts.  ``values``: (node, first_id, mark), the document of each node; texts of
    nodes that stand in a pair go along compressed, which is less than their sets of hashes (64 bits)."""

    def __init__(self, docs: DataFrame, words: int, similarity: float, values: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.rows = _marked(batches.by_id_text(docs, id_col, text_col))
        self.words, self.similarity, self.values = words, similarity, values.select("node", "first_id", "mark")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text binary)."""
        asked = cut(self.values.join(nodes, "node"))
        n = asked.count()
        same = (self.rows["mark"] == asked["mark"]) & self.rows["doc_id"].eqNullSafe(asked["first_id"])
        met = self.rows.join(F.broadcast(asked) if n <= MOST_SENT else asked, same).select("node", "text")
        out = cut(batches.packed(met))
        return out if out.count() == n else cut(out.dropDuplicates(["node"]))  # rows that repeat id and text

    def near(self, pairs: DataFrame) -> DataFrame:
        """The (src, dst) of ``pairs`` whose sets have the similarity."""
        words, similarity = self.words, self.similarity

        def run(it):
            for batch in it:
                rows = batches.unpacked(batches.unpacked(batch, "a"), "b")
                near, last = [], [("", np.zeros(0, "<u8"))] * 2
                for texts in zip(rows["a"].to_pylist(), rows["b"].to_pylist()):
                    last = [own if t == own[0] else (t, np.unique(_shingle_hashes((t or "").encode().lower(), words))) for t, own in zip(texts, last)]
                    (_, a), (_, b) = last
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    near.append(shared >= 1 and shared / (len(a) + len(b) - shared) >= similarity)
                yield rows.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

        pairs = cut(pairs.select("src", "dst").distinct())
        texts = self.texts(pairs.select(F.col("src").alias("node")).unionAll(pairs.select("dst")).distinct())
        both = pairs.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
        return both.mapInArrow(run, "src long, dst long")

    def confirmed(self, links: DataFrame) -> DataFrame:
        """(src, dst) of ``links`` (src, dst, apart) whose sets have the similarity, but for those inside of what others of them connect: the nearest of each
        node are held against each other first."""
        links = cut(links)
        ends = links.select(F.col("src").alias("node"), F.col("dst").alias("other"), "apart").unionAll(links.select("dst", "src", "apart"))
        best = ends.groupBy("node").agg(F.min(F.struct("apart", "other"))["other"].alias("other"))
        tried = cut(best.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct())
        good = cut(self.near(tried))
        named = cut(components(good, small=FEW_LINKS))
        left = links.join(tried, ["src", "dst"], "left_anti").join(named.toDF("src", "s"), "src", "left").join(named.toDF("dst", "d"), "dst", "left")
        return good.unionAll(self.near(left.where(F.coalesce("s", "src") != F.coalesce("d", "dst"))))


def leading_pairs(values: DataFrame, places: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, apart): nodes of different components that may have the similarity, all of them, and how many of their first parities differ.  ``values``: (node, kin, size, parities, more), written down;
    places: (kin, shingle), the leading shingles; found: (node, component).  Parities differ no more often than the sets.  In a shingle's rows the members of a
    component of LARGE or more meet those outside it only."""
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    large = F.when(F.col("members") >= LARGE, F.struct("members", "component")).alias("large")
    named = values.select("kin", "node", "size", "parities").join(found.join(size, "component").select("node", "component", large), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    places = places.repartition("shingle")
    shared = places.groupBy("shingle").agg(F.min("kin").alias("least"), F.max("kin").alias("most")).where("least <> most").select("shingle")
    held = cut(places.join(shared, "shingle").distinct().join(named, "kin").drop("kin"))
    chief = held.where("large is not null").groupBy("shingle").agg(F.max("large")["component"].alias("chief"))
    outside = held.join(chief, "shingle", "left").where("chief is null or chief <> component")
    sizes = F.col("p.size") + F.col("h.size")
    odd = sum((F.bit_count(F.col("p.parities")[k].bitwiseXOR(F.col("h.parities")[k])) for k in range(PARITIES // 64)), F.lit(0))
    once = (F.col("p.node") < F.col("h.node")) | F.col("p.chief").eqNullSafe(F.col("h.component"))
    meet = (F.col("p.shingle") == F.col("h.shingle")) & (F.col("p.component") != F.col("h.component")) & once
    meet &= F.least("p.size", "h.size") >= similarity * F.greatest("p.size", "h.size") - 1e-6
    meet &= odd * (1 + similarity) <= (1 - similarity) * sizes + 1e-6
    met = outside.alias("p").join(held.alias("h"), meet)
    pairs = met.select(F.least("p.node", "h.node").alias("src"), F.greatest("p.node", "h.node").alias("dst"), odd.alias("apart")).distinct()
    # Sets of many shingles have too many differences for so few parities: they are asked for more.
    long = values.where("more is not null").select("node", "size", "more")
    both = pairs.join(long.toDF("src", "n", "a"), "src", "left").join(long.toDF("dst", "m", "b"), "dst", "left").select("src", "dst", "apart", "n", "m", "a", "b")

    def run(it):
        for batch in it:
            may = []
            for n, m, a, b in zip(*(batch.column(k) for k in range(3, 7))):
                if not (a.is_valid and b.is_valid):
                    may.append(True)
                    continue
                a, b = sorted((x.values.to_numpy(zero_copy_only=False) for x in (a, b)), key=len)
                b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
                odd = np.unpackbits((a ^ b).view(np.uint8)).sum(dtype=np.int64)
                may.append(bool(odd * (1 + similarity) <= (1 - similarity) * (n.as_py() + m.as_py()) + 1e-6))
            yield batch.select(["src", "dst", "apart"]).filter(pa.array(may, pa.bool_()))

    return both.mapInArrow(run, "src long, dst long, apart int")


def similar_links(values: DataFrame, width: int, similarity: float, recall: float, shingles: Shingles | None = None) -> DataFrame:
    """(src, dst): nodes to connect; ``values``: (node long, fp array<long>), written down.  First every fingerprint is
    held against the first of each bucket it probes; then those of different components against each other, in a bucket
    with members of a component of LARGE or more those outside the largest such component against all.  At first two words of the
    fingerprint go along with the buckets and tell nearly all strangers apart, and pairs that pass are held against each other whole; then all
    words go along, so that of two families that are alike no pair but the linked ones is made.  The estimate decides; with ``shingles`` the links
    to the first of each bucket are held against their texts' shingles instead, and ``leading_pairs`` does the rest."""
    n, correlations = bit_statistics(values, width)
    chosen = wide_plan(n, correlations, sampled_bits(values, width), similarity, recall)
    least, whole = _at_most(similarity, 2 * BITS, 2.6), _at_most(similarity, width * BITS, 1.3)

    def dealt(rows: DataFrame, flips: bool, *more: str, words: int = 2) -> DataFrame:
        """(node, c0, c1, ..., at) and ``more``: a row for each bucket that a fingerprint stands in, or probes."""
        keys, around = [], []
        for k, (part, most) in enumerate(zip(chosen.parts, chosen.thresholds)):
            key = F.col("fp")[part[0] // BITS].bitwiseAND(F.lit(_mask(part)))
            own = lambda f, k=k, key=key: F.xxhash64(F.lit(k), key.bitwiseXOR(f))
            if flips and most:
                around.append(F.transform(_masks(_flips(tuple(b % BITS for b in part), most)), own))
            else:
                keys.append(own(F.lit(0).cast("long")))
        every = F.concat(F.array(*keys).cast("array<bigint>"), *around) if around else F.array(*keys)
        return rows.select("node", *[F.col("fp")[w].alias(f"c{w}") for w in range(words)], *more, F.explode(every).alias("at"))

    def bits(a: str, b: str, words: int) -> Column:
        return sum((F.bit_count(F.col(f"{a}.c{w}").bitwiseXOR(F.col(f"{b}.c{w}"))) for w in range(words)), F.lit(0))

    def near(a: str, b: str, words: int, most: int) -> Column:
        return bits(a, b, words) <= most

    def verified(pairs: DataFrame) -> DataFrame:
        ends = values.select(F.col("node").alias("src"), F.col("fp").alias("a")), values.select(F.col("node").alias("dst"), F.col("fp").alias("b"))
        both = pairs.distinct().join(ends[0], "src").join(ends[1], "dst").select("src", "dst", _bits_apart("a", "b", range(width)).alias("apart"))
        return both.where(F.col("apart") <= whole)

    flips = any(chosen.thresholds)
    homes = dealt(values, False)
    # A bucket's first is the one whose buckets are the most crowded in all: of a family, one from its middle, which has the most links.
    counts = homes.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    rows, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    crowded = cut(counts.where(F.col("n") > LARGE + 4 * rows / max(1, kinds)))
    few = crowded.count() <= FEW
    crowds = homes.select("node", "at").join(F.broadcast(crowded) if few else crowded, "at").groupBy("node").agg(F.floor(3 * F.log2(F.sum("n").cast("double"))).alias("middle"))
    order = F.shiftleft(F.coalesce("middle", F.lit(0)), 56) + F.col("node")
    ordered = cut(values.join(crowds, "node", "left").select("node", "fp", order.alias("order")))
    homes, probes = dealt(ordered, False, "order"), dealt(ordered, flips)
    first = homes.groupBy("at").agg(F.max("order").bitwiseAND(F.lit((1 << 56) - 1)).alias("node"), F.count(F.lit(1)).alias("n")).where(F.lit(flips) | (F.col("n") > 1))
    first = first.select("at", "node").join(values.select("node", F.col("fp")[0].alias("c0"), F.col("fp")[1].alias("c1")), "node")
    star = probes.alias("p").join(first.alias("h"), (F.col("p.at") == F.col("h.at")) & (F.col("p.node") != F.col("h.node")) & near("p", "h", 2, least))
    stars = cut(verified(star.select(F.least("p.node", "h.node").alias("src"), F.greatest("p.node", "h.node").alias("dst"))))
    if shingles is not None:
        return shingles.confirmed(stars)
    found = components(stars)
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    large = F.when(F.col("size") >= LARGE, F.struct("size", "component"))
    named = cut(values.join(found.join(size, "component").select("node", "component", large.alias("large")), "node", "left").select("node", "fp", F.coalesce("component", "node").alias("component"), "large"))
    homes, probes = dealt(named, False, "component", words=width), dealt(named, flips, "component", words=width)
    chief = dealt(named.where("large is not null"), False, "large", words=0).groupBy("at").agg(F.max("large")["component"].alias("chief"))
    outside = probes.join(chief, "at", "left").where("chief is null or chief <> component").alias("p")
    once = (F.col("p.node") < F.col("h.node")) | F.col("p.chief").eqNullSafe(F.col("h.component"))
    apart = (F.col("p.at") == F.col("h.at")) & (F.col("p.component") != F.col("h.component")) & once & near("p", "h", width, whole)
    met = outside.join(homes.alias("h"), apart).select(F.least("p.node", "h.node").alias("src"), F.greatest("p.node", "h.node").alias("dst"), bits("p", "h", width).alias("apart"))
    return stars.unionAll(met).select("src", "dst")


def group_similar(prints: DataFrame, width: int = 8, similarity: float = 0.8, recall: float = 0.97, docs: DataFrame | None = None, words: int = 5) -> DataFrame:
    """(doc_id, component_id) for rows (doc_id, fp array<long>, mark): the smallest doc_id reachable over links between
    texts whose similarity is ``similarity`` or more, the row's own included.  With ``docs``, the texts of the fingerprints, these are all pairs whose sets of
    shingles have it, and no others (``prints`` may be ``set_fingerprints``, which spares a pass); else the similarity is estimated."""
    if docs is not None:
        return _group_exactly(prints if "kin" in prints.columns else set_fingerprints(docs, words, width), width, similarity, recall, docs, words)
    prints = cut(prints)
    values = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).select(F.monotonically_increasing_id().alias("node"), "fp", "first_id"))
    linked = components(cut(similar_links(values.select("node", "fp"), width, similarity, recall).distinct()))
    return _named(prints, "fp", values, linked)


def _group_exactly(prints: DataFrame, width: int, similarity: float, recall: float, docs: DataFrame, words: int) -> DataFrame:
    """``group_similar`` of texts: links of the fingerprints, confirmed, then those between the groups that follow.  Texts of one set are one node."""
    prints = cut(prints)
    of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "fp", "size", "parities", "more"))
    first = prints.groupBy("kin").agg(of.alias("first"))
    values = cut(first.select(F.monotonically_increasing_id().alias("node"), "kin", F.col("first.doc_id").alias("first_id"), *[f"first.{c}" for c in ("mark", "fp", "size", "parities", "more")]))
    shingles = Shingles(docs, words, similarity, values)
    links = cut(similar_links(values.select("node", "fp"), width, similarity, recall, shingles).distinct())
    found = cut(components(links, small=FEW_LINKS))
    more = cut(shingles.confirmed(leading_pairs(values, leading_shingles(docs, words, similarity), found, similarity)))
    return _named(prints, "kin", values, components(links.unionAll(more), small=FEW_LINKS))


def _named(prints: DataFrame, key: str, values: DataFrame, linked: DataFrame) -> DataFrame:
    joined = values.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "component").select(key, "component_id")
    return prints.select("doc_id", key).join(named, key).select("doc_id", "component_id")


def hexadecimal(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of linked texts; columns as they are.
    A document is its id: rows that repeat a kept id all stay."""
    return _first(docs, group(fingerprints(docs, words), distance))


def keep_first_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 8) -> DataFrame:
    """As ``keep_first``, with texts linked by the similarity of their shingles: every two texts of that similarity are in one group, and each text
    that goes has it with another of its group."""
    return _first(docs, group_similar(set_fingerprints(docs, words, width), width, similarity, docs=docs, words=words))


def _first(docs: DataFrame, found: DataFrame) -> DataFrame:
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
