"""Importance resampling, centroid clustering and suffix dedup against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gramian.llm import centroids, resampling, suffixes

SCHEMA = "doc_id long, text string, mark long, twin string, rank int, weight double, key string, score double"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "t", 1, 0.5, "k", 2.0) for i, t in rows], SCHEMA)


def words_of(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = [(k, words_of(rng, rng.randrange(1, 90))) for k in range(50)]
    rows += [(100, rows[5][1]), (101, "B " + rows[5][1] + ", Tail-End 7up"), (102, None), (103, ""), (104, " \n\t ."), (105, "one"), (None, "no id " * 12), (106, words_of(rng, 30))]
    shared = words_of(rng, 60)
    rows += [(107, "É ñandú—x " + shared), (108, shared + " ünd " + shared), (109, words_of(rng, 4000)), (7, rows[7][1]), (110, "ab" * 700), (111, "x" * 1500 + " y"), (112, "w" * 300 + " " + rows[9][1])]
    return rows


# --- importance resampling


def brute_resampled(rows, target, percent, least, buckets):
    rx = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t):
        w = rx.findall((t or "").encode().lower())
        return len(w), [b" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    of = lambda x: zlib.crc32(x) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(of, features(x)[1]))
    for x in target:
        t.update(map(of, features(x)[1]))
    big, small = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(y)] for y in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in out], key=str)


@pytest.mark.parametrize("frequent", [1 << 18, 40, 1])
def test_resampling(spark, corpus, frequent):
    target = [corpus[3][1], "W7 w8 other-words", None, ""]
    found = resampling.resample(table(spark, corpus), spark.createDataFrame([(t,) for t in target], "text string"), percent=40, buckets=100, frequent=frequent).collect()
    assert sorted(map(tuple, found), key=str) == brute_resampled(corpus, target, 40, 20, 100)


def test_resampling_with_empty_tables(spark, corpus):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(table(spark, []), nothing).count() == 0
    found = resampling.resample(table(spark, corpus[:4]), nothing, percent=100, least_words=1).collect()
    assert sorted(map(tuple, found), key=str) == brute_resampled(corpus[:4], [], 100, 1, 10_000)


def test_crc_of_strings_side_by_side():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randrange(50)), rng.randbytes(n)) for n in (0, 1, 5, 63, 64, 65, 127, 200, 5000, 70_000)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    got = resampling.compose(crc(0), crc(1), np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_automaton_finds_delimited_words_only():
    import pyarrow as pa

    part = resampling.Slice(pa.array(["Car cart ca car", "car", None, "scar-car"]))
    crc, lengths = resampling.Dictionary([b"car", b"ca"]).payloads(part)
    words = [b"car", b"cart", b"ca", b"car", b"car", b"scar", b"car"]
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    assert lengths.tolist() == [len(w) for w in words]
    assert part.first.tolist() == [0, 4, 5, 5, 7]


# --- centroid clustering


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        new = []
        for n, x in enumerate(c):
            own = [v for (_, v), o in zip(kept, of) if o == n]
            new.append([sum(y) // len(own) for y in zip(*own)] if own else x)
        c = new
    end = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in end:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted([(i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in end], key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, codes int")


@pytest.mark.parametrize("most", [4096, 200, 3])
def test_centroids(spark, most):
    """With all dictionaries merged, with those of single dimensions, and with dimensions that have none."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(i, [float(i % 2)] * 5 + [float(i % 3)]) for i in range(300, 340)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (400, None), (401, [0.5] * 5), (402, [None] + [0.5] * 5), (403, [float("nan")] + [0.5] * 5), (404, [float("inf")] + [0.5] * 5), (405, [])]
    found = centroids.cluster(vectors(spark, rows), k=5, rounds=3, dims=6, most=most).collect()
    assert sorted(map(tuple, found), key=str) == brute_clusters(rows, 5, 3, 6, 64)


def test_centroids_with_few_and_equal_vectors(spark):
    rows = [(i, [0.25, -0.5]) for i in range(30)] + [(31, [3.0, 4.0])]
    found = centroids.cluster(vectors(spark, rows), k=40, rounds=2, dims=2).collect()
    assert sorted(map(tuple, found), key=str) == brute_clusters(rows, 40, 2, 2, 64)
    assert centroids.cluster(vectors(spark, []), dims=2).collect() == []


def test_dictionaries_hold_the_subvectors_there_are():
    left, right = centroids.Block((0,), np.array([[-1], [2]])), centroids.Block((1,), np.array([[0], [5], [9]]))
    both = centroids.Block((0, 1), np.array([[-1, 5], [2, 0]]), (left, right), np.array([-1, 0, -1, 1, -1, -1]))
    v = np.array([[2, 0], [-1, 5]])
    assert both.entries[both.codes(v)].tolist() == v.tolist()
    assert both.distances(np.array([[0, 0], [2, 5]])).tolist() == [[26, 9], [4, 25]]


# --- suffix dedup


def brute_bytes(rows, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[k : k + length] for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, most", [(400, 20_000), (60, 20_000), (60, 3), (16, 2)])
def test_suffixes(spark, corpus, length, most):
    """Also with cores dealt over several tasks, where windows meet by their hashes."""
    found = suffixes.digests(table(spark, corpus), length, most_strings=most).collect()
    assert sorted(map(tuple, found), key=str) == brute_bytes(corpus, length)


def test_suffixes_at_the_edges_of_a_common_passage(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = letters(90)
    rows = [(k, letters(rng.randrange(80)) + passage[rng.randrange(4) : 90 - rng.randrange(4)] + letters(rng.randrange(80))) for k in range(60)]
    rows += [(60, passage), (61, passage[:39] + "Z"), (62, passage[:40] + passage[:40])]
    for most in (20_000, 7):
        found = suffixes.digests(table(spark, rows), 40, most_strings=most).collect()
        assert sorted(map(tuple, found), key=str) == brute_bytes(rows, 40)
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.remove(table(spark, rows), 40).collect()}
    assert kept[60] == b"" and len(kept) == 63


def test_suffixes_with_empty_tables_and_short_windows(spark):
    assert suffixes.digests(table(spark, [])).count() == 0
    assert [tuple(r)[1:4] for r in suffixes.digests(table(spark, [(1, None), (2, "")])).collect()] == [(0, 0, 0)] * 2
    with pytest.raises(ValueError, match="fewer than 16"):
        suffixes.digests(table(spark, []), 8)


@pytest.mark.parametrize("shard", [1, 3, 100])
def test_merged_transforms_are_the_order_of_all_suffixes(shard):
    """Interleave, common prefixes and counts against sorted suffixes."""
    rng = random.Random(shard)
    strings = [np.array([rng.randrange(1, 4) for _ in range(rng.randrange(1, 25))], np.uint16) for _ in range(40)]
    for depth in (1, 4, 9):
        begins, times = suffixes.repeated_substrings(strings, np.ones(40, np.int64), depth, shard)
        seen = Counter(tuple(s[k : k + depth]) for s in strings for k in range(len(s) - depth + 1))
        for s, b in zip(strings, begins):
            assert [int(x) for x in times[b : b + len(s) + 1]] == [seen[tuple(s[k : k + depth])] if k + depth <= len(s) else 0 for k in range(len(s) + 1)]
    parts = [suffixes.transform(np.concatenate([np.append(s, 0) for s in strings[a : a + shard]]), np.cumsum([len(s) + 1 for s in strings[a : a + shard]]) - 1) for a in range(0, 40, shard)]
    places, common = suffixes.merge([p[1] for p in parts], 30)
    texts = [tuple(s[k:].tolist()) for a in range(0, 40, shard) for j in [None] for s, k in _ordered(strings[a : a + shard], parts[a // shard][0])]
    merged = [texts[p] for p in places]
    assert merged == sorted(texts)
    lcp = [0] + [next((h for h, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(merged, merged[1:])]
    assert common.tolist() == lcp


def _ordered(strings, order):
    ends = np.cumsum([len(s) + 1 for s in strings])
    for p in order.tolist():
        k = int(np.searchsorted(ends, p, side="right"))
        yield np.append(strings[k], 0)[:-1], p - int(ends[k] - len(strings[k]) - 1)
