"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex

from gramian.llm import batches, bpe, decontaminate, langid, lattice, quality, secrets, simhash, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, "x", "k") for i, t, lang in rows], SCHEMA)


def words_of(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(k, words_of(rng, rng.randrange(1, 160)), "en") for k in range(60)]
    rows += [(100, rows[5][1], "en"), (101, rows[5][1] + " tail", "en"), (102, None, None), (103, "", "en"), (104, " \n\t ", None), (105, "one", "en")]
    shared = words_of(rng, 70)
    rows += [(106, "a b c " + shared + " d", "en"), (107, shared, "en"), (108, "x " * 20 + shared, "en"), (109, words_of(rng, 9000), "en")]
    rows += [(None, shared, "en"), (110, "É x " * 30, "fr"), (7, rows[7][1], "en")]
    return rows


# --- substring dedup


def brute_removed(rows, length):
    first = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - length + 1):
            if i is not None:
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [6, 50])
def test_substrings(spark, corpus, length):
    found = substrings.digests(table(spark, corpus), length).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == brute_removed(corpus, length)
    assert sorted(((r.doc_id, r.longest) for r in found), key=str) == brute_longest(corpus, length)


def brute_longest(rows, length):
    """By id: the greatest doubling at which a window also starts under another id (of rows without an id: 0)."""
    best, size = {}, length
    while True:
        owners = {}
        for i, t, _ in rows:
            w = (t or "").encode().split()
            for k in range(len(w) - size + 1):
                if i is not None:
                    owners.setdefault(tuple(w[k : k + size]), set()).add(i)
        alive = {i for ids in owners.values() if len(ids) > 1 for i in ids}
        if not alive:
            break
        best |= dict.fromkeys(alive, size)
        size *= 2
    return sorted(((i, best.get(i, 0)) for i, _, _ in rows), key=str)


def test_substrings_text_and_longest(spark):
    w = [f"a{k}" for k in range(300)]
    rows = [(1, " ".join(w), ""), (2, "x " + " ".join(w[:210]), ""), (3, "y", "")]
    kept = {r.doc_id: r.kept for r in substrings.remove(table(spark, rows)).collect()}
    assert kept == {1: " ".join(w), 2: "x", 3: "y"}
    assert {tuple(r) for r in substrings.longest(table(spark, rows)).collect()} == {(1, 200), (2, 200)}
    assert substrings.digests(table(spark, [])).count() == 0


def test_long_words_have_hashes_of_their_own():
    """Two words of 2,048 letters that sums of powers modulo 2**64 can't tell apart."""
    a = b"ab"
    while len(a) < 2048:
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(a + a.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    starts, ends = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(batches.span_hashes(data, starts, ends).tolist())) == 1
    assert len(set(batches.word_hashes(data, starts, ends).tolist())) == 2


# --- SimHash


def brute_components(prints, distance):
    parent = list(range(len(prints)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= distance:
                parent[root(a)] = root(b)
    ids = {}
    for a, (i, _) in enumerate(prints):
        ids.setdefault(root(a), []).append(i)
    return sorted(((i, min((x for x in ids[root(a)] if x is not None), default=None)) for a, (i, _) in enumerate(prints)), key=str)


def test_simhash_fingerprints(spark, corpus):
    import xxhash

    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert [int(x) for x in simhash.fingerprint(b"a b c d e f", 4, 3)][:1] == [int(simhash.fingerprint(b"a b c d e f", 4)[0])]
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.fingerprints(table(spark, corpus)).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t, _ in corpus), key=str)
    first = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert int(simhash.fingerprint(b"a b c d", 4)[0]) == first & (1 << 64) - 1


@pytest.mark.parametrize("distance,heavy", [(4, 20_000), (4, 2), (3, 2), (7, 20_000), (7, 2)])
def test_simhash_groups(spark, distance, heavy):
    rng = random.Random(distance)
    prints = []
    for k in range(25 if heavy > 2 else 8):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))  # chains
            prints.append((rng.randrange(500), base))
    prints += [(None, prints[0][1]), (None, 12345), (3, prints[5][1]), (3, prints[5][1])]
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in prints], "doc_id long, fp long")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.group(df, distance, heavy).collect()), key=str)
    assert got == brute_components(prints, distance)


def test_simhash_plan_covers_every_pattern():
    rng = np.random.default_rng(1)
    for n in (10, 50_000, 10_000_000):
        p = simhash.plan(n, np.corrcoef(rng.normal(size=(64, 300))), rng.integers(0, 2, (200, 64)), 4)
        assert sum(t + 1 for t in p.thresholds) == 5
        bits = [b for part in p.parts for b in part]
        assert len(bits) == len(set(bits))


def test_wide_plan_reaches_its_recall():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (300, 512))
    p = simhash.differing(0.8)
    for n in (1000, 1_000_000, 100_000_000):
        chosen = simhash.wide_plan(n, [np.eye(64)] * 8, bits, 0.8, 0.95)
        used = [b for part in chosen.parts for b in part]
        assert len(used) == len(set(used)) and all(len({b // 64 for b in part}) == 1 for part in chosen.parts)
        miss = math.prod(1 - sum(math.comb(len(g), k) * p**k * (1 - p) ** (len(g) - k) for k in range(t + 1)) for g, t in zip(chosen.parts, chosen.thresholds))
        assert miss <= 0.05


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


@pytest.fixture(scope="module")
def near_copies():
    """300 texts, 240 of them with a copy in which some words are changed, and one text with 150 such copies."""
    rng, texts = random.Random(21), []
    for k in range(300):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        if k < 240:
            for _ in range(1 if k else 150):
                copy = list(words)
                for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                    copy[rng.randrange(len(words))] = f"u{rng.randrange(4000)}"
                texts.append(" ".join(copy))
    return [(k, t, "en") for k, t in enumerate(texts)] + [(9000, None, None), (9001, "", "en"), (9002, "one", "en"), (9003, texts[5], "en"), (None, texts[6], "en"), (8, texts[8], "en")]


def test_similar_texts_against_jaccard(spark, near_copies):
    """Of all pairs with a similarity of 0.8 or more 90 % and more are in one group, and no group holds strangers."""
    df = table(spark, near_copies)
    got = [(r.doc_id, r.component_id) for r in simhash.group_similar(simhash.wide_fingerprints(df)).collect()]
    assert sorted((i for i, _ in got), key=str) == sorted((i for i, _, _ in near_copies), key=str)
    component = dict(got)
    rows = [(i, shingles(t)) for i, t, _ in near_copies if i is not None]
    near = found = 0
    for a in range(len(rows)):
        for b in range(a):
            same = component[rows[a][0]] == component[rows[b][0]]
            j = jaccard(rows[a][1], rows[b][1])
            near, found = near + (j >= 0.8), found + (j >= 0.8 and same)
            assert not same or j > 0.3
    assert near > 500 and found >= 0.9 * near
    # Not through the large group alone:
    alone = [(a, b) for a in range(len(rows)) for b in range(a) if min(rows[a][0], rows[b][0]) > 151 and jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert len(alone) > 50 and sum(component[rows[a][0]] == component[rows[b][0]] for a, b in alone) >= 0.9 * len(alone)
    assert component[9000] == component[9001] == 9000 and component[9002] == 9002 and component[9003] == component[5]
    assert all(c is not None for c in component.values())


def test_keep_first_similar(spark, near_copies):
    """Whatever goes has the similarity with another text of its group, and nine in ten of the pairs that have it are in one group."""
    df = table(spark, near_copies)
    kept = simhash.keep_first_similar(df)
    rows = simhash.group_similar(simhash.wide_fingerprints(df), docs=df).collect()
    component = {r.doc_id: r.component_id for r in rows}
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted([i for i, _, _ in near_copies if i is not None and component[i] == i])
    assert simhash.keep_first_similar(df.limit(0)).count() == 0
    sets = [(i, shingles(t)) for i, t, _ in near_copies if i is not None]
    linked, near, found = set(), 0, 0
    for a in range(len(sets)):
        for b in range(a):
            if jaccard(sets[a][1], sets[b][1]) >= 0.8:
                same = component[sets[a][0]] == component[sets[b][0]]
                near, found = near + 1, found + same
                linked |= {sets[a][0], sets[b][0]} if same else set()
    assert found >= 0.9 * near
    assert all(component[i] == i or i in linked for i, _ in sets)


def test_similar_groups_are_those_of_all_pairs(spark, near_copies):
    """Copies of a similarity about 0.8, of short texts and of long ones, and texts that share a line many times, or a common passage, but little else: the groups are
    those of the pairs with 0.8 or more, none more and none less."""
    rng, texts = random.Random(4), []
    for k in range(400):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.choice((30, 60, 120, 250, 700 if k % 4 else 1500)))]
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.018, 0.03)))):
            copy[at] = "other"
        texts += [" ".join(words), " ".join(copy)]
    line, passage = " ".join(f"l{k}" for k in range(9)), " ".join(f"p{k}" for k in range(60))
    for k in range(60):
        texts += [f"{line} " * 40 + " ".join(f"x{rng.randrange(9000)}" for _ in range(30)), passage + " " + " ".join(f"x{rng.randrange(9000)}" for _ in range(rng.randrange(5, 120)))]
    rows = near_copies + [(20_000 + k, t, "en") for k, t in enumerate(texts)] + [(30_000, texts[0].upper(), "en"), (30_001, texts[-1] + " " + texts[-1], "en")]
    df = table(spark, rows)
    got = {r.doc_id: r.component_id for r in simhash.group_similar(simhash.set_fingerprints(df), docs=df).collect() if r.doc_id is not None}
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(frozenset(shingles(t)), []).append(i)
    own, holders, parent = list(sets), {}, {}
    for k, own_set in enumerate(own):
        for x in own_set:
            holders.setdefault(x, []).append(k)

    def root(k):
        while parent.get(k, k) != k:
            k = parent[k]
        return k

    borderline = 0
    for k, own_set in enumerate(own):
        for other in {j for x in own_set for j in holders[x] if j < k}:
            j = jaccard(own_set, own[other])
            borderline += 0.78 <= j < 0.82
            if j >= 0.8 and root(k) != root(other):
                parent[root(k)] = root(other)
    assert borderline > 100
    groups, found = {}, {}
    for k, own_set in enumerate(own):
        groups.setdefault(root(k), set()).update(i for i in sets[own_set] if i is not None)
    for i, c in got.items():
        found.setdefault(c, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
    assert all(c == min(members) for c, members in found.items())


def test_simhash_keep_first(spark, corpus):
    kept = simhash.keep_first(table(spark, corpus))
    assert kept.columns == table(spark, []).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 5 in ids and 100 not in ids and 102 in ids and 103 not in ids and 104 not in ids
    assert ids.count(7) == 2
    assert simhash.keep_first(table(spark, [])).count() == 0


# --- language ID and quality


def test_language(spark):
    rng = random.Random(1)
    alphabet = {"xx": "abcdefg", "yy": "nopqrst", "zz": "éàùçabc"}
    rows = [(k, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(6)) for _ in range(rng.randrange(3, 60))), lang) for k, lang in enumerate(["xx", "yy", "zz"] * 40)]
    network = langid.fit(table(spark, rows))
    test = rows[:30] + [(900, None, None), (901, "", None), (902, "12 !! 34", None), (903, "gfeg " * 5000, None), (None, rows[0][1], None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table(spark, test), network).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows[:30]) >= 29
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903][0] == "xx" and 0 <= got[903][1] <= 1 and None in got
    kept = langid.annotate(table(spark, test), network)
    assert kept.count() == len(test) and kept.columns.count("score") == 1
    assert langid.predict(table(spark, []), network).count() == 0 and langid.annotate(table(spark, []), network).count() == 0
    assert langid.predict(table(spark, rows[:1] * 2), network).count() == 2
    assert langid.fit(table(spark, [(1, None, "xx"), (2, "a", None)])) is None
    assert [r.lang_pred for r in langid.predict(table(spark, rows[:2]), None).collect()] == ["und", "und"]


def test_network_tables_agree_with_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    net = langid.train(x, np.array([0, 1, 0, 1, 0]), ["a", "b"], langid.Settings(window=40, epochs=1))
    e = net.embed[x]
    direct = []
    for w in net.settings.widths:
        z = np.stack([sum(e[:, t + j] @ net.kernels[w][j] for j in range(w)) for t in range(40 - w + 1)], 1)
        direct.append(z.max(1) + net.biases[w])
    assert np.allclose(net.pooled(x), np.maximum(np.concatenate(direct, 1), 0), atol=1e-4)


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(20, 200)))
    bad = lambda: " ".join(x + "###" for x in good().split())
    rows = [(k, good() if k % 2 else good() + "\n" + bad(), "") for k in range(160)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _, _ in rows] + [(None, 1, 0), (999, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(table(spark, rows[:120]), labels, quality.Settings(epochs=40))
    got = {r.doc_id: r.score for r in quality.score(table(spark, rows[120:] + [(900, None, ""), (901, "", ""), (902, "a " * 30000, "")]), model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i, _, _ in rows[120:]]) >= 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert quality.fit(table(spark, rows), labels.where("quality = 1")) == 1.0
    assert quality.score(table(spark, []), model).count() == 0
    assert quality.score(table(spark, rows[:1] * 2), model).count() == 2
    assert [r.score for r in quality.score(table(spark, rows[:2]), quality.fit(table(spark, rows), labels.limit(0))).collect()] == [0.5, 0.5]


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, quality.FEATURES)).astype(np.float64)
    bounds, y = np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.Model(quality.Settings(hidden=4, attention=3), x.mean(0), x.std(0) + 0.1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    loss = lambda: float(np.mean(np.log1p(np.exp(z := model.forward(x, bounds)["logit"])) - y * z))
    g = model.gradients(x, bounds, y)
    for name, value in model.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        before = value[at]
        value[at] = before + 1e-5
        up = loss()
        value[at] = before - 1e-5
        down = loss()
        value[at] = before
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


# --- lattice


def test_lattice_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a"]
    weights = np.log(np.array([0.2, 0.1, 0.3, 0.1, 0.1, 0.1, 0.1]))
    table_, order = lattice.index(pieces, weights)
    p = dict(zip(pieces, np.exp(weights)))

    def total(w):
        return 1.0 if not w else sum(p[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p)

    words = [b" aba", b" b", b" abababab", b" a", b" bba"]
    assert np.allclose(np.exp(lattice.word_log_probabilities(words, table_)), [total(w) for w in words])

    def expected(w, piece):
        def walk(rest, prob, n):
            return prob * n if not rest else sum(walk(rest[k:], prob * p[rest[:k]], n + (rest[:k] == piece)) for k in range(1, len(rest) + 1) if rest[:k] in p)

        return walk(w, 1.0, 0) / total(w)

    found = np.zeros(len(pieces))
    for _, m in lattice._same_length(words):
        found[order] += lattice.Lattice(m, table_).expected(len(pieces))
    assert np.allclose(found, [sum(expected(w, x) for w in words) for x in pieces])


@pytest.mark.parametrize("rounds", [0, 1])
def test_lattice_scores(spark, corpus, rounds):
    rows = [r for r in corpus if r[0] != 7]
    got = {r.doc_id: r for r in lattice.score(table(spark, rows), P.path("piece_bpe_32k.model"), rounds=rounds).collect()}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    docs = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, _ in rows}
    c = Counter(w for i, ws in docs.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(docs)
    for i, ws in docs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    # The scores, from the definitions, over all segmentations.
    pieces, weights = lattice.read_vocabulary(P.path("piece_bpe_32k.model"))
    p = dict(zip(pieces, np.exp(weights)))
    q = (c[b"\n"] + 1) / (n + 2)

    def chance(w):
        at = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            at[e] = sum(at[b] * p[w[b:e]] for b in range(e) if w[b:e] in p)
        return at[-1]

    plain = {w: q if w == b"\n" else (1 - q) * chance(b" " + w) for ws in docs.values() for w in ws}
    moved = plain
    if rounds:
        # Expected counts of the pieces, by walking every segmentation forwards and backwards.
        counts = dict.fromkeys(pieces, 0.1)
        for w in (b" " + w for w in c if w != b"\n"):
            size = len(w)
            to, fro = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for e in range(1, size + 1):
                to[e] = sum(to[b] * p[w[b:e]] for b in range(e) if w[b:e] in p)
            for b in range(size - 1, -1, -1):
                fro[b] = sum(p[w[b:e]] * fro[e] for e in range(b + 1, size + 1) if w[b:e] in p)
            for b in range(size):
                for e in range(b + 1, size + 1):
                    if w[b:e] in p:
                        counts[w[b:e]] += to[b] * p[w[b:e]] * fro[e] / to[size]
        total = sum(counts.values())
        p = {x: k / total for x, k in counts.items()}
        moved = {w: q if w == b"\n" else (1 - q) * chance(b" " + w) for w in plain}
    # The share of the lattice, by what each half of the training documents says of the other.
    half = {r.doc_id: r.part for r in lattice._documents(table(spark, rows), "doc_id", "text", 10).select("doc_id", "part").collect()}
    parts = [Counter(w for i, ws in docs.items() if half[i] == k for w in ws) for k in (1, 2)]
    assert parts[0] + parts[1] == c and all(parts)

    def told(s):
        return sum(k * math.log((a[w] + s * len(a) * moved[w]) / (sum(a.values()) + s * len(a))) for a, b in (parts, parts[::-1]) for w, k in b.items())

    share = max(lattice.SHARES, key=told)
    weight = share * v
    for i, ws in docs.items():
        assert math.isclose(got[i].vocabulary_score, sum(math.log10(plain[w]) for w in ws), rel_tol=1e-9)
        assert math.isclose(got[i].score, sum(math.log10((c[w] + weight * moved[w]) / (n + weight)) for w in ws), rel_tol=1e-9)


def test_words_of_the_lattice_sum_to_one_at_most():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b"bb"]
    rng = np.random.default_rng(4)
    weights = np.log(rng.dirichlet(np.where([p[0] in b" ab" for p in pieces], 20.0, 1e-3)))
    table_, _ = lattice.index(pieces, weights)
    words = [b""]
    total = 0.0
    for _ in range(9):
        words = [w + x for w in words for x in (b"a", b"b")]
        total += np.exp(lattice.word_log_probabilities([b" " + w for w in words], table_)).sum()
        assert total <= 1 + 1e-9
    assert total > 0.5


def test_lattice_of_rows_that_share_ids_and_of_empty_tables(spark):
    """Every row is a document of its own."""
    path = P.path("piece_bpe_32k.model")
    assert lattice.score(table(spark, []), path).count() == 0
    rows = [(1, "a b", ""), (1, "a b", ""), (1, "c", ""), (2, None, ""), (None, "d e f", ""), (None, "", "")]
    got = lattice.score(table(spark, rows), path, rounds=1).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted([(1, 3), (1, 3), (1, 2), (2, 1), (None, 4), (None, 1)], key=str)
    assert all(r.score < 0 and r.vocabulary_score < 0 for r in got)
    nothing = lattice.score(table(spark, [(None, "a b", "")]), path).collect()
    assert nothing[0].base_score is None and nothing[0].train_tokens == 0 and nothing[0].score < 0


def test_lattice_of_a_very_long_word(spark):
    """A word of 50,000 letters beside short ones."""
    rng = random.Random(12)
    word = "".join(rng.choice("abcdeé") for _ in range(50_000))
    got = {r.doc_id: r for r in lattice.score(table(spark, [(1, "a b c", ""), (2, word + " a", ""), (3, "b", "")]), P.path("piece_bpe_32k.model")).collect()}
    assert got[2].n_tokens == 3 and -400_000 < got[2].vocabulary_score < -50_000 and math.isfinite(got[2].score)


# --- secrets

JWT = ".".join(__import__("base64").urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) + ".c2lnbmF0dXJl"


def der(tag, body):
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big")) + body


def test_secret_spans():
    from base64 import b64encode

    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 60) for k in range(8)))
    public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48")) + der(3, b"\0" * 80))
    assert secrets.is_der_key(key) and not secrets.is_der_key(key[:-1]) and not secrets.is_der_key(key + b"x") and not secrets.is_der_key(public)
    blob = b64encode(key).decode()
    assert ("key", 4, 4 + len(blob)) in secrets.spans("éé: " + blob + " x")
    assert ("key", 0, 2 * len(key)) in secrets.spans(key.hex())
    assert [k for k, _, _ in secrets.spans(b64encode(public).decode())] == []
    assert secrets.spans("x " + JWT) == [("token", 2, 2 + len(JWT))]
    assert secrets.spans("x " + JWT.replace("eyJ", "eyK", 1)) == []
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(blob[k : k + 64] for k in range(0, len(blob), 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert ("pem", 1, 1 + len(pem)) in secrets.spans("\n" + pem)
    hidden = b64encode(b'{"password": "correcthorse"}').decode()
    assert secrets.spans(hidden) == [("encoded", 0, len(hidden))]


def test_secrets_in_url_safe_base64_and_in_lines():
    from base64 import b64encode, urlsafe_b64encode

    rng = random.Random(6)
    fields = b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"", rng.randbytes(300)))
    for key in (der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) + rng.randbytes(59)) for k in range(8))), b"openssh-key-v1\0" + fields):
        standard, safe = b64encode(key).decode(), urlsafe_b64encode(key).decode()
        assert "-" in safe and "_" in safe
        for blob in (safe, safe.rstrip("=")):
            assert secrets.spans("é: " + blob + " x") == [("key", 3, 3 + len(blob))]
        for blob in (standard, safe):
            for end in ("\n", "\r\n", "\n  "):
                lines = end.join(blob[k : k + 64] for k in range(0, len(blob), 64))
                assert ("key", 4, 4 + len(lines)) in secrets.spans("é:\n " + lines + "\n\nx")
                assert secrets.redacted("é:\n" + lines + "\n\nx") == "é:\n[REDACTED]\n\nx"
    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 60) for k in range(9)))
    blob = b64encode(key).decode().rstrip("=")
    lines = "\n".join(blob[k : k + 76] for k in range(0, len(blob), 76))
    assert ("key", 4, 4 + len(lines)) in secrets.spans("key=" + lines + "\nNext words")
    hidden = urlsafe_b64encode(b"password = hunter222 >>?~~?>>~").decode()
    assert "-" in hidden or "_" in hidden
    assert secrets.spans(hidden) == [("encoded", 0, len(hidden))]
    long = b64encode(b"nothing to see here, " * 4 + b"password: 'correcthorse'" + b" and more" * 9).decode()
    lines = "\n".join(long[k : k + 60] for k in range(0, len(long), 60))
    assert ("encoded", 0, len(lines)) in secrets.spans(lines + "\n")
    assert secrets.spans("word" * 8 + "\n" + "Text" * 8 + "\nMore") == []


def test_secret_base_patterns(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", "toKen", "api_key", "apikey", "secret", "token", " ", "=", ":", '"', "'", "abc", "12345678", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "AKIAAKIA", "f"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(60))), "") for k in range(300)] + [(500, None, ""), (501, "", "")]
    found = {r.doc_id: r for r in secrets.digests(secrets.scan(table(spark, rows))).collect()}
    # The patterns as the contract has them, written anew.
    names = "|".join("".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [(f"(?:{names})[\"']?[ ]*[:=][ ]*[\"']?([-A-Za-z0-9+/_.=]+)", 8), ("(AKIA[A-Z0-9]+)", 16), ("([0-9a-f]+)", 32)]
    for i, t, _ in rows:
        t = t or ""
        spans = [(m.start(), k, m.end()) for k, (pattern, least) in enumerate(patterns) for m in regex.finditer(pattern, t) if len(m[1]) >= least]
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = found[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_planted_secrets_in_a_table(spark):
    from base64 import b64encode

    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 60) for k in range(8)))
    hidden = b64encode(b'{"password": "correcthorse"}').decode()
    long = "plain words " * 20_000
    rows = [(1, "k " + b64encode(key).decode(), ""), (2, "t=" + JWT, ""), (3, hidden, ""), (4, long + hidden + " x", ""), (5, None, ""), (2, "t=" + JWT, ""), (None, hidden, ""), (6, "a" * 300_000, "")]
    got = sorted(((r.doc_id, r.spans) for r in secrets.digests(secrets.scan(table(spark, rows))).collect()), key=str)
    want = [(1, f"key:2:{2 + len(b64encode(key))}"), (2, f"token:2:{2 + len(JWT)}"), (2, f"token:2:{2 + len(JWT)}"), (3, f"encoded:0:{len(hidden)}"), (4, f"encoded:{len(long)}:{len(long) + len(hidden)}"), (5, ""), (6, "hex:0:300000"), (None, f"encoded:0:{len(hidden)}")]
    assert got == sorted(want, key=str)
    assert secrets.scan(table(spark, [])).count() == 0


def test_token_headers():
    from base64 import urlsafe_b64encode

    part = lambda text: urlsafe_b64encode(text.encode()).decode().rstrip("=")
    body = part('{"sub": 1}')
    for header in ('{ "alg" : "ES256" }', '\n{"typ":"JWT","alg":"RS256"}', '{"alg":"HS256"}'):
        token = f"{part(header)}.{body}.c2ln"
        assert ("token", 4, 4 + len(token)) in secrets.spans("a = " + token + " b")
    for bad in (f'{part("{")}.{body}.c2ln', f"""{part('{"alg":"none"}')}.{body}.""", f"""{part('{"alg":"none"}')}.{body}.c2ln""", f"""{part('{"alg":"HS256"}')}.{body}.""", f"""{part('{"alg":"HS256"}')}.c2ln.c2ln"""):
        assert not [x for x in secrets.spans("a = " + bad) if x[0] == "token"]


@pytest.mark.parametrize("text", ["a" * (1 << 20) + ".=\n" + "b" * 30 + "\n", "\n".join(["MIMP//94" + "eHh4" * 14] * (1 << 14)), "\n".join(["b3BlbnNzaC1rZXktdjFx" + "cXFx" * 11] * (1 << 14))])
def test_wrapped_lines_take_linear_time(text):
    """A run that one character ends before its line does, lines that each claim a long key, and lines that each begin one: a megabyte in two seconds."""
    import time

    best = float("inf")
    for _ in range(3):
        began = time.process_time()
        secrets.spans(text)
        best = min(best, time.process_time() - began)
    assert best < 2


def test_scan_of_a_long_run_is_linear():
    import time

    rng = random.Random(8)
    run = "=".join("".join(rng.choice("ghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(12_000))
    began = time.process_time()
    assert secrets.spans(run) == []
    assert time.process_time() - began < 10


def test_redaction(spark):
    rows = [(1, 'a token = "0123456789abcdef0123456789abcdef" b', ""), (2, None, ""), (3, "clean", "")]
    got = {r.doc_id: r.text for r in secrets.redact(table(spark, rows)).collect()}
    assert got == {1: 'a [REDACTED]" b', 2: None, 3: "clean"}


# --- byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe_against_library(spark, corpus, tiktoken_encoding):
    library, _ = tiktoken_encoding
    rng = random.Random(9)
    rows = [r for r in corpus] + [(200 + k, "".join(rng.choice("abc é😀12 '\n\tst!") for _ in range(rng.randrange(80))), "") for k in range(60)] + [(300, "a" * 5000, ""), (301, "<|endoftext|>", "")]
    df, path = table(spark, rows), P.path("byte_bpe_50k.tiktoken")
    got = sorted((tuple(r) for r in bpe.digests(df, path, P.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(table(spark, []), path, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)


def test_bpe_small_tables_of_states(tiktoken_encoding):
    _, ranks = tiktoken_encoding
    t = bpe.Transducer(ranks, max_states=5)
    rng = random.Random(4)
    for _ in range(400):
        piece = bytes(rng.choice(b"aeinorst \xc3\xa9") for _ in range(rng.randrange(1, 20)))
        assert t.encode(piece) == t.merged(piece)


def test_utf8_machine():
    rng = random.Random(6)
    for _ in range(2000):
        data = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xF4, 0xC0]) for _ in range(rng.randrange(1, 12)))
        machine, out, at = bpe.Utf8Stream(), [], 0
        while at < len(data):
            size = rng.randrange(1, 4)
            out.append(machine.feed(data[at : at + size]))
            at += size
        assert "".join(out) + machine.close() == data.decode(errors="replace")


def test_digest_is_of_the_decoded_stream(tiktoken_encoding):
    library, ranks = tiktoken_encoding
    bytes_of = {i: b for b, i in ranks.items()}
    for text in ("", "plain words", "é 😀\n" * 50):
        assert bpe.decoded_sha256(library.encode_ordinary(text), bytes_of) == hashlib.sha256(text.encode()).hexdigest()
    cut = [ranks[b"a"], ranks[b"\xc3"], ranks[b"b"], ranks[b"\xf0"]]
    assert bpe.decoded_sha256(cut, bytes_of) == hashlib.sha256("a\ufffdb\ufffd".encode()).hexdigest()


# --- decontamination


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == d[-1][-1]


def brute_leaks(rows, items, s=decontaminate.Settings()):
    """Every text against every item, without blocks, spaces or hashes: the longest common subsequence over each stretch
    of one and a half times the item's length, by the table of its definition."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, last = [0] * (len(b) + 1), row
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    def has(words, run):
        return any(words[k : k + len(run)] == run for k in range(len(words) - len(run) + 1))

    out = set()
    for i, text, _ in rows:
        words = (text or "").lower().split()
        for k, item in items:
            w = (item or "").lower().split()
            if not w or k is None:
                continue
            if len(w) < s.least_words:
                if has(words, w):
                    out.add((i, k))
                continue
            stops = [n for n in range(len(w) - 1) if w[n][-1] in ".?!"]
            answer = w[max(stops[-1] + 1 if stops else 0, len(w) - s.answer_words) :]
            held, width = set(w), -(-3 * len(w) // 2)
            for a in range(0, max(1, len(words) - width + 1), max(1, len(w) // 2)):
                stretch = words[a : a + width + len(w) // 2]
                if sum(x in held for x in stretch) >= s.paraphrased * len(w):
                    share = lcs(w, stretch) / len(w)
                    if share >= s.covered or share >= s.paraphrased and has(stretch, answer):
                        out.add((i, k))
    return out


def test_leaks(spark):
    rng = random.Random(11)
    items = [(k, words_of(rng, rng.randrange(15, 60), 3000) + ". " + words_of(rng, 6, 3000)) for k in range(25)]
    rows = [(k, words_of(rng, 300, 3000), "") for k in range(120)]
    rows += [(1000 + k, words_of(rng, rng.randrange(200), 3000) + " " + t.upper() + " " + words_of(rng, 50, 3000), "") for k, t in items]
    rows += [(1000, rows[-25][1], ""), (4000, words_of(rng, 30000, 3000) + " " + items[9][1], "")]  # a repeated row, a very long one
    long_items = list(items)
    items.append((93, "veryshort item"))
    rows += [(3000, "x very short veryshort item y", ""), (3001, "item veryshort", ""), (3002, "veryshort", ""), (3003, "item", "")]
    near = items[3][1].split()
    near[2] = near[9] = "changed"
    rows += [(2000, " ".join(near), ""), (2001, None, ""), (2002, "", ""), (None, items[4][1], ""), (2003, " ".join(items[5][1].split()[:8]), "")]
    benchmark = spark.createDataFrame(items + [(90, None), (91, ""), (92, "too short"), (None, "no id " * 5)], "item_id long, text string")
    docs = table(spark, rows)
    learnt = decontaminate.fit(docs, benchmark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, learnt).collect()}
    assert got == {(1000 + k, k) for k, _ in long_items} | {(2000, 3), (None, 4), (4000, 9), (3000, 93)}
    assert sum(r.doc_id == 1000 for r in decontaminate.find(docs, learnt).collect()) == 2
    assert got == brute_leaks(rows, items)
    left = {r.doc_id for r in decontaminate.clean(docs, learnt).select("doc_id").collect()}
    assert left == {i for i, _, _ in rows} - {a for a, _ in got}
    assert decontaminate.find(docs, decontaminate.fit(docs, benchmark.limit(0))).count() == 0
    none = table(spark, [])
    assert decontaminate.find(none, decontaminate.fit(none, benchmark)).count() == 0


def test_word_spans():
    texts = [b"", b" a  b", b"cd", b"\x0be\x1cf\n", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, first = batches.word_spans(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"a", b"b", b"cd", b"e\x1cf"]
    assert first.tolist() == [0, 0, 2, 3, 4, 4]


def test_leaks_of_common_words(spark):
    """Paraphrases that keep none of an item's rare words: all that they share with it stands in one block of ten."""
    rng = random.Random(13)
    items = [(k, " ".join(f"rare{k}x{j} {words_of(rng, 2, 300)}" for j in range(7)) + f" rare{k}. " + words_of(rng, 4, 300)) for k in range(12)]
    rows = [(k, words_of(rng, 300, 300), "") for k in range(200)]
    common = lambda text: " ".join(w for w in text.split() if not w.startswith("rare"))
    rows += [(1000 + k, f"{words_of(rng, 90, 300)} {common(t)} {words_of(rng, 50, 300)}", "") for k, t in items]
    rows += [(2000 + k, f"{words_of(rng, 33, 300)} {common(t)[:-1]}q", "") for k, t in items]  # another answer: no leak
    docs, benchmark = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    learnt = decontaminate.fit(docs, benchmark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, learnt).collect()}
    assert got == {(1000 + k, k) for k, _ in items} == brute_leaks(rows, items)
    assert {i for i, _, _ in rows} - {r.doc_id for r in decontaminate.clean(docs, learnt).collect()} == {1000 + k for k, _ in items}


def test_leaks_of_many_items(spark):
    """5,000 items, far more than one space holds: of those that stand in a text, and of paraphrases of half the words with the answer, nine in ten and more
    are found, and nothing else."""
    rng = random.Random(12)
    items = [(k, words_of(rng, 18, 9000) + ". " + words_of(rng, 6, 9000)) for k in range(5000)]

    def reworded(text):
        w = text.split()
        for at in rng.sample(range(18), 9):
            w[at] = f"x{rng.randrange(9000)}"
        return " ".join(w)

    around = lambda t: f"{words_of(rng, rng.randrange(60), 9000)} {t} {words_of(rng, 60, 9000)}"
    whole, half = items[::10], items[5::10]
    rows = [(k, around(t), "") for k, t in whole] + [(k, around(reworded(t)), "") for k, t in half]
    rows += [(6000 + k, words_of(rng, 150, 9000), "") for k in range(200)]
    docs, benchmark = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    learnt = decontaminate.fit(docs, benchmark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, learnt).collect()}
    assert got <= {(k, k) for k, _ in whole + half}
    assert {(k, k) for k, _ in whole} <= got
    assert sum((k, k) in got for k, _ in half) >= 0.9 * len(half)
    with pytest.raises(ValueError, match="most_sent"):
        decontaminate.fit(docs, benchmark, decontaminate.Settings(most_sent=1 << 20))
