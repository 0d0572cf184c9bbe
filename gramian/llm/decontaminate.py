"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into blocks of ``block`` words; a passage is two neighbouring blocks.  Passages are unit TF-IDF
vectors over words of the benchmark (what no item contains can't be shared with one), with frequencies
over all blocks; words in too many blocks are left out, but each item keeps its rarest.  A randomised
SVD of the passages, those of the items among them with a weight that makes the two alike in sum, gives a latent
space, from one product of the passages' Gram matrix with random columns, which is a sum over the partitions (the
eigenvectors follow from product and columns, by Nystroem's approximation).  Passages keep their length when
they are projected, so one that lies mostly outside the space is near to nothing.  A benchmark of more than ``together``
items is fitted in parts of about as many items each, every part with a space of its own over its items' words, so
that the space has a dimension for each item however many there are.  An item whose latent cosine
with a passage reaches ``cosine`` is a candidate; it is asked for the items that have a word of the space in the passage, as
one that has none would have nothing to show in the next step.  A candidate is a leak if the longest common subsequence with
the item, in a stretch of one and a half times the item's length, covers ``covered`` of the item's words, or
``paraphrased`` of them while the item's answer (its last sentence, at most ``answer_words`` words) stands there word
for word.

A leak may hold none of an item's words that stay, if too few of them do.  Such items are looked for by their words as well, exactly: of the n words of an item all but
n - m are in a leak that has m of them, so of any d words there are d - (n - m) in one stretch; d are the words that stay and the rarest of the others, as many as
make that one or more, or, without the answer, as many as cover the item.  What has so many is a candidate, whatever its cosine.

Words are compared in lower case.  Null texts count as empty.  Items with fewer than ``least_words`` words are leaks only where
all their words stand in a row; items without a word are passed over.  Rows that share a document's or an item's id are looked at one by one, and a pair of ids is
given once for each row of the document.  The benchmark is a query set that fits in memory; one of more than ``most_bytes``
bytes, or with spaces of more than ``most_sent`` bytes, is refused, and may be given in parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches
from gramian.runtime import cut


@dataclass(frozen=True)
class Settings:
    block: int = 32
    #: A space has a dimension for each of its items and so many more.
    extra: int = 24
    #: The most items that share a space.
    together: int = 400
    oversample: int = 8
    cosine: float = 0.25
    covered: float = 0.8
    paraphrased: float = 0.5
    answer_words: int = 8
    least_words: int = 5
    #: The benchmark's texts are held by the driver and every task; they may have so many bytes.
    most_bytes: int = 64 << 20
    #: So are the spaces, a number for each word and item of one: so many bytes at most, checked before anything is learnt.
    most_sent: int = 256 << 20
    #: Words in a larger share of the blocks are left out, but for the ``rarest`` of each item.
    common: float = 0.002
    rarest: int = 6
    seed: int = 7


@dataclass
class Space:
    """The latent space of the items from ``first`` on: a number for each word of the vocabulary (-1: not of these
    items), and what was learnt."""

    first: int
    number: np.ndarray
    idf: np.ndarray
    #: For each word and item the product of the word's latent vector with the item's unit one.
    similar: np.ndarray
    #: The items that have each word: where a word's items begin in ``items``, numbered from ``first``.
    bounds: np.ndarray
    items: np.ndarray


@dataclass
class Rest:
    """The items that keep too few words for the spaces: what finds their leaks exactly, by vocabulary number."""

    #: The items whose words are counted: where a word's begin.
    bounds: np.ndarray
    items: np.ndarray
    #: The items whose answer has the word as its rarest, and how many words of the answer come before it.
    answer_bounds: np.ndarray
    answers: np.ndarray
    before: np.ndarray
    #: For each item the words that a stretch must have, without the answer and with it, and the stretch's length.
    covered: np.ndarray
    paraphrased: np.ndarray
    width: np.ndarray


@dataclass
class Items:
    """The benchmark: ids, words (as hashes) and answers, the vocabulary's hashes, and the spaces that were learnt."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    spaces: list[Space] = field(default_factory=list)
    #: Items too short for a space: (id, words).
    short: list[tuple[int, np.ndarray]] = field(default_factory=list)
    rest: Rest | None = None


def read_items(rows: list[tuple], s: Settings) -> Items:
    """Items of (id, text)."""
    ids, words, answers, short = [], [], [], []
    for item, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1])):
        data = np.frombuffer(pc.utf8_lower(text).as_py().encode(), np.uint8)
        starts, ends, _ = batches.word_spans(data, np.array([0, len(data)]))
        h = batches.word_hashes(data, starts, ends)
        if 0 < len(h) < s.least_words:
            short.append((item, h))
        if len(h) < s.least_words:
            continue
        stops = [k for k in range(len(h) - 1) if data[ends[k] - 1] in b".?!"]
        ids.append(item)
        words.append(h)
        answers.append(h[max(stops[-1] + 1 if stops else 0, len(h) - s.answer_words) :])
    return Items(ids, words, answers, np.unique(np.concatenate([*words, np.zeros(0, np.uint64)])), short=short)


def _hits(part: pa.RecordBatch, at: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, first word of each row, and place and vocabulary number of the words in the vocabulary."""
    data, offsets = batches.byte_view(pc.utf8_lower(part.column(at)))
    starts, ends, first = batches.word_spans(data, offsets)
    h = batches.word_hashes(data, starts, ends)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    place = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    number = np.searchsorted(vocabulary, h[place])
    number[number == len(vocabulary)] = 0
    held = vocabulary[number] == h[place] if len(vocabulary) else np.zeros(0, bool)
    return h, first, place[held], number[held]


def _blocks(first: np.ndarray, place: np.ndarray, number: np.ndarray, block: int):
    """(block, word, count, later) of the vocabulary's words: blocks are numbered over all rows, and ``later`` says
    that a block has one before it in its row.  Also the first block of each row and the number of blocks."""
    blocks = -(-np.diff(first) // block)
    origin = np.cumsum(blocks) - blocks
    row = np.searchsorted(first, place, side="right") - 1
    own = origin[row] + (place - first[row]) // block
    key, at, count = np.unique(own * np.int64(1 << 32) + number, return_index=True, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count, (own > origin[row])[at], origin, int(blocks.sum())


def _passages(own: np.ndarray, word: np.ndarray, count: np.ndarray, later: np.ndarray):
    """The term counts (passage, word, count), by passage; passage b is blocks b and b + 1 of one row."""
    key = np.concatenate([own, own[later] - 1]) * np.int64(1 << 32) + np.concatenate([word, word[later]])
    count = np.concatenate([count, count[later]])
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] >> 32, key[at] & 0xFFFFFFFF, np.add.reduceat(count[order], at) if len(at) else count[:0]


def _weighted(passage: np.ndarray, word: np.ndarray, count: np.ndarray, idf: np.ndarray):
    """Unit TF-IDF values, and where each passage that has any begins."""
    value = count * idf[word]
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    norm = np.sqrt(np.add.reduceat(value * value, starts)) if len(starts) else np.zeros(0)
    return (value / np.repeat(np.maximum(norm, 1e-12), np.diff(np.append(starts, len(value))))).astype(np.float32), starts


class _Gram:
    """The Gram matrix of passages, word by word, summed up pair by pair; ``times`` a dense matrix is added to a total now and then."""

    def __init__(self, size: int, right: np.ndarray, most: int = 1 << 20):
        self.size, self.right, self.most = size, right, most
        self.keys, self.values, self.held = [], [], 0

    def add(self, passage, word, count, idf, total) -> None:
        value, starts = _weighted(passage, word, count, idf)
        sizes = np.diff(np.append(starts, len(value)))
        for k in np.unique(sizes):
            at = starts[sizes == k][:, None] + np.arange(k)
            w, v = word[at], value[at]
            a, b = np.triu_indices(int(k))
            for first in range(0, len(w), step := max(1, self.most // len(a))):
                part = slice(first, first + step)
                self.keys.append((w[part][:, a] * self.size + w[part][:, b]).ravel())
                self.values.append((v[part][:, a] * v[part][:, b]).ravel())
                self.held += len(self.keys[-1])
                if self.held > self.most:
                    self.times(total)

    def times(self, total) -> None:
        if not self.held:
            return
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        row, col, value = keys[at] // self.size, keys[at] % self.size, np.add.reduceat(values[order], at)
        off = row != col
        row, col, value = np.concatenate([row, col[off]]), np.concatenate([col, row[off]]), np.concatenate([value, value[off]])
        order = np.argsort(row, kind="stable")
        row, col, value = row[order], col[order], value[order]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        for a in range(0, len(begin), 256):  # some rows at a time, which stay in the cache
            to = begin[a + 256] if a + 256 < len(begin) else len(row)
            part = slice(begin[a], to)
            total[row[begin[a : a + 256]]] += np.add.reduceat(self.right[col[part]] * value[part, None], begin[a : a + 256] - begin[a], axis=0)
        self.keys, self.values, self.held = [], [], 0


_ENTRY = np.dtype([("block", "<u4"), ("word", "<u4"), ("count", "u1"), ("later", "?")])


def _term_counts(docs: DataFrame, items: Items, s: Settings) -> DataFrame:
    """(blocks long, entries binary): for a slice of texts, the number of blocks and their term counts."""

    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                _, first, place, number = _hits(part, 1, items.vocabulary)
                own, word, count, later, _, n = _blocks(first, place, number, s.block)
                packed = np.empty(len(own), _ENTRY)
                packed["block"], packed["word"], packed["count"], packed["later"] = own, word, np.minimum(count, 255), later
                yield pa.record_batch([pa.array([n]), pa.array([packed.tobytes()], pa.binary())], names=["blocks", "entries"])

    return docs.mapInArrow(run, "blocks long, entries binary")


def _summed(counts: DataFrame, shape: tuple[int, int], partial, chunk: int = 32) -> np.ndarray:
    """A matrix of ``shape`` summed over all partitions; ``partial()`` gives a function that adds a slice's share to a total, and
    at the end, called without a slice, what it still holds.  Partial sums are
    shuffled in chunks of rows, and the driver receives the sum."""
    size, width = shape

    def run(it):
        total, take = np.zeros(shape), partial()
        for batch in it:
            for raw in batch.column(1).to_pylist():
                entries = np.frombuffer(raw, _ENTRY)
                take(total, entries["block"].astype(np.int64), entries["word"].astype(np.int64), entries["count"].astype(np.float32), entries["later"])
        take(total)
        at = [a for a in range(0, size, chunk) if total[a : a + chunk].any()]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([total[a : a + chunk].astype(np.float32).tobytes() for a in at], pa.binary())], names=["at", "rows"])

    def add(table: pa.Table) -> pa.Table:
        rows = sum(np.frombuffer(raw, np.float32).astype(np.float64) for raw in table["rows"].to_pylist())
        return pa.table({"at": table["at"][:1], "rows": pa.array([rows.tobytes()], pa.binary())})

    got = counts.mapInArrow(run, "at long, rows binary").groupBy("at").applyInArrow(add, "at long, rows binary").toArrow()
    out = np.zeros(shape)
    for at, raw in zip(got["at"].to_pylist(), got["rows"].to_pylist()):
        rows = np.frombuffer(raw).reshape(-1, width)
        out[at : at + len(rows)] = rows
    return out


def _pruned(items: Items, frequency: np.ndarray, blocks: int, s: Settings) -> np.ndarray:
    """Which words of the vocabulary stay."""
    keep = frequency <= s.common * blocks
    for words in items.words:
        number = np.unique(np.searchsorted(items.vocabulary, words))
        keep[number[np.lexsort((number, frequency[number]))[: s.rarest]]] = True
    return keep


def _listed(rows: list[tuple], size: int) -> tuple[np.ndarray, ...]:
    """Rows (number, ...) by number: where each of ``size`` numbers begins, and the other columns."""
    table = np.array(sorted(rows), np.int64).reshape(len(rows), -1)
    return np.searchsorted(table[:, 0], np.arange(size + 1)), *table[:, 1:].T


def _rest(items: Items, frequency: np.ndarray, keep: np.ndarray, s: Settings) -> tuple[Rest | None, np.ndarray]:
    """What finds the leaks of items that may have one without any of the words that stay, and which words that needs."""
    needs = np.zeros((len(items.words), 2), np.int64)
    counted, answers, words = [], [], np.zeros(len(keep), bool)
    for k, item in enumerate(items.words):
        number, n = np.searchsorted(items.vocabulary, item), len(item)
        least, most = (int(np.ceil(share * n - 1e-9)) for share in (min(s.paraphrased, s.covered), s.covered))
        if keep[number].sum() > n - least:
            continue
        own = np.unique(number[np.lexsort((number, frequency[number], ~keep[number]))[: n - least + 1]])
        needs[k] = np.isin(number, own).sum() - n + np.array([most, least])
        counted += [(w, k) for w in own.tolist()]
        answer = np.searchsorted(items.vocabulary, items.answers[k])
        at = int(np.lexsort((answer, frequency[answer]))[0])
        answers.append((int(answer[at]), k, at))
        words[own], words[answer[at]] = True, True
    if not counted:
        return None, words
    width = np.array([-(-3 * len(w) // 2) for w in items.words])
    return Rest(*_listed(counted, len(keep)), *_listed(answers, len(keep)), needs[:, 0], needs[:, 1], width), words


def fit(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> Items:
    """Word frequencies and the latent spaces, from all passages.  The driver receives sums over the passages: for each
    space a row of as many numbers as it has dimensions, for each word of its items."""
    s = settings
    held = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string").alias("text"))
    n_bytes = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if n_bytes > s.most_bytes:
        raise ValueError(f"the benchmark has {n_bytes} bytes, more than most_bytes = {s.most_bytes}")
    items = read_items([tuple(r) for r in held.collect()], s)
    size = len(items.vocabulary)
    if not size:  # short items need no space
        return items
    parts = np.array_split(np.arange(len(items.ids)), -(-len(items.ids) // s.together))
    sent = sum(4 * len(p) * len(np.unique(np.concatenate([items.words[k] for k in p]))) for p in parts)
    if sent > s.most_sent:
        raise ValueError(f"the benchmark's spaces have {sent} bytes, more than most_sent = {s.most_sent}")
    counts = cut(_term_counts(batches.by_id_text(docs, id_col, text_col), items, s))
    blocks = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]

    def frequencies():
        def take(total, own=None, word=None, count=None, later=None):
            if own is not None:
                total[:, 0] += np.bincount(word, minlength=size)

        return take

    frequency = _summed(counts, (size, 1), frequencies)[:, 0]
    keep = _pruned(items, frequency, blocks, s)
    for part in parts:
        items.spaces.append(_space(counts, items, part, np.where(keep, frequency, -1), blocks, s))
    items.rest, more = _rest(items, frequency, keep, s)
    # The counts are numbered by the whole vocabulary, what is looked up later by the words that stay or are counted.
    held = keep | more
    items.vocabulary = items.vocabulary[held]
    for space in items.spaces:
        space.number = space.number[held]
    if items.rest:
        ends = np.append(np.flatnonzero(held), len(held))
        items.rest.bounds, items.rest.answer_bounds = items.rest.bounds[ends], items.rest.answer_bounds[ends]
    return items


def _space(counts: DataFrame, items: Items, part: np.ndarray, frequency: np.ndarray, blocks: int, s: Settings) -> Space:
    """The space of the items numbered ``part``; words with a frequency below 0 are left out."""
    owner = np.repeat(np.arange(len(part)), [len(items.words[k]) for k in part])
    word = np.searchsorted(items.vocabulary, np.concatenate([items.words[k] for k in part]))
    own = np.zeros(len(items.vocabulary), bool)
    own[word] = True
    own &= frequency >= 0
    number = np.where(own, np.cumsum(own) - 1, -1)
    idf = np.log((2 + blocks) / (1 + frequency[own]))
    size = len(idf)
    width = min(len(part) + s.extra, size)
    wide = min(width + s.oversample, size)
    rows = np.zeros((len(part), size))
    np.add.at(rows, (owner[own[word]], number[word[own[word]]]), 1)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    weight = max(1.0, blocks / len(rows))

    right = np.linalg.qr(np.random.default_rng(s.seed).normal(size=(size, wide)))[0]

    def gram_product():
        gram = _Gram(size, right.astype(np.float32))

        def take(total, own=None, word=None, count=None, later=None):
            if own is None:
                return gram.times(total)
            word = number[word]
            stay = word >= 0
            gram.add(*_passages(own[stay], word[stay], count[stay], later[stay]), idf, total)

        return take

    basis = _eigenvectors(_summed(counts, (size, wide), gram_product) + weight * (rows.T @ (rows @ right)), right)[:, :width]
    latent = rows @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    has = np.unique(number[word[own[word]]].astype(np.int64) * len(part) + owner[own[word]])
    return Space(int(part[0]), number, idf, (basis @ latent.T).astype(np.float32), np.searchsorted(has, np.arange(size + 1) * len(part)), has % len(part))


def _eigenvectors(product: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Eigenvectors, largest first, of a positive semidefinite matrix of which only ``product`` = matrix @ right is known, with
    orthonormal columns ``right``: Nystroem's approximation, with a small shift for stability."""
    shift = np.sqrt(len(right)) * 1e-7 * max(np.linalg.norm(product, 2), 1e-12)
    shifted = product + shift * right
    core = right.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = shifted @ (vectors / np.sqrt(np.maximum(values, shift)))
    return np.linalg.svd(half, full_matrices=False)[0]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit for each element of ``a``."""
    masks: dict = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        shared = row & masks.get(x, 0)
        row = (row + shared | row - shared) & full
    return len(a) - row.bit_count()


def _best_match(item: np.ndarray, answer: np.ndarray, text: np.ndarray, s: Settings, every: bool = False) -> tuple[float, bool] | None:
    """(share of the item covered, whether the answer is there) of the best stretch of ``text``, or of ``every`` stretch; None if it isn't a leak."""
    need = min(s.paraphrased, s.covered) * len(item)
    here = np.isin(text, item)
    if here.sum() < need:
        return None
    if every and not _has_run(text.tolist(), answer.tolist()):
        need = s.covered * len(item)
    best, words = None, item.tolist()
    # Stretches overlap by the item's length, so one of them holds any unbroken copy; of every stretch, those that begin with a word of the item are enough.
    width, step = -(-3 * len(item) // 2), max(1, len(item) // 2)
    starts = np.flatnonzero(here) if every else np.arange(0, max(1, len(text) - width + step), step)
    sums = np.append(0, np.cumsum(here))
    starts = starts[sums[np.minimum(starts + width, len(text))] - sums[np.minimum(starts, len(text))] >= need]
    for a in starts.tolist():
        if best == (1.0, True):
            break
        stretch = text[a : a + width].tolist()
        share = common_subsequence(words, stretch) / len(words)
        if share < min(s.paraphrased, s.covered):
            continue
        found = _has_run(stretch, answer.tolist())
        if (share >= s.covered or found) and (best is None or (share, found) > best):
            best = (share, found)
    return best


def _has_run(words: list, run: list) -> bool:
    return any(words[k : k + len(run)] == run for k in range(len(words) - len(run) + 1))


def _candidates(space: Space, passage: np.ndarray, word: np.ndarray, count: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) whose latent cosine reaches ``cosine``, for passages in order."""
    if not len(passage):
        return passage, passage
    value, starts = _weighted(passage, word, count, space.idf)
    sizes = np.diff(np.append(starts, len(value)))
    which = np.repeat(np.arange(len(starts)), sizes)
    # Each passage with the items of its words.
    n = space.bounds[word + 1] - space.bounds[word]
    at = np.repeat(space.bounds[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
    pairs = np.unique(np.repeat(which, n) * np.int64(1 << 32) + space.items[at])
    p, item = pairs >> 32, pairs & 0xFFFFFFFF
    # Their cosines are sums over the passage's words.
    m = sizes[p]
    begin = np.cumsum(m) - m
    at = np.repeat(starts[p] - begin, m) + np.arange(m.sum())
    near = np.add.reduceat(value[at] * space.similar[word[at], np.repeat(item, m)], begin) >= cosine
    return passage[starts[p[near]]], item[near]


def _expanded(bounds: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``number`` what its list holds: (which of ``number``, place in the lists)."""
    n = bounds[number + 1] - bounds[number]
    return np.repeat(np.arange(len(number)), n), np.repeat(bounds[number] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _regions(items: Items, h: np.ndarray, first: np.ndarray, place: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(row, item, first word, end) of what holds all stretches in which one of the rest may leak."""
    rest, total = items.rest, max(1, len(h))
    which, at = _expanded(rest.bounds, number)
    key = np.sort(rest.items[at] * total + place[which])
    item, begin = key // total, key % total
    row = np.searchsorted(first, begin, side="right") - 1
    # So many words of the item, counted from each one of them, within a stretch of the row.
    last = np.arange(len(key)) + np.maximum(rest.covered[item], 1) - 1
    held = np.flatnonzero(last < len(key))
    end = key[last[held]] - key[held]
    held = held[(end < rest.width[item[held]]) & (item[last[held]] == item[held]) & (row[last[held]] == row[held])]
    found = [np.column_stack([row[held], item[held], begin[last[held]] - rest.width[item[held]] + 1, begin[held] + rest.width[item[held]]])]
    # The answer word for word, with so many words of the item about it.
    which, at = _expanded(rest.answer_bounds, number)
    begin, item = place[which] - rest.before[at], rest.answers[at]
    row = np.searchsorted(first, place[which], side="right") - 1
    sizes = np.array([len(a) for a in items.answers])
    words = np.zeros((len(sizes), sizes.max()), np.uint64)
    for k, a in enumerate(items.answers):
        words[k, : len(a)] = a
    same = (begin >= first[row]) & (begin + sizes[item] <= first[row + 1])
    for k in range(words.shape[1]):
        same &= (k >= sizes[item]) | (h[np.clip(begin + k, 0, total - 1)] == words[item, k])
    row, item, begin = row[same], item[same], begin[same]
    low, high = np.maximum(first[row], begin + sizes[item] - rest.width[item]), np.minimum(first[row + 1], begin + rest.width[item])
    enough = np.searchsorted(key, item * total + high) - np.searchsorted(key, item * total + low) >= rest.paraphrased[item]
    found = np.vstack([*found, np.column_stack([row, item, low, high])[enough]]).astype(np.int64)
    found[:, 2], found[:, 3] = np.maximum(found[:, 2], first[found[:, 0]]), np.minimum(found[:, 3], first[found[:, 0] + 1])
    # Those of one row and item that overlap become one.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if not len(found):
        return found
    own = np.unique(found[:, 0] * len(sizes) + found[:, 1], return_inverse=True)[1] * (total + 1)
    reach = np.maximum.accumulate(found[:, 3] + own)
    starts = np.flatnonzero(np.append(True, found[1:, 2] + own[1:] > reach[:-1]))
    return np.column_stack([found[starts, :3], np.maximum.reduceat(found[:, 3], starts)])


def _leaks(part: pa.RecordBatch, at: int, items: Items, s: Settings) -> list[tuple[int, int, float, bool]]:
    """(row, item number, share, answer found) for a slice of rows; short items are numbered after the others."""
    if not items.spaces and not items.short:
        return []
    h, first, place, number = _hits(part, at, items.vocabulary)
    own, word, count, later, origin, _ = _blocks(first, place, number, s.block)
    best: dict[tuple[int, int], tuple[float, bool]] = {}
    for space in items.spaces:
        local = space.number[word]
        stay = local >= 0
        found, near = _candidates(space, *_passages(own[stay], local[stay], count[stay].astype(np.float32), later[stay]), s.cosine)
        owner = np.searchsorted(origin, found, side="right") - 1
        for block, row, k in zip(found.tolist(), owner.tolist(), (space.first + near).tolist()):
            item = items.words[k]
            begin = first[row] + (block - origin[row]) * s.block
            text = h[max(first[row], begin - len(item)) : min(first[row + 1], begin + 2 * s.block + len(item))]
            got = _best_match(item, items.answers[k], text, s)
            if got and got > best.get((row, k), (0.0, False)):
                best[row, k] = got
    for row, k, begin, end in _regions(items, h, first, place, number).tolist() if items.rest else []:
        got = _best_match(items.words[k], items.answers[k], h[begin:end], s, every=True)
        if got and got > best.get((row, k), (0.0, False)):
            best[row, k] = got
    for k, (_, item) in enumerate(items.short, len(items.ids)):
        for a in np.flatnonzero(h == item[0]).tolist():
            row = int(np.searchsorted(first, a, side="right")) - 1
            if a + len(item) <= first[row + 1] and (h[a : a + len(item)] == item).all():
                best[row, k] = (1.0, True)
    return [(row, k, *got) for (row, k), got in sorted(best.items())]


def find(docs: DataFrame, items: Items, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered double, answer boolean): every leak."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    ids_of = [*items.ids, *[i for i, _ in items.short]]

    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                found = _leaks(part, 1, shared.value, settings)
                ids = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.record_batch([ids, pa.array([ids_of[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.bool_())], names=["doc_id", "item_id", "covered", "answer"])

    return batches.by_id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, item_id long, covered double, answer boolean")


def clean(docs: DataFrame, items: Items, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item leaks; columns as they are."""
    batches.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        out = []
        for part in batches.slices(pa.record_batch([texts], names=["text"])):
            here = np.zeros(part.num_rows, bool)
            here[[f[0] for f in _leaks(part, 0, shared.value, settings)]] = True
            out.append(here)
        return pa.array(np.concatenate([*out, np.zeros(0, bool)]))

    return docs.where(~leaks(F.col(text_col).cast("string")))
