"""Byte-exact dedup of repeated strings by merged Burrows-Wheeler transforms.

A window is a string of ``length`` bytes of one text; every byte of a window that also starts anywhere else, in the same text or another,
is removed.  Windows are judged on the input.

Which texts meet: the anchor of a window is the leftmost of its smallest hashed 8-grams, so equal windows have equal anchors at equal places.
The windows around an anchor are dealt into ranges of places; all windows of a range share a core, most of their bytes.  Equal windows have
equal cores, so a first count of the hashes of wide ranges' cores, over distinct texts, leaves out what can't be repeated.
What is left becomes short strings over an alphabet of bytes and cores: up to R - 1 bytes, the core as one symbol, up to R - 1 bytes.  Windows
are the substrings of R symbols of these strings, and only strings with the same core can share one.

How repeats are found: the strings of a core meet in one task.  Equal strings become one with a number.  Where a core has several strings,
they are dealt into shards, each shard's suffixes are sorted and its Burrows-Wheeler transform is taken; the transforms are merged by refining their interleave:
each round takes the next symbol of each transform in the order so far and sorts these stably, which gives the order by one symbol more, and
the boundaries of intervals, thus common prefixes, with it.  No suffix is sorted again.  After R rounds an interval is one window; it is repeated if its strings' numbers add up to
two or more.

No core gathers more than about MOST_STRINGS strings: one that is more frequent is dealt over several tasks by the text, and windows that are
single there meet those of the other tasks by the hash of the whole window.  Texts are shuffled once, as distinct texts; equal ones lose all their
windows, so all bytes if there is a window.  Results go back to the rows by the texts' 128-bit hash; texts that make up more than one in
FEW rows are sent to all tasks.

Null texts count as empty.  Texts shorter than ``length`` lose nothing.  Ids play no part: rows that share one, or have none, are rows of their own.
Removed bytes may end inside a character, so what is kept is binary.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches
from gramian.runtime import cut

#: Shortest windows.
LEAST_LENGTH = 16
#: A core's strings in one task are about so many at most.
MOST_STRINGS = 20_000
#: Fewer texts than this can each make up more than one in so many rows.
FEW = 1024
#: Tasks take about so many strings at a time; a shard has so many of them.
TOGETHER, SHARD = 40_000, 2048
#: Slices of texts, in bytes: what stays in a processor's cache is fast.
SLICE = 1 << 18

_GRAM = 8
_OTHER = np.uint64(0xD6E8FEB86659FD93)  # any odd number


class Anchors:
    """The runs of windows that share an anchor, in a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.places = length - _GRAM + 1  # of an anchor in a window
        self.wide = 3 * -(-self.places // 6)
        self.narrow = -(-self.places // 6)
        none = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.row = none
        self.grams = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        grams = np.ndarray(len(data) - _GRAM + 1, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
        self.grams = batches.mix(grams)
        at = (self.grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(at, self.places) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
        inside = np.arange(len(anchor)) + length <= ends
        edge = np.ones(len(anchor) + 1, bool)
        edge[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        cuts = np.flatnonzero(edge)
        held = inside[cuts[:-1]]
        self.first, self.last = cuts[:-1][held], cuts[1:][held] - 1
        self.anchor = anchor[self.first]
        self.row = np.searchsorted(offsets, self.first, side="right") - 1

    def ranges(self, size: int):
        """(first, last, core, row, number): the runs cut where (anchor - start) // size changes; core: where the bytes that all windows of the range
        share begin."""
        low, high = (self.anchor - self.last) // size, (self.anchor - self.first) // size
        times = high - low + 1
        k = np.repeat(np.arange(len(low)), times)
        number = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
        core = self.anchor[k] - number * size
        return np.maximum(self.first[k], core - size + 1), np.minimum(self.last[k], core), core, self.row[k], number

    def hashes(self, core: np.ndarray, size: int, number: np.ndarray) -> np.ndarray:
        """A hash of the core's bytes and of the range's number."""
        h = batches.span_hashes(self.grams, core, core + self.length - size + 1 - _GRAM + 1)
        return batches.mix(h ^ (number.astype(np.uint64) + np.uint64(1)) * _OTHER)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width] for each i."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


# --- transforms


def _suffixes(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of strings in order; each string ends with a symbol 0, the terminators in the order of the strings come first."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        step *= 2


def transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the symbol before each (0 before a string's first)."""
    order = _suffixes(symbols, ends)
    return order, np.where(order > 0, symbols[order - 1], 0).astype(symbols.dtype)


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the transforms in the order of their suffixes' first ``depth`` symbols, as places in the transforms one after the other, and
    the length of the common prefix of each suffix with the one before it, where it is less than ``depth`` (else ``depth``).

    Terminators are no part of a common prefix.
    """
    whole = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    interleave = shard  # the shard of each place; within a shard the order is its own
    common = np.full(len(whole), depth, np.int32)
    common[:1] = 0
    block = np.zeros(len(whole), np.int64)
    for h in range(depth):
        symbol = np.empty_like(whole)
        symbol[...] = whole[_places(interleave)]
        order = np.argsort(symbol, kind="stable")
        symbol, came, interleave = symbol[order], block[order], interleave[order]
        apart = np.ones(len(whole), bool)
        apart[1:] = (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1]) | (symbol[1:] == 0)
        common[apart & (common == depth)] = h
        block = np.cumsum(apart)
    return _places(interleave), common


def _places(interleave: np.ndarray) -> np.ndarray:
    """For each place of the interleave, which entry of the transforms, one after the other, stands there."""
    out = np.empty(len(interleave), np.int64)
    out[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))
    return out


def repeated_substrings(strings: list[np.ndarray], numbers: np.ndarray, depth: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """For the strings (of symbols above 0), one after the other and each with a terminator: where each begins, and for every symbol in how many strings, by
    their numbers, and places the ``depth`` symbols from there stand (0: fewer than ``depth`` are left)."""
    sizes = np.array([len(s) + 1 for s in strings])
    begins = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), strings[0].dtype)
    owner = np.repeat(np.arange(len(strings)), sizes)
    for s, b in zip(strings, begins.tolist()):
        flat[b : b + len(s)] = s
    suffixes, transforms = [], []
    for a in range(0, len(strings), shard):
        fro, to = begins[a], begins[a] + sizes[a : a + shard].sum()
        order, before = transform(flat[fro:to], np.cumsum(sizes[a : a + shard]) - 1)
        suffixes.append(order + fro)
        transforms.append(before)
    places, common = merge(transforms, depth)
    suffix = np.concatenate(suffixes)[places]
    block = np.cumsum(common < depth) - 1
    left = begins[owner[suffix]] + sizes[owner[suffix]] - 1 - suffix  # symbols before the terminator
    total = np.bincount(block, weights=numbers[owner[suffix]]).astype(np.int64)
    out = np.zeros(len(flat), np.int64)
    out[suffix] = np.where(left >= depth, total[block], 0)
    return begins, out


# --- jobs


def _mark(text: Column) -> list[Column]:
    """The 128-bit hash of a text as two numbers."""
    half = lambda a, n: F.conv(F.substring(F.md5(text), a, 16), 16, -10).cast("long").alias(n)
    return [half(1, "mark"), half(17, "twin")]


def _keys(texts: DataFrame, length: int) -> DataFrame:
    """(key, mark, n): the hashes of wide ranges' cores in each text."""

    def run(it):
        for batch in it:
            for part in batches.slices(batch, "text", SLICE):
                a = Anchors(*batches.byte_view(part.column(3)), length)
                _, _, core, row, number = a.ranges(a.wide)
                found, n = np.unique(np.rec.fromarrays([row, a.hashes(core, a.wide, number)], names=["r", "key"]), return_counts=True)
                yield pa.record_batch([pa.array(found["key"].view(np.int64)), part.column(0).take(pa.array(found["r"])), pa.array(n.astype(np.int32))], names=["key", "mark", "n"])

    return texts.mapInArrow(run, "key long, mark long, n int")


def _strings(texts: DataFrame, length: int) -> DataFrame:
    """(key, salt, shards, mark, twin, at, left, right): the strings of narrow ranges in wide ones whose core is repeated; ``texts`` has those in held:
    (key, shards), the number of tasks that a core's strings are dealt over."""

    def run(it):
        for batch in it:
            for part in batches.slices(batch.filter(pc.is_valid(batch.column(4))), "text", SLICE):
                a = Anchors(*batches.byte_view(part.column(3)), length)
                first, last, core, row, number = a.ranges(a.wide)
                shards = _shards(a.hashes(core, a.wide, number), row, part.column(4))
                a.first, a.last, a.anchor, a.row = first[shards > 0], last[shards > 0], core[shards > 0] + number[shards > 0] * a.wide, row[shards > 0]
                parent = np.repeat(shards[shards > 0], (a.anchor - a.first) // a.narrow - (a.anchor - a.last) // a.narrow + 1)
                first, last, core, row, number = a.ranges(a.narrow)
                h, raw, to = a.hashes(core, a.narrow, number), a.data.tobytes(), core + length - a.narrow + 1
                left = [raw[x:y] for x, y in zip(first.tolist(), core.tolist())]
                right = [raw[x:y] for x, y in zip(to.tolist(), (last + length).tolist())]
                mark, twin = part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))
                salt = np.asarray(mark.to_numpy(zero_copy_only=False)).view(np.uint64) % parent.astype(np.uint64)
                own = [h.view(np.int64), salt.astype(np.int32), parent.astype(np.int32)]
                yield pa.record_batch([*map(pa.array, own), mark, twin, pa.array(first - a.offsets[row]), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["key", "salt", "shards", "mark", "twin", "at", "left", "right"])

    return texts.mapInArrow(run, "key long, salt int, shards int, mark long, twin long, at long, left binary, right binary")


def _shards(hashes: np.ndarray, rows: np.ndarray, held: pa.Array) -> np.ndarray:
    """For each hash the number of shards that its row's list has for it, or 0."""
    out, bounds = np.zeros(len(hashes), np.int64), np.searchsorted(rows, np.arange(len(held) + 1))
    for k in range(len(held)):
        pairs, a, b = held[k].values, bounds[k], bounds[k + 1]
        keys, shards = (pairs.field(x).to_numpy(zero_copy_only=False) for x in (0, 1))
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys[order], hashes[a:b].view(np.int64)), len(keys) - 1)
        out[a:b] = np.where(keys[order][at] == hashes[a:b].view(np.int64), shards[order][at], 0)
    return out


def _together(it, split: bool):
    """Tables of whole (key, salt) groups, some TOGETHER strings in each; ``split``: only of cores that are dealt over several tasks."""
    held, n = [], 0
    for batch in it:
        if split:
            batch = batch.filter(pc.greater(batch.column(2), 1))
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            rows = pa.Table.from_batches(held).combine_chunks()
            key, salt = rows["key"].to_numpy(), rows["salt"].to_numpy()
            other = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield rows.slice(0, last)
            held, n = [b for b in rows.slice(last).to_batches()], len(rows) - last
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _judged(rows: pa.Table, narrow: int):
    """(distinct, which, counts): of the distinct strings (key, salt, left, right) among ``rows``, the one of each row, and for each an array of how often each of its
    windows stands among the rows of its key and salt."""
    left, right = rows["left"].to_pylist(), rows["right"].to_pylist()
    seen: dict[tuple, int] = {}
    which = np.array([seen.setdefault(x, len(seen)) for x in zip(rows["key"].to_pylist(), rows["salt"].to_pylist(), left, right)])
    distinct, numbers = list(seen), np.bincount(which)
    windows = np.array([len(x[2]) + len(x[3]) + 2 - narrow for x in distinct])
    counts = [np.full(w, n) for w, n in zip(windows.tolist(), numbers.tolist())]
    cores: dict[tuple, list[int]] = {}
    for k, x in enumerate(distinct):
        cores.setdefault(x[:2], []).append(k)
    several = [v for v in cores.values() if len(v) > 1]
    # Symbols have 16 bits: 0 for terminators, bytes from 1, cores from 257.
    for a in range(0, len(several), 60_000):
        chosen, strings = [], []
        for core, members in enumerate(several[a : a + 60_000]):
            middle = np.array([257 + core], np.uint16)
            for k in members:
                ends = [np.frombuffer(b, np.uint8).astype(np.uint16) + np.uint16(1) for b in distinct[k][2:]]
                strings.append(np.concatenate([ends[0], middle, ends[1]]))
                chosen.append(k)
        begins, times = repeated_substrings(strings, numbers[chosen], narrow)
        for k, b in zip(chosen, begins.tolist()):
            counts[k] = times[b : b + windows[k]]
    return distinct, which, counts


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, size) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def _repeats(strings: DataFrame, narrow: int) -> DataFrame:
    """(mark, twin, at, n): runs of windows that stand twice or more among the strings of one task."""

    def run(it):
        for rows in _together(it, False):
            distinct, which, counts = _judged(rows, narrow)
            found = [_runs(c > 1) for c in counts]
            k = np.repeat(np.arange(len(which)), [len(found[d]) for d in which])
            at = np.array([s for d in which for s, _ in found[d]], np.int64) + rows["at"].to_numpy()[k]
            n = np.array([size for d in which for _, size in found[d]], np.int64)
            yield pa.record_batch([*[rows[c].combine_chunks().take(pa.array(k)) for c in ("mark", "twin")], pa.array(at), pa.array(n)], names=["mark", "twin", "at", "n"])

    return strings.mapInArrow(run, "mark long, twin long, at long, n long")


def _single(strings: DataFrame, narrow: int) -> DataFrame:
    """(h, mark, twin, at, n): the windows of cores that are dealt over several tasks by the hash of the window, each once in a task: with its place if it
    stands there once (n = 1), without if more often."""

    def run(it):
        for rows in _together(it, True):
            distinct, which, counts = _judged(rows, narrow)
            at, mark, twin = (rows[c].to_pylist() for c in ("at", "mark", "twin"))
            seen, out = set(), []
            for row, d in enumerate(which.tolist()):
                key, _, left, right = distinct[d]
                for k, times in enumerate(counts[d].tolist()):
                    window = hashlib.blake2b(b"%d:%d:" % (key, len(left) - k) + left[k:] + right[: k + narrow - 1 - len(left)], digest_size=8).digest()
                    h = int.from_bytes(window, "little", signed=True)
                    if times == 1:
                        out.append((h, mark[row], twin[row], at[row] + k, 1))
                    elif h not in seen:
                        seen.add(h)
                        out.append((h, None, None, None, 2))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["h", "mark", "twin", "at", "n"])

    return strings.mapInArrow(run, "h long, mark long, twin long, at long, n long")


def repeats(texts: DataFrame, length: int, most_strings: int = MOST_STRINGS) -> DataFrame:
    """(mark, twin, at, n): runs of n windows from byte ``at`` that also start anywhere else among the distinct ``texts`` (mark, twin, copies, text)."""
    narrow = Anchors(np.zeros(0, np.uint8), np.zeros(1, np.int64), length).narrow
    keys = _keys(texts, length)
    again = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / most_strings).cast("int").alias("shards"))
    held = keys.select("key", "mark").join(again, "key").groupBy("mark").agg(F.collect_list(F.struct("key", "shards")).alias("held"))
    strings = _strings(texts.join(held, "mark", "left").select("mark", "twin", "copies", "text", "held"), length)
    strings = strings.repartition(F.col("key"), F.col("salt")).sortWithinPartitions("key", "salt")
    single = _single(strings, narrow)
    over = single.groupBy("h").agg(F.sum("n").alias("all")).where("all > 1").select("h")
    return _repeats(strings, narrow).unionAll(single.where("n = 1").join(over, "h").select("mark", "twin", "at", "n"))


def _removed(df: DataFrame, length: int, id_col: str, text_col: str, most_strings: int, column: str, kind: str, show) -> DataFrame:
    if length < LEAST_LENGTH:
        raise ValueError(f"windows of fewer than {LEAST_LENGTH} bytes")
    rows = batches.by_id_text(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.select("doc_id", *_mark(F.col("text")), "text")
    texts = marked.groupBy("mark", "twin").agg(F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))
    texts = texts.select("mark", "twin", "copies", "text")
    found = repeats(texts, length, most_strings).groupBy("mark", "twin").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def run(it):
        for batch in it:
            out = []
            for mark, twin, copies, text, at, n in zip(*(batch.column(k) for k in range(6))):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                depth = np.zeros(len(data) + 1, np.int64)
                if copies.as_py() > 1 and len(data) >= length:
                    depth[0] += 1
                elif at.is_valid:
                    start, size = (x.values.to_numpy(zero_copy_only=False) for x in (at, n))
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + size - 1 + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                out.append((mark.as_py(), twin.as_py(), copies.as_py(), len(data), int(gone.sum()), spans, show(data[~gone].tobytes())))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.binary() if kind == "binary" else pa.string())], names=["mark", "twin", "copies", "n_bytes", "n_removed", "n_spans", column])

    judged = texts.join(found, ["mark", "twin"], "left").select("mark", "twin", "copies", "text", "at", "n")
    result = cut(judged.mapInArrow(run, f"mark long, twin long, copies long, n_bytes long, n_removed long, n_spans long, {column} {kind}"))
    ids = marked.select("doc_id", "mark", "twin")
    total = result.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = F.col("copies") * FEW > total
    shown = ["n_bytes", "n_removed", "n_spans", column]
    # Fewer than FEW texts are that frequent; their rows are named where they are, the others' by a join without frequent keys.
    frequent = F.broadcast(result.where(often).select("mark", "twin", *[F.col(c).alias(f"own_{c}") for c in shown]))
    named = ids.join(frequent, ["mark", "twin"], "left")
    is_own = F.col("own_n_bytes").isNotNull()
    rest = named.where(~is_own).select("doc_id", "mark", "twin").join(result.where(~often).select("mark", "twin", *shown), ["mark", "twin"])
    return named.where(is_own).select("doc_id", *[F.col(f"own_{c}").alias(c) for c in shown]).unionAll(rest.select("doc_id", *shown))


def remove(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", most_strings: int = MOST_STRINGS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): every row's UTF-8 bytes without those of repeated windows."""
    return _removed(df, length, id_col, text_col, most_strings, "kept", "binary", lambda kept: kept)


def digests(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", most_strings: int = MOST_STRINGS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return _removed(df, length, id_col, text_col, most_strings, "kept_sha256", "string", lambda kept: hashlib.sha256(kept).hexdigest())
