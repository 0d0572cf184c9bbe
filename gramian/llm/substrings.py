"""Substring dedup by level-wise doubling of repeated word windows.

A window of ``length`` consecutive words is removed if its words also start in a document with a smaller
id.  Windows of half the length come first.  Of these only anchors are counted: in every run of
half-windows that one long window covers, the one with the smallest hash.  Equal long windows have
equal anchors, so a long window none of whose anchors occurs in two documents is not repeated.
Windows around anchors that are repeated are extended to the full length and counted in turn; then windows
both halves of which are repeated are extended to twice that, and so on until none survives.  What is removed depends on
``length`` only: a longer repeat is a chain of windows.  The levels after it give ``longest``, the length at which
the last of a document's windows was repeated.

Between levels only hashes, ids and places are shuffled, pre-aggregated in the task that made them, so that a
passage in very many documents is one row for each of them and no group of documents meets anywhere.
Windows of the full length have two hashes of 64 and 32 bits, made in different ways; where the first is one and
the second isn't, which chance brings about once in 2**64 pairs, no window with the first is removed.
A text that equals one under a smaller id takes no part: all its windows are there, so it loses every word, or
none if it is shorter than a window.

Null texts have no words.  Rows without an id lose nothing and take nothing from others.  Rows that share
an id are judged against other ids only, each by its own text.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches
from gramian.runtime import cut


def _sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """best over x[i : i + width] for each i; what would go over the end is cut off."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


_OTHER = np.uint64(0xA0761D6478BD642F)  # any number


class Words:
    """The words of a slice of rows: hashes, the row of each, and windows that stay inside a row."""

    def __init__(self, column: pa.Array):
        self.data, offsets = batches.byte_view(column)
        self.starts, self.ends, self.first = batches.word_spans(self.data, offsets)
        self.hashes = batches.word_hashes(self.data, self.starts, self.ends)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.last = np.repeat(self.first[1:], counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the window that starts at each word but the last ones, and whether it stays inside its row."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n)
        return batches.span_hashes(self.hashes, at, at + length), at + length <= self.last[:n]

    def checks(self, length: int) -> np.ndarray:
        """Another hash of each of these windows."""
        n = max(0, len(self.hashes) - length + 1)
        at = np.arange(n)
        return batches.span_hashes(batches.mix(self.hashes ^ _OTHER), at, at + length)

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows of ``length``: the hash of each half-window, which of them are anchors, and for each
        window the smallest hash of a half-window in it (with whether it stays inside its row)."""
        half, (_, inside) = length // 2, self.windows(length)
        h, _ = self.windows(half)
        if not len(inside):
            return h, np.zeros(len(h), bool), np.zeros(0, np.uint64)
        run = length - half + 1
        least = _sliding(np.minimum, h, run)
        reach = np.concatenate([np.zeros(run - 1, np.uint64), np.where(inside, least, 0), np.zeros(run - 1, np.uint64)])
        covered = np.concatenate([np.zeros(run - 1, bool), inside, np.zeros(run - 1, bool)])
        chosen = (_sliding(np.maximum, reach, run) == h) & _sliding(np.logical_or, covered, run)
        return h, chosen, least


def _keys(rows: np.ndarray, hashes: list[np.ndarray], ids: pa.Array) -> pa.RecordBatch:
    """Distinct (doc_id, key), or (doc_id, key, check), of the given rows."""
    found = np.unique(np.rec.fromarrays([rows, *hashes], names=["r", *_HASHES[: len(hashes)]]))
    return pa.record_batch([ids.take(pa.array(found["r"])), *[pa.array(found[x].view(np.int64 if x == "key" else np.int32)) for x in _HASHES[: len(hashes)]]], names=["doc_id", *_HASHES[: len(hashes)]])


_HASHES = ("key", "check")


def _repeated(keys: DataFrame, by: str = "key", *same: str) -> DataFrame:
    """(by, first_id) of the keys that occur under two ids or more, with one value of ``same``."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc_id", *same) for n, f in (("first", F.min), ("last", F.max))]
    found = keys.groupBy(by).agg(*ends).where("first_doc_id < last_doc_id")
    for c in same:
        found = found.where(f"first_{c} = last_{c}")
    return found.select(by, F.col("first_doc_id").alias("first_id"))


def _member(hashes: np.ndarray, rows: np.ndarray, held: pa.Array) -> np.ndarray:
    """Whether each hash is among the keys of its row."""
    out = np.zeros(len(hashes), bool)
    bounds = np.searchsorted(rows, np.arange(len(held) + 1))
    for k, keys in enumerate(held):
        if keys.is_valid and len(keys):
            a, b = bounds[k], bounds[k + 1]
            out[a:b] = np.isin(hashes[a:b], keys.values.to_numpy(zero_copy_only=False).view(np.uint64))
    return out


def _anchor_keys(texts: DataFrame, length: int) -> DataFrame:
    def run(it):
        for batch in it:
            for part in batches.slices(_own(batch)):
                words = Words(part.column(1))
                h, chosen, _ = words.anchors(length)
                yield _keys(words.row[: len(h)][chosen], [h[chosen]], part.column(0))

    return texts.mapInArrow(run, "doc_id long, key long")


def _own(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with an id that aren't copies.  They are chosen here, not by a filter, which Spark would apply before the
    texts are dealt out: then each use would deal out texts of its own."""
    return batches.unpacked(batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.invert(batch.column(2)))))


def _extended_keys(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, check) of windows of ``length`` around the repeated anchors in the column keys."""

    def run(it):
        for batch in it:
            for part in batches.slices(_own(batch.filter(pc.is_valid(batch.column(4))))):
                words = Words(part.column(1))
                h, inside = words.windows(length)
                _, _, least = words.anchors(length)
                take = inside & _member(least, words.row[: len(h)], part.column(4))
                yield _keys(words.row[: len(h)][take], [h[take], words.checks(length)[take].astype(np.uint32)], part.column(0))

    return texts.mapInArrow(run, "doc_id long, key long, check int")


def _with_keys(texts: DataFrame, keys: DataFrame, *sets) -> DataFrame:
    """The texts with ``sets`` of keys of their documents; a document has as many as it has words at most."""
    return texts.join(keys.groupBy("doc_id").agg(*sets), "doc_id", "left")


def _shuffled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, copy, shared): the texts, compressed, dealt out by id once; every later join by id reuses that exchange.
    copy: an equal text has a smaller id.  shared: an equal text has another id."""
    rows = batches.by_id_text(df, id_col, text_col).withColumn("mark", F.unhex(F.md5("text")))
    marks = rows.where("doc_id is not null").select("doc_id", "mark")
    groups = _repeated(marks, "mark")
    later = F.when(F.col("first_id") < F.col("doc_id"), F.col("mark"))
    copies = marks.join(groups, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"), F.collect_set(later).alias("later"))
    held = lambda of: F.coalesce(F.array_contains(of, F.col("mark")), F.lit(False)).alias
    return batches.packed(rows).repartition("doc_id").join(copies, "doc_id", "left").select("doc_id", "text", held("later")("copy"), held("marks")("shared"))


def _level(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, first_id): the repeated windows of ``length``, of which none lacks a repeated anchor, in each document."""
    anchors = _anchor_keys(texts, length)
    survivors = anchors.join(_repeated(anchors), "key").select("doc_id", "key")
    keys = _extended_keys(_with_keys(texts, survivors, F.collect_set("key").alias("keys")), length)
    return keys.select("doc_id", "key").join(_repeated(keys, "key", "check"), "key").select("doc_id", "key", "first_id")


def remove(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, longest): every row's text without the words of removed windows, joined by one space;
    longest: the greatest of length, 2*length, 4*length, ... at which a window of the document also starts under another id, or 0."""
    return _removed(df, length, id_col, text_col, "kept", lambda kept: kept.decode())


def digests(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, longest)."""
    return _removed(df, length, id_col, text_col, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest())


def _removed(df: DataFrame, length: int, id_col: str, text_col: str, column: str, show) -> DataFrame:
    texts = _shuffled(df, id_col, text_col)
    doomed = F.col("first_id") < F.col("doc_id")

    def run(it):
        for batch in it:
            for part in batches.slices(batches.unpacked(batch)):
                words = Words(part.column(1))
                h, inside = words.windows(length)
                rows = words.row[: len(h)]
                copy = np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
                start = inside & (_member(h, rows, part.column(5)) | copy[rows])
                depth = np.zeros(len(words.hashes) + 1, np.int64)
                depth[:-1][: len(h)] += start
                depth[length:][: len(h)] -= start
                gone = np.cumsum(depth[:-1]) > 0
                n_gone = np.concatenate([[0], np.cumsum(gone)])[words.first]
                raw, kept = words.data.tobytes(), []
                for a, b in zip(words.first[:-1], words.first[1:]):
                    stay = np.flatnonzero(~gone[a:b]) + a
                    kept.append(show(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())])))
                held = np.flatnonzero(inside & ~copy[rows] & (_member(h, rows, part.column(4)) | _member(h, rows, part.column(5))))
                bounds = np.searchsorted(held, words.first).astype(np.int32)
                places = (held - words.first[rows[held]]).astype(np.int32)
                at = [pa.array([_packed(places[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(h[held].view(np.int64)))]
                yield pa.record_batch([part.column(0), pa.array(np.diff(words.first)), pa.array(np.diff(n_gone)), pa.array(kept, pa.string()), part.column(3), *at], names=["doc_id", "n_words", "n_removed", column, "shared", "at", "keys"])

    with_keys = _with_keys(texts, _level(texts, length), F.collect_set(F.when(~doomed, F.col("key"))).alias("first"), F.collect_set(F.when(doomed, F.col("key"))).alias("doomed"))
    out = cut(with_keys.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column} string, shared boolean, at binary, keys array<long>"))
    reached = _doubled(out.where("size(keys) > 0").select("doc_id", "at", "keys"), length)
    whole = F.when(F.col("shared") & (F.col("n_words") >= length), length * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_words") / length)))).cast("long")
    found = out if reached is None else out.join(reached, "doc_id", "left")
    seen = F.lit(0).cast("long") if reached is None else F.coalesce("reached", F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", "n_removed", column, F.greatest(seen, F.coalesce(whole, F.lit(0).cast("long"))).alias("longest"))


def _packed(places: np.ndarray) -> bytes:
    """Places in order, most of which follow one another, in few bytes."""
    return zlib.compress(np.diff(places, prepend=np.int32(0)).astype(np.int32).tobytes(), 1)


def _extended(it, length: int):
    """(doc_id, at, keys): of each row's windows those that are alive, if any, extended: where windows of twice the length begin, and their hashes."""
    for batch in it:
        ids, at, keys = [], [], []
        for k in range(batch.num_rows):
            p = np.cumsum(np.frombuffer(zlib.decompress(batch.column(1)[k].as_py()), np.int32), dtype=np.int64)
            h = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
            if batch.num_columns > 3:
                alive = np.isin(h, batch.column(3)[k].values.to_numpy(zero_copy_only=False))
                p, h = p[alive], h[alive]
            to = np.searchsorted(p, p + length)
            met = to < len(p)
            met[met] = p[to[met]] == p[met] + length
            both = batches.mix(h[to[met]].view(np.uint64) + _OTHER) ^ h[met].view(np.uint64)
            ids.append(k)
            at.append(_packed(p[met].astype(np.int32)))
            keys.append(batches.mix(both).view(np.int64))
        yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "at", "keys"])


def _doubled(rows: DataFrame, length: int) -> DataFrame | None:
    """(doc_id, reached): the last length, doubled again and again, at which a document still has repeated windows; ``rows``:
    (doc_id, at, keys), the repeated windows of ``length``.  The hash of a window follows from those of its halves."""
    out = None
    while True:
        # A row for every document that has a repeated window, with the windows of twice the length that may be.
        longer = cut(rows.mapInArrow(lambda it, n=length: _extended(it, n), "doc_id long, at binary, keys array<long>"))
        if longer.isEmpty():
            return None if out is None else out.groupBy("doc_id").agg(F.max("reached").alias("reached"))
        level = longer.select("doc_id", F.lit(length).cast("long").alias("reached"))
        out = level if out is None else out.unionAll(level)
        length *= 2
        longer = longer.where("size(keys) > 0")
        keys = longer.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
        alive = keys.join(_repeated(keys), "key").groupBy("doc_id").agg(F.collect_set("key").alias("alive"))
        rows = longer.join(alive, "doc_id").select("doc_id", "at", "keys", "alive")


def longest(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, longest) of the documents that have one."""
    return digests(df, length, id_col, text_col).where("longest > 0").groupBy("doc_id").agg(F.max("longest").alias("longest"))
