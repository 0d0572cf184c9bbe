"""Importance resampling towards a target corpus over hashed word runs, by a dictionary automaton.

Features of a text are its runs of 1 to ``most`` words, joined by one space; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.
No feature's bytes are ever put together: the CRC of two strings side by side follows from their CRCs and the second one's length, so
a word is a payload (CRC, length) and a run's bucket comes from composing the payloads of neighbours.

The words that make up more than 1/FREQUENT of all words, fewer than FREQUENT whatever the corpus, and no longer than LONGEST bytes, so that what
is sent to all tasks is bounded, are counted over both corpora and become an Aho-Corasick automaton with their payloads.  Its patterns are bounded by
delimiters on either side, so that a word inside another one is never found, and neighbouring words share a delimiter.  One scan of a text
gives the payloads of its frequent words; the words between them, which the dictionary lacks, get theirs from their own bytes.

Two passes over the texts follow: one counts the buckets of both corpora (as many numbers from each task as there are buckets), the other adds up
the gains of each text's features.  The draw (Gumbel noise from a hash of the id) is a sort by range, numbered in the ranges.

Words: A-Z in lower case, then runs of digits, letters a-z and bytes from 128 on.  Null texts have no words.  Rows that share an id are drawn as rows of
their own; a row without an id has the noise of empty text and comes after others in ties.  An empty target has no features: T and every t are 0.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches
from gramian.operators.windows import numbered
from gramian.runtime import cut

#: A frequent word makes up more than one in so many of all words.
FREQUENT = 1 << 18
#: A word of the dictionary has so many bytes at most.
LONGEST = 64
#: Tasks keep so many distinct words before they pass their counts on.
KEPT = 300_000

#: Every byte's place among words: A-Z as a-z, delimiters as a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


# --- CRC-32 of strings side by side


def _one_byte() -> np.ndarray:
    """What a byte that is shifted out of a CRC's register puts into it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_OUT = _one_byte()
_DIRECT = 64  # lengths below this have a table of their own
_LEVELS = 34  # then one for each power of two


def _advance(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``c`` after the bytes that ``tables`` (4 x 256) stand for."""
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The effect of 0 to 63 zero bytes on each byte of a CRC, and of 64, 128, 256, ... zero bytes."""
    step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    short = [step]
    for _ in range(_DIRECT):
        step = (step >> np.uint32(8)) ^ _OUT[step & 255]
        short.append(step)
    powers = [short.pop()]
    while len(powers) < _LEVELS:
        powers.append(_advance(powers[-1], powers[-1]))
    return np.stack(short), powers


_SHORT, _POWERS = _tables()


def compose(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each pair of strings, from theirs and the length of the second."""
    flat, low = _SHORT.reshape(-1), (lengths & (_DIRECT - 1)) << 10
    out = flat[low + (first & 255)] ^ flat[low + 256 + ((first >> 8) & 255)] ^ flat[low + 512 + ((first >> 16) & 255)] ^ flat[low + 768 + (first >> 24)]
    rest, level = lengths // _DIRECT, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _advance(_POWERS[level], out[odd])
        rest, level = rest >> 1, level + 1
    return out ^ second


_SPACE = np.uint32(zlib.crc32(b" "))


def _spaced(c: np.ndarray) -> np.ndarray:
    """The CRC-32 of each string and a space."""
    return (c >> np.uint32(8)) ^ _OUT[c & 255] ^ _SPACE


# --- words and their payloads


class Slice:
    """The words of some rows: their bytes, spans, and the number of the first word of each row (and of the end).  Rows are parted by delimiters."""

    def __init__(self, column: pa.Array):
        data, offsets = batches.byte_view(column)
        folded = np.frombuffer(data.tobytes().translate(FOLD), np.uint8)
        padded = np.insert(folded, offsets, 0x20)
        self.raw = padded.tobytes()
        self.starts, self.ends, _ = batches.word_spans(padded, np.array([0, len(padded)]))
        self.first = np.searchsorted(self.starts, offsets + np.arange(len(offsets)))

    def words(self, which) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


class Dictionary:
    """An automaton of delimited words, and the payload of each."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        if words:
            self.automaton.make_automaton()

    def payloads(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The CRC and length of every word: by a scan where the dictionary has it, else from its bytes."""
        crc, known = np.zeros(len(part.starts), np.uint32), np.zeros(len(part.starts), bool)
        if len(self.crc):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(part.raw.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(part.ends, found[:, 0])
            crc[at], known[at] = self.crc[found[:, 1]], True
        other = np.flatnonzero(~known)
        crc[other] = [zlib.crc32(w) for w in part.words(other)]
        return crc, part.ends - part.starts


def runs(crc: np.ndarray, lengths: np.ndarray, most: int):
    """For runs of 1, 2, ... ``most`` words: the CRC of the run that starts at each word but the last ones."""
    held = crc
    yield held
    for n in range(1, min(most, len(crc))):
        held = compose(_spaced(held[:-1]), crc[n:], lengths[n:])
        yield held


_built: dict[int, tuple[object, Dictionary]] = {}


def _dictionary(shared) -> Dictionary:
    """The automaton of a broadcast word list, built once in each worker."""
    words = shared.value
    if id(shared) not in _built or _built[id(shared)][0] is not words:
        _built.clear()
        _built[id(shared)] = (words, Dictionary(words))
    return _built[id(shared)][1]


def frequent_words(texts: DataFrame, frequent: int = FREQUENT) -> list[bytes]:
    """The words that make up more than 1/frequent of all words of ``texts`` (column text), counted whole."""

    def count(it):
        held: Counter = Counter()
        n = 0

        def out():
            rows = pa.record_batch([pa.array([None, *held], pa.binary()), pa.array([n, *held.values()], pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in it:
            for rows in batches.slices(batch):
                part = Slice(rows.column(rows.schema.get_field_index("text")))
                n += len(part.starts)
                held.update(part.words(part.ends - part.starts <= LONGEST))
                if len(held) > KEPT:
                    yield out()
                    n = 0
        yield out()

    counted = cut(texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return sorted(bytes(r.word) for r in counted.where(F.col("word").isNotNull() & (F.col("n") * frequent > total)).select("word").collect())


def bucket_counts(texts: DataFrame, shared, buckets: int, most: int) -> np.ndarray:
    """The number of features in each bucket, over all texts."""

    def count(it):
        total = np.zeros(buckets, np.int64)
        for batch in it:
            for rows in batches.slices(batch):
                part = Slice(rows.column(rows.schema.get_field_index("text")))
                crc, lengths = _dictionary(shared).payloads(part)
                row = np.repeat(np.arange(len(part.first) - 1), np.diff(part.first))
                for n, held in enumerate(runs(crc, lengths, most)):
                    inside = row[: len(held)] == row[n:]
                    total += np.bincount(held[inside] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    got = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln of its smoothed share in the target over that in the source)."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, shared, table: np.ndarray, most: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of each text's features."""

    def add(it):
        for batch in it:
            for rows in batches.slices(batch):
                part = Slice(rows.column(1))
                crc, lengths = _dictionary(shared).payloads(part)
                a, b = part.first[:-1], part.first[1:]
                weight, features = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                for n, held in enumerate(runs(crc, lengths, most)):
                    sums = np.concatenate([[0], np.cumsum(table[held % len(table)])])
                    to = np.minimum(np.maximum(b - n, a), len(held))
                    fro = np.minimum(a, to)
                    weight += sums[to] - sums[fro]
                    features += to - fro
                yield pa.record_batch([rows.column(0), pa.array(b - a), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(add, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col, seed: int):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the N rows with ``least_words`` words or more the floor(percent * N / 100) highest scores
    are drawn, which have a rank from 1; rank is null elsewhere."""
    docs = batches.by_id_text(df, id_col, text_col)
    other = target.select(F.col(target_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(frequent_words(docs.select("text").unionAll(other), frequent))
    table = gains(bucket_counts(docs, shared, buckets, most), bucket_counts(other, shared, buckets, most))
    scored = weighted(docs, shared, table, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    # Rows that can't be drawn come last, so that numbers are ranks.
    placed = cut(numbered(scored.withColumn("fit", fit), F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), as_number="rank"))
    drawn = placed.where("fit").count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
