"""Language-model scoring by the subword lattice.

A text is a sequence of words, each followed by the next word's beginning or by the end.  A word's
probability is summed over all its segmentations into pieces of an existing vocabulary: the lattice of
pieces over the word, with a forward recursion in log space.  No piece goes over a word's beginning,
so the text's lattice falls into the lattices of its words.

The vocabulary file's pieces and scores weigh the segmentations.  The words of the lattice
sum to one: each is a beginning piece and others.  An end, q, is set beside them, so that a word has (1 - q) P_lattice(word) and words
and end sum to one again; q is (ends + 1) / (N + 2).  Every byte is a piece too, so that every text has a probability.

Two scores of a text follow.  ``vocabulary_score`` is the marginal under the file's scores alone: nothing of the corpus is in it but q.
``score`` is that of the model, which has learnt from the training texts: beside the pieces, whose weights stay the vocabulary's, each training word is an arc
over the whole word, weighted by its count; with N training tokens of V kinds, P(token) = (c + s V P_lattice(token)) / (N + s V), which sums to
one over all tokens.  The share s is one number, fitted by deleted interpolation: the training documents are two halves by a hash of the
id, and s is the one of SHARES under which each half's counts, with the lattice, give the other half the greatest probability.  With ``rounds`` above 0 the pieces' weights are
moved besides, by expected counts in the distinct training words (forward and backward over every one).

Counts are aggregated over all documents.  Words so frequent that only a bounded number of them can
exist are sent to all tasks with their scores; the others meet their scores in a join.  A word is scored in one task in time that grows
with its length times the number of piece lengths, about 40 microseconds a byte if it is alone of its length.

Null texts count as empty (one end).  Every row is a document, also one that shares its id or has none; a null id's remainder is 0, so
it is held out.  Other columns are ignored.
If there is no training token, N and V are 0 and the base is undefined (null); the lattice alone scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches
from gramian.runtime import cut

#: Stands for the end of a text; no word contains it.
_END = "\n"
END = _END.encode()
#: The byte that begins a word in the lattice, where the vocabulary has its word-begin mark.
BEGIN = b" "
MARK = "▁"

#: The shares that are tried.
SHARES = [2.0**k for k in range(-12, 7)]

#: At most so many words are frequent: each makes up more than 1/FREQUENT of all tokens.
FREQUENT = 1 << 19


@dataclass
class Pieces:
    """Sorted hashes of the pieces' bytes, their natural-log weights and lengths present."""

    hashes: np.ndarray
    weights: np.ndarray
    lengths: list[int]


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces (bytes; a leading mark as BEGIN) and scores of a SentencePiece model file; bytes that the file
    lacks are added.  A file of merges has ranks for scores; they count as Zipf's law: -log(2 - score)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            raw = bytes([int(piece[3:5], 16)])
        elif MARK in piece[1:]:
            continue
        else:
            raw = BEGIN + piece[1:].encode() if piece[0] == MARK else piece.encode()
        found[raw] = max(found.get(raw, -np.inf), score)
    low = min(found.values(), default=0.0)
    for b in range(256):
        found.setdefault(bytes([b]), low)
    pieces = sorted(found)
    scores = np.array([found[p] for p in pieces])
    if scores.max() <= 0 and low < -1000:
        scores = -np.log(2 - scores)
    return pieces, scores - np.log(np.exp(scores - scores.max()).sum()) - scores.max()


def index(pieces: list[bytes], weights: np.ndarray) -> tuple[Pieces, np.ndarray]:
    """The pieces by hash, and the order in which they were taken."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    hashes = batches.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(hashes)
    return Pieces(hashes[order], weights[order], sorted({len(p) for p in pieces})), order


def _same_length(words: list[bytes], most: int = 1 << 17):
    """(numbers, matrix of bytes) for words of one length at a time, about ``most`` bytes in each."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        size = sizes[order[at]]
        to = min(int(np.searchsorted(sizes[order], size, side="right")), at + max(1, most // max(1, int(size))))
        chosen = order[at:to]
        yield chosen, np.frombuffer(b"".join([words[k] for k in chosen]), np.uint8).reshape(len(chosen), size)
        at = to


class Lattice:
    """The arcs of all words of one length: for each piece length, the piece at each start (-1: none)."""

    def __init__(self, matrix: np.ndarray, pieces: Pieces):
        n, size = matrix.shape
        flat = np.ascontiguousarray(matrix).ravel()
        self.n, self.size, self.arcs = n, size, {}
        for length in pieces.lengths:
            if length > size:
                break
            starts = (np.arange(n)[:, None] * size + np.arange(size - length + 1)).ravel()
            h = batches.span_hashes(flat, starts, starts + length)
            at = np.searchsorted(pieces.hashes, h)
            at[at == len(pieces.hashes)] = 0
            at[pieces.hashes[at] != h] = -1
            at = at.reshape(n, -1)
            if (at >= 0).any():
                self.arcs[length] = at
        weights = np.append(pieces.weights, -np.inf)
        self.weights = {length: weights[at] for length, at in self.arcs.items()}

    def forward(self) -> np.ndarray:
        """a[:, e]: the log of the summed weight of all segmentations of the first e bytes."""
        a = np.full((self.n, self.size + 1), -np.inf)
        a[:, 0] = 0
        for e in range(1, self.size + 1):
            a[:, e] = _log_sum([a[:, e - k] + w[:, e - k] for k, w in self.weights.items() if k <= e])
        return a

    def expected(self, n_pieces: int) -> np.ndarray:
        """Expected number of each piece in all words together."""
        a = self.forward()
        b = np.full((self.n, self.size + 1), -np.inf)
        b[:, self.size] = 0
        for s in range(self.size - 1, -1, -1):
            b[:, s] = _log_sum([b[:, s + k] + w[:, s] for k, w in self.weights.items() if s + k <= self.size])
        out, total = np.zeros(n_pieces), a[:, -1:]
        for k, at in self.arcs.items():
            p = np.exp(a[:, : self.size - k + 1] + self.weights[k] + b[:, k:] - total)
            held = at >= 0
            out += np.bincount(at[held], p[held], n_pieces)
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(axis=0)
    base = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - base).sum(axis=0)) + base


def word_log_probabilities(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of each word's probability under the lattice alone."""
    out = np.zeros(len(words))
    for chosen, matrix in _same_length(words):
        out[chosen] = Lattice(matrix, pieces).forward()[:, -1]
    return out


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, A-Z in lower case, and the end."""
    return [*(text or "").encode().lower().split(), END]


def _documents(df: DataFrame, id_col: str, text_col: str, modulus: int) -> DataFrame:
    """(doc_id, text, part): 0 for documents that are held out, 1 and 2 for the halves of the others."""
    docs = batches.by_id_text(df, id_col, text_col)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) + 1
    return docs.withColumn("part", F.when(batches.bucket(F.col("doc_id"), modulus) == 0, 0).otherwise(half).cast("int"))


def kinds(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, c, half, n) of every distinct word and of the end: counts in training documents, in the first half of them, and in all.
    Tasks count up to ``most`` distinct words before they pass the counts on."""

    def count(it):
        held = [Counter(), Counter(), Counter()]

        def out():
            words = list(held[0].keys() | held[1].keys() | held[2].keys())
            away, one, two = (np.fromiter((h[w] for w in words), np.int64, len(words)) for h in held)
            for h in held:
                h.clear()
            return pa.record_batch([pa.array(words, pa.binary()).cast(pa.string()), pa.array(one + two), pa.array(one), pa.array(away + one + two)], names=["word", "c", "half", "n"])

        for batch in it:
            for rows in batches.slices(batch):
                for text, part in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                    held[part].update(words_of(text))
                if sum(map(len, held)) > most:
                    yield out()
        yield out()

    counted = docs.mapInArrow(count, "word string, c long, half long, n long")
    return counted.groupBy("word").agg(*[F.sum(x).alias(x) for x in ("c", "half", "n")])


def fitted_share(words: DataFrame) -> float:
    """The best of SHARES for ``words`` (c, half, p: natural log of the lattice's probability), by one aggregation; 1 where a half has no token."""
    one, two = F.col("half"), F.col("c") - F.col("half")
    n1, v1, n2, v2 = words.agg(F.sum(one), F.count_if(one > 0), F.sum(two), F.count_if(two > 0)).first()
    if not n1 or not n2:
        return 1.0
    given = lambda seen, n, v, s: F.log((seen + s * v * F.exp("p")) / (n + s * v))
    # A word that underflows under every share says nothing about it.
    cell = lambda k, x: F.sum(F.when(k > 0, k * F.greatest(x, F.lit(-700.0))))
    row = words.agg(*[F.coalesce(cell(two, given(one, n1, v1, s)), F.lit(0.0)) + F.coalesce(cell(one, given(two, n2, v2, s)), F.lit(0.0)) for s in SHARES]).first()
    return SHARES[int(np.argmax(row))]


def reestimate(words: DataFrame, pieces: list[bytes], weights: np.ndarray, prior: float = 0.1) -> np.ndarray:
    """Log weights from the expected counts of the pieces in the distinct ``words``; each piece has ``prior`` besides.
    The driver receives one number for each piece."""
    table, order = index(pieces, weights)
    shared = words.sparkSession.sparkContext.broadcast(table)

    def count(it):
        total = np.zeros(len(shared.value.weights))
        for batch in it:
            texts = [BEGIN + w.encode() for w in batch.column(0).to_pylist()]
            for _, matrix in _same_length(texts):
                total += Lattice(matrix, shared.value).expected(len(total))
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["piece", "n"])

    got = words.where(F.col("word") != _END).select("word").mapInArrow(count, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    total = np.full(len(pieces), prior)
    total[order[got["piece"].to_numpy()]] += got["n"].to_numpy()
    return np.log(total / total.sum())


def score(df: DataFrame, path: str, rounds: int = 0, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score), scores as log10.

    Documents whose id's crc32 leaves no remainder by ``modulus`` are held out; the others are learnt from.
    """
    docs = _documents(df, id_col, text_col, modulus)
    counted = cut(kinds(docs))
    ends = F.sum(F.when(F.col("word") == _END, F.col("c")))
    n, v, everything, n_ends = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(ends, F.lit(0))).first()
    q = (n_ends + 1) / (n + 2)
    pieces, weights = read_vocabulary(path)
    tables = [index(pieces, weights)[0]]
    for _ in range(rounds if n else 0):
        weights = reestimate(counted.where("c > 0"), pieces, weights)
    if rounds and n:
        tables.append(index(pieces, weights)[0])
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def word_scores(it):
        for batch in it:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            texts, ends = [BEGIN + w.encode() for w in words], [w == _END for w in words]
            plain, *other = [np.where(ends, np.log(q), word_log_probabilities(texts, t) + np.log1p(-q)) for t in shared.value]
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1))) if n else np.zeros(len(c))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(base), pa.array(other[0] if other else plain), pa.array(plain / np.log(10)), batch.column(3)], names=["word", "c", "half", "base", "p", "plain", "n"])

    judged = cut(counted.mapInArrow(word_scores, "word string, c long, half long, base double, p double, plain double, n long"))
    weight = fitted_share(judged) * v if n else 0.0
    # log((c + weight e^p) / (n + weight)), also where e^p is nothing beside numbers of 64 bits.
    mixed = F.when(F.col("c") > 0, F.log(F.col("c") + weight * F.exp("p"))).otherwise(F.lit(float(np.log(weight)) if weight else 0.0) + F.col("p")) - F.lit(float(np.log(n + weight)) if n else 0.0)
    scored = judged.select("word", (F.col("c") > 0).cast("long").alias("known"), "base", ((mixed if n else F.col("p")) / float(np.log(10))).alias("score"), "plain", "n")
    often = F.col("n") * FREQUENT > everything
    # Fewer than FREQUENT words can be that frequent, whatever the corpus.
    frequent = df.sparkSession.sparkContext.broadcast({w.encode(): x for w, *x in scored.where(often).select("word", "known", "base", "score", "plain").collect()})
    rare = scored.where(~often).select("word", "known", "base", "score", "plain")

    def sums(it):
        """For each text a row of sums over its frequent words, and one row for each of its other words; row: the number of the text."""
        table, place = frequent.value, TaskContext.get().partitionId() << 40
        for batch in it:
            for part in batches.slices(batch):
                ids, rows, words, count, sums = [], [], [], [], ([], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t = k = 0
                    b = s = p = 0.0
                    for word, times in Counter(words_of(text)).items():
                        got = table.get(word)
                        if got is None:
                            ids.append(doc)
                            words.append(word)
                            count.append(times)
                        else:
                            t += times
                            k += times * got[0]
                            b += times * got[1]
                            s += times * got[2]
                            p += times * got[3]
                    for column, value in zip(sums, (k, b, s, p)):
                        column += [None] * (len(ids) - len(column)) + [value]
                    ids.append(doc)
                    words.append(b"\t%d" % place)  # joins with no word
                    count.append(t)
                    rows += [place] * (len(ids) - len(rows))
                    place += 1
                types = (pa.int64(), *[pa.float64()] * 3)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), *[pa.array(c, k) for c, k in zip(sums, types)]], names=["doc_id", "row", "word", "n", *[f"own_{x}" for x in names]])

    names = ("known", "base", "score", "plain")
    rows = docs.mapInArrow(sums, "doc_id long, row long, word string, n long, own_known long, own_base double, own_score double, own_plain double")
    joined = rows.join(rare, "word", "left")
    total = lambda name: F.sum(F.coalesce(F.col(f"own_{name}"), F.col("n") * F.col(name)))
    out = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), total("known").alias("n_known"), total("base").alias("base_score"), total("score").alias("score"), total("plain").alias("vocabulary_score"))
    base = F.col("base_score") if n else F.lit(None).cast("double")
    return out.select("doc_id", (batches.bucket(F.col("doc_id"), modulus) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "vocabulary_score")
