"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges of a rank file define, for every byte string, one token sequence.  A sequence is the
encoding of its bytes exactly if each pair of neighbours is the encoding of the pair's bytes.  So
every prefix has one last token: the one that ends there and may follow the last token of the
prefix before it.  The transducer reads bytes and writes the last token of each prefix.  Its state is

* the longest suffix of the input that is the beginning of some token, and
* for each position in that suffix from which a later token may start, the last token there, or
  rather one that stands for all last tokens that the same begun tokens may follow.

Following last tokens backwards from any open position gives that position's encoding; what all
open positions agree on can't change any more and is emitted, so the lookahead is bounded by the
longest token.  States and transitions are made when a text first needs them, and kept up to a bound.

Null texts count as empty.  Every row gives one row, repeated ids included; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches


def read_ranks(lines) -> dict[bytes, int]:
    """Token bytes to rank from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Encodes byte strings with one rank table; ``max_states`` bounds what is kept."""

    #: Undecided positions after which a long piece is looked at for tokens to emit.
    FLUSH = 1024
    #: Last tokens are told apart only where more tokens than this have begun.
    MOST_BEGUN = 40

    def __init__(self, ranks: dict[bytes, int], max_states: int = 80_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sorted = sorted(ranks)
        self.moves: dict[tuple[bytes, int], tuple] = {}
        self.classes: dict[tuple[int, bytes], int] = {}
        self.stands: dict[tuple, int] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        # A state: transitions by byte, suffix, last token at each open position.  -1: the start of the input.
        self.start = ({}, b"", (-1,))
        self.states = {(b"", (-1,)): self.start}

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by the definition: merge the leftmost pair of lowest rank until none is left."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, side: int) -> tuple:
        """The tokens at one edge (0: left, 1: right) of ``token`` while it is merged, each with the rank at
        which it is merged on; the token itself stays.  None: the merges don't build this token."""
        got = self.spines[side].get(token)
        if got is None:
            parts, last = list(self.bytes_of[token]), None
            parts = [bytes([b]) for b in parts]
            while len(parts) > 1:
                rank, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                last = (self.ranks[parts[k]], self.ranks[parts[k + 1]], rank)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) > 1:
                got = ()
            elif last is None:
                got = ((self.bytes_of[token], 1 << 60),)
            else:
                (child, _), *rest = self._spine(last[side], side)
                got = ((self.bytes_of[token], 1 << 60), (child, last[2]), *rest)
            self.spines[side][token] = got
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the pair is the encoding of its bytes.  Merges go by rising rank, so the pair falls only
        if some token at the right edge of a and some at the left edge of b merge while both are there."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= 3 * self.max_states:
                self.pairs.clear()
            right = self._spine(b, 0)
            got = bool(right)
            if a >= 0 and got:
                rank_of = self.ranks.get
                for x, until_x in self._spine(a, 1):
                    for y, until_y in right:
                        m = rank_of(x + y)
                        if m is not None and m < until_x and m <= until_y:
                            got = False
            self.pairs[a, b] = got
        return got

    def _open(self, suffix: bytes) -> list[int]:
        """The positions in ``suffix`` from which a token that goes on may start; its end is always one."""
        return [k for k in range(len(suffix)) if suffix[k:] in self.prefixes] + [len(suffix)]

    def _move(self, suffix: bytes, byte: int) -> tuple:
        """What reading ``byte`` after ``suffix`` means for any state: the new suffix, (open position,
        token) for the tokens that end here, and which open positions stay (-1: the new end)."""
        move = self.moves.get((suffix, byte))
        if move is None:
            if len(self.moves) >= self.max_states:
                self.moves.clear()
            old, longer = self._open(suffix), suffix + bytes([byte])
            ending = [(n, self.ranks[longer[k:]]) for n, k in enumerate(old) if longer[k:] in self.ranks]
            at = self._open(longer)
            after = longer[at[0] :]
            stay = tuple((old.index(k), longer[k:]) if k < len(longer) else (-1, b"") for k in at)
            move = self.moves[suffix, byte] = (after, tuple(ending), stay)
        return move

    def _stands_for(self, last: int, begun: bytes) -> int:
        """One token for all that may be followed by the same tokens that begin with ``begun``."""
        got = self.classes.get((last, begun))
        if got is None:
            if len(self.classes) >= 3 * self.max_states:
                self.classes.clear()
                self.stands.clear()
            a = bisect_left(self.sorted, begun)
            b = bisect_left(self.sorted, begun + b"\xff" * 2, a)
            got = last
            if b - a <= self.MOST_BEGUN:
                allowed = (begun, *[self.may_follow(last, self.ranks[t]) for t in self.sorted[a:b] if len(t) > len(begun)])
                got = self.stands.setdefault(allowed, last)
            self.classes[last, begun] = got
        return got

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The next state and the last token of the input so far."""
        nexts, suffix, lasts = state
        after, ending, stay = self._move(suffix, byte)
        for n, token in ending:
            if self.may_follow(lasts[n], token):
                break
        else:
            raise ValueError("the rank table lacks a single byte")
        key = (after, tuple([token if n < 0 else self._stands_for(lasts[n], begun) for n, begun in stay]))
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= self.max_states:
                self._reset()
            to = self.states[key] = ({}, *key)
        nexts[byte] = (to, token)
        return to, token

    def encode(self, piece: bytes) -> list[int]:
        state, labels, done = self.start, [], []
        for byte in piece:
            got = state[0].get(byte)
            if got is None:
                got = self.step(state, byte)
            state, token = got
            labels.append(token)
            if len(labels) >= self.FLUSH:
                self._emit(state, labels, done)
        return done + self._back(labels, len(labels))

    def _back(self, labels: list[int], at: int) -> list[int]:
        out, length = [], self.length
        while at:
            out.append(token := labels[at - 1])
            at -= length[token]
        out.reverse()
        return out

    def _emit(self, state: tuple, labels: list[int], done: list[int]) -> None:
        """Move the tokens that every open position agrees on from ``labels`` to ``done``."""
        suffix = state[1]
        chains = [self._back(labels, len(labels) - len(suffix) + k) for k in self._open(suffix)]
        least = min(chains, key=len)
        shared = next((k for k, t in enumerate(least) if any(c[k] != t for c in chains)), len(least))
        done += least[:shared]
        del labels[: sum(self.length[t] for t in least[:shared])]


class Encoder:
    """Splits a text by a pattern and encodes every match; keeps up to ``max_pieces`` recent results."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 100_000):
        # Two generations of up to max_pieces results each: a full one becomes the old one.
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.max_pieces = max_pieces

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    raw = piece.encode()
                    whole = self.transducer.ranks.get(raw)
                    ids = (whole,) if whole is not None else tuple(self.transducer.encode(raw))
                if len(piece) <= 64:
                    if len(kept) >= self.max_pieces:
                        self.old, kept = kept, {}
                        self.kept = kept
                    kept[piece] = ids
            out += ids
        return out


class Utf8Stream:
    """An incremental UTF-8 state machine: ``feed`` takes the bytes of a token and returns the text that
    is complete so far; an ill-formed sequence gives one U+FFFD for each maximal part, and ``close`` one for what is cut off."""

    def __init__(self):
        self.part, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out, at = [], 0
        while at < len(data):
            if not self.need:
                # Whole sequences go through at once; an ill-formed one, and one that isn't whole, byte by byte.
                to = max(at, self._whole(data))
                try:
                    out.append(data[at:to].decode())
                    at = to
                except UnicodeDecodeError as e:
                    out.append(data[at : at + e.start].decode())
                    at += e.start
                if at == len(data):
                    break
            at = self._step(data[at], out, at)
            while self.need and at < len(data):
                at = self._step(data[at], out, at)
        return "".join(out)

    @staticmethod
    def _whole(data: bytes) -> int:
        """Where a sequence begins that the end of ``data`` cuts off, or the end."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b >= 0xC0:
                return len(data) - k if k < 2 + (b >= 0xE0) + (b >= 0xF0) else len(data)
            if b < 0x80:
                break
        return len(data)

    def _step(self, b: int, out: list[str], at: int) -> int:
        """One transition; the place of the next byte, which is the same one again if it ends an ill-formed sequence."""
        if self.need:
            if self.low <= b <= self.high:
                self.part += bytes([b])
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.part.decode())
                    self.part = b""
                return at + 1
            out.append("\ufffd")
            self.part, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
            return at
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xF4:
            self.part, self.need = bytes([b]), 1 + (b >= 0xE0) + (b >= 0xF0)
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
        else:
            out.append("\ufffd")
        return at + 1

    def close(self) -> str:
        out = "�" if self.need else ""
        self.part, self.need = b"", 0
        return out


def decode_stream(tokens, bytes_of, at_once: int = 1024):
    """The text of a stream of ids, piece by piece, as soon as characters are complete; ``at_once`` ids are fed together."""
    machine, tokens = Utf8Stream(), iter(tokens)
    while some := [bytes_of[t] for t in islice(tokens, at_once)]:
        if piece := machine.feed(b"".join(some)):
            yield piece
    if piece := machine.close():
        yield piece


def decoded_sha256(tokens, bytes_of) -> str:
    """The SHA-256 of the text of a stream of ids, as UTF-8."""
    return hashlib.sha256("".join(decode_stream(tokens, bytes_of)).encode()).hexdigest()


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each Python worker and broadcast."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(*shared.value)
    return _encoders[shared.id]


class _Named:
    """A broadcast with an id that tasks can use as a key."""

    def __init__(self, broadcast, key):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def share(spark, path: str, pattern: str) -> _Named:
    """The rank file, read by the driver and sent to the executors (one vocabulary; its size is fixed)."""
    with open(path, "rb") as f:
        ranks = read_ranks(f)
    return _Named(spark.sparkContext.broadcast((ranks, pattern)), hash((path, pattern)))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every whole text."""
    shared = share(df.sparkSession, path, pattern)

    def run(it):
        encoder = _encoder(shared)
        for batch in it:
            for part in batches.slices(batch):
                texts = part.column(1).to_pylist()
                yield pa.record_batch([part.column(0), pa.array([encoder.encode(t or "") for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return batches.by_id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text): the ids of every row as text again."""
    shared = share(df.sparkSession, path, pattern)

    def run(it):
        bytes_of = _encoder(shared).transducer.bytes_of
        for batch in it:
            texts = ["".join(decode_stream(ids or (), bytes_of)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, and the ids decoded again,
    in one pass so that neither ids nor decoded text leave the task."""
    shared = share(df.sparkSession, path, pattern)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(it):
        encoder = _encoder(shared)
        bytes_of = encoder.transducer.bytes_of
        text_of = [str(i) for i in range(max(bytes_of, default=0) + 1)]
        for batch in it:
            for part in batches.slices(batch):
                n, ids_sha, decoded_sha = [], [], []
                for text in part.column(1).to_pylist():
                    ids = encoder.encode(text or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([text_of[i] for i in ids]).encode()).hexdigest())
                    decoded_sha.append(decoded_sha256(ids, bytes_of))
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return batches.by_id_text(df, id_col, text_col).mapInArrow(run, schema)
