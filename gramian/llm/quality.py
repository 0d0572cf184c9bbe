"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``passage_words`` consecutive words.  Every passage is encoded from how
its characters and words follow each other; gated attention, tanh(Vh) * sigmoid(Uh), weighs the encodings,
and the weighted sum gives the document's score.  Encoder, attention and score are learned together
from document labels alone, in numpy, on a bounded sample of labelled documents.

Null and empty texts are a bag of one empty passage.  Every row gives one row, repeated ids included;
other columns are ignored.  If only one label value is known, or none, the score is that value, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches, sampling

#: Character classes: groups of bytes that count as one.
_GROUPS = (b"\n\r\x0b\x0c", b" \t", b".", b",", b"!?", b"|", b"#$%&*", b"'\"()[]{}-_:;/\\<>@+=~^`", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)))
CLASSES = len(_GROUPS) + 1
CLASS = np.full(256, CLASSES - 1, np.int64)
for _n, _group in enumerate(_GROUPS):
    CLASS[list(_group)] = _n
LAGS = (1, 2, 3, 4)
FEATURES = CLASSES * CLASSES + len(LAGS) + 3


@dataclass(frozen=True)
class Settings:
    passage_words: int = 64
    hidden: int = 32
    attention: int = 16
    #: The sample: about so many documents of each label, and passages of each, at even distances.
    docs_per_label: int = 1500
    passages_per_doc: int = 48
    epochs: int = 25
    batch: int = 64
    rate: float = 0.005
    decay: float = 1e-4
    seed: int = 7


def passages(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, FEATURES) of all texts, and the first passage of each text and of the end."""
    starts, ends, first = batches.word_spans(data, offsets)
    n_words = np.diff(first)
    counts = np.maximum(1, -(-n_words // words))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    word_doc = np.repeat(np.arange(len(n_words)), n_words)
    word_passage = bounds[:-1][word_doc] + (np.arange(len(starts)) - first[:-1][word_doc]) // words
    n = int(bounds[-1])
    x = np.zeros((n, FEATURES), np.float32)
    if not len(starts):
        return x, bounds
    # The passage of each byte: the bytes before a text's first word belong to its first passage.
    byte_passage = np.zeros(len(data) + 1, np.int64)
    doc_starts = offsets[:-1][np.diff(offsets) > 0]
    np.maximum.at(byte_passage, doc_starts, bounds[:-1][np.diff(offsets) > 0])
    new = np.flatnonzero(np.diff(word_passage, prepend=-1))
    byte_passage[starts[new]] = np.maximum(byte_passage[starts[new]], word_passage[new])
    byte_passage = np.maximum.accumulate(byte_passage)[: len(data)]
    kind = CLASS[data]
    same = byte_passage[:-1] == byte_passage[1:]
    cell = (byte_passage[:-1] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
    pairs = np.bincount(cell[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    x[:, : CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True)))
    held = np.bincount(word_passage, minlength=n)
    hashes = batches.span_hashes(data, starts, ends)
    for k, lag in enumerate(LAGS):
        again = (hashes[lag:] == hashes[:-lag]) & (word_passage[lag:] == word_passage[:-lag])
        x[:, CLASSES * CLASSES + k] = np.bincount(word_passage[lag:][again], minlength=n) / np.maximum(1, held)
    length = (ends - starts).astype(np.float64)
    at = CLASSES * CLASSES + len(LAGS)
    x[:, at] = np.bincount(word_passage, length, n) / np.maximum(1, held) / 8
    x[:, at + 1] = np.bincount(word_passage, length > 12, n) / np.maximum(1, held)
    x[:, at + 2] = held / words
    return x, bounds


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """h = tanh((x-mean)/std W + b); a = softmax(w . tanh(hV) * sigmoid(hU)); score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, settings: Settings, mean: np.ndarray, std: np.ndarray):
        self.settings, self.mean, self.std = settings, mean, std
        rng = np.random.default_rng(settings.seed)
        h, a = settings.hidden, settings.attention
        self.p = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, h)), "b": np.zeros(h), "V": rng.normal(0, h**-0.5, (h, a)), "U": rng.normal(0, h**-0.5, (h, a)), "w": rng.normal(0, a**-0.5, a), "c": rng.normal(0, h**-0.5, h), "d": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift = 0.0

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, starts, counts = self.p, bounds[:-1], np.diff(bounds)
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, bounds)["logit"].astype(np.float64) + self.shift)

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of bags with labels y."""
        p, f, counts = self.p, self.forward(x, bounds), np.diff(bounds)
        dl = ((_sigmoid(f["logit"]) - y) / len(y)).astype(np.float32)
        dz = np.repeat(dl[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, bounds[:-1]), counts))
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ du, "b": du.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"] * de[:, None]).sum(0), "c": f["z"].T @ dl, "d": np.array([dl.sum()], np.float32)}


def train(bags: list[np.ndarray], y: np.ndarray, settings: Settings, share: float | None = None) -> Model:
    """Adam on the log loss; ``share``: of label 1 in all labelled rows, for which the sample's share is made good."""
    x = np.concatenate(bags)
    model = Model(settings, x.mean(0), x.std(0) + 1e-2)
    rng = np.random.default_rng(settings.seed)
    m, v, step = {k: 0 * a for k, a in model.p.items()}, {k: 0 * a for k, a in model.p.items()}, 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), settings.batch):
            chosen = order[a : a + settings.batch]
            bounds = np.concatenate([[0], np.cumsum([len(bags[k]) for k in chosen])])
            g = model.gradients(np.concatenate([bags[k] for k in chosen]), bounds, y[chosen])
            step += 1
            for k, w in model.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w -= settings.rate * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7) + settings.decay * w)
    if share is not None and 0 < share < 1:
        model.shift = float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return model


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """Learn from ``labels`` (id, 0/1); rows with a null id or another label are passed over, and an id with
    several labels has the greatest.  About ``docs_per_label`` labelled documents of each value, chosen by a
    hash of the id, are encoded by the executors; the driver receives their passages' features only."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    counts = {r[0]: r[1] for r in y.groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    chosen = sampling.per_class(y, "y", settings.docs_per_label).groupBy("doc_id").agg(F.max("y").alias("y"))
    words, most = settings.passage_words, settings.passages_per_doc

    def encode(it):
        for batch in it:
            for part in batches.slices(batch):
                x, bounds = passages(*batches.byte_view(part.column(1)), words)
                bags = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    bags.append(x[a : b : max(1, -(-(b - a) // most))].astype(np.float32).tobytes())
                yield pa.record_batch([part.column(0), pa.array(bags, pa.binary()), part.column(2)], names=["doc_id", "bag", "y"])

    got = batches.by_id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(encode, "doc_id long, bag binary, y int").toArrow()
    found = sorted(zip(got["doc_id"].to_pylist(), got["bag"].to_pylist(), got["y"].to_pylist()))
    target = np.array([t for _, _, t in found], np.float32)
    if len(set(target.tolist())) < 2:
        return float(target[0]) if len(target) else 0.5
    return train([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b, _ in found], target, settings, counts[1] / (counts[0] + counts[1]))


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                if isinstance(model, float):
                    s = np.full(part.num_rows, model)
                else:
                    s = model.score(*passages(*batches.byte_view(part.column(1)), model.settings.passage_words))
                yield pa.record_batch([part.column(0), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    return batches.by_id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
