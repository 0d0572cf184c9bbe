"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of a fixed length, the last one padded with zero bytes.  Each
window goes through a byte embedding, convolutions of several widths, a maximum over positions and a
softmax; a text's probabilities are the means over its windows, weighted by their bytes.  The network
is trained here, in numpy, on windows of a bounded sample of labelled texts; every byte of every text
is then scored.

Null texts and texts without a letter are ``und`` with score 0; so is everything if no row is labelled.
Every row gives one row, repeated ids included; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramian.llm import batches, sampling

UNDETERMINED = "und"
_letter = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class Settings:
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    #: The sample: about so many documents of each language, and windows of each document.
    docs_per_lang: int = 400
    windows_per_doc: int = 4
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    """Weights: byte embedding (256, e), kernels {width: (width, e, f)}, biases {width: (f,)}, dense (w*f, classes)."""

    settings: Settings
    langs: list[str]
    embed: np.ndarray = None
    kernels: dict[int, np.ndarray] = field(default_factory=dict)
    biases: dict[int, np.ndarray] = field(default_factory=dict)
    dense: np.ndarray = None
    bias: np.ndarray = None
    _tables: dict = None

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, what a byte, or a pair of bytes, adds to each filter at each place in it."""
        if self._tables is None:
            self._tables = {}
            for w, kernel in self.kernels.items():
                single = [(self.embed @ kernel[j]).astype(np.float32) for j in range(w)]
                pairs = [(a[:, None, :] + b[None, :, :]).reshape(65536, -1) for a, b in zip(single[::2], single[1::2])]
                self._tables[w] = [(2 * j, t) for j, t in enumerate(pairs)] + ([(w - 1, single[-1])] if w % 2 else [])
        return self._tables

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The greatest response of each filter in each window; x: (windows, length) bytes."""
        x = x.astype(np.intp)
        pair = x[:, :-1] * 256 + x[:, 1:]
        out = []
        for w, tables in self.tables().items():
            t = x.shape[1] - w + 1
            z = None
            for at, table in tables:
                index = (pair if len(table) > 256 else x)[:, at : at + t]
                z = table.take(index, axis=0) if z is None else np.add(z, table.take(index, axis=0), out=z)
            out.append(z.max(axis=1) + self.biases[w])
        return np.maximum(np.concatenate(out, axis=1), 0)

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        pooled = np.concatenate([self.pooled(x[a : a + block]) for a in range(0, len(x), block)]) if len(x) else np.zeros((0, len(self.dense)), np.float32)
        return softmax(pooled @ self.dense + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, size) bytes of all texts, the text of each window, and the bytes in each that aren't padding."""
    counts = -(-np.diff(offsets) // size)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    starts = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * size
    held = np.minimum(size, offsets[1:][owner] - starts)
    places = starts[:, None] + np.arange(size)
    x = np.concatenate([data, np.zeros(size, np.uint8)])[np.minimum(places, len(data))]
    x[np.arange(size) >= held[:, None]] = 0
    return x, owner, held


def train(x: np.ndarray, y: np.ndarray, langs: list[str], s: Settings) -> Network:
    """Adam on the cross-entropy; x: (windows, length) bytes, y: classes."""
    rng = np.random.default_rng(s.seed)
    net = Network(s, langs)
    p = {"embed": rng.normal(0, 0.5, (256, s.embedding)), "dense": rng.normal(0, 0.1, (s.filters * len(s.widths), len(langs))), "bias": np.zeros(len(langs))}
    for w in s.widths:
        p[f"k{w}"] = rng.normal(0, (w * s.embedding) ** -0.5, (w, s.embedding, s.filters))
        p[f"b{w}"] = np.zeros(s.filters)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), s.batch):
            xb, yb = x[order[a : a + s.batch]].astype(np.intp), y[order[a : a + s.batch]]
            e, pools, where = p["embed"][xb], [], {}
            for w in s.widths:
                t = x.shape[1] - w + 1
                z = sum(e[:, j : j + t] @ p[f"k{w}"][j] for j in range(w))
                where[w] = z.argmax(axis=1)
                pools.append(np.take_along_axis(z, where[w][:, None], 1)[:, 0] + p[f"b{w}"])
            z = np.concatenate(pools, axis=1)
            hidden = np.maximum(z, 0)
            d = softmax(hidden @ p["dense"] + p["bias"])
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            g = {"dense": hidden.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
            dz = (d @ p["dense"].T) * (z > 0)
            for n, w in enumerate(s.widths):
                dw = dz[:, n * s.filters : (n + 1) * s.filters]
                g[f"b{w}"], g[f"k{w}"] = dw.sum(0), np.empty_like(p[f"k{w}"])
                for j in range(w):
                    byte = np.take_along_axis(xb, where[w] + j, 1)
                    g[f"k{w}"][j] = np.einsum("nfe,nf->ef", p["embed"][byte], dw)
                    np.add.at(g["embed"], byte, dw[..., None] * p[f"k{w}"][j].T)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    net.embed, net.dense, net.bias = p["embed"], p["dense"], p["bias"]
    net.kernels, net.biases = {w: p[f"k{w}"] for w in s.widths}, {w: p[f"b{w}"] for w in s.widths}
    return net


def fit(labelled: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on (id, text, lang) rows; null texts and langs are passed over.  None: there is no row to learn from.

    About ``docs_per_lang`` texts of each language, chosen by a hash of the id, give ``windows_per_doc``
    windows each, at even distances; the driver receives those windows only.
    """
    batches.small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = sampling.per_class(rows.select("doc_id", "lang"), "lang", settings.docs_per_lang)
    size, most = settings.window, settings.windows_per_doc

    def cut(it):
        for batch in it:
            for part in batches.slices(batch):
                x, owner, _ = windows(*batches.byte_view(part.column(1)), size)
                counts = np.bincount(owner, minlength=part.num_rows)
                rank = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
                keep = rank % np.maximum(1, -(-counts // most))[owner] == 0
                langs = part.column(2).take(pa.array(owner[keep]))
                yield pa.record_batch([pa.array([r.tobytes() for r in x[keep]], pa.binary()), langs], names=["bytes", "lang"])

    got = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang").mapInArrow(cut, "bytes binary, lang string").toArrow()
    if not got.num_rows:
        return None
    found = sorted(zip(got["lang"].to_pylist(), got["bytes"].to_pylist()))
    langs = sorted({lang for lang, _ in found})
    x = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, size)
    return train(x, np.array([langs.index(lang) for lang, _ in found]), langs, settings)


def predict(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def run(it):
        for batch in it:
            for part in batches.slices(batch):
                yield pa.record_batch([part.column(0), *_predicted(part.column(1), network)], names=["doc_id", "lang_pred", "score"])

    return batches.by_id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def annotate(df: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """``df`` with the columns lang_pred and score put in place of any of these names; only the texts go to Python."""
    batches.small_batches(df.sparkSession)
    df = df.drop("lang_pred", "score")

    @F.arrow_udf("lang_pred string, score double")
    def found(texts: pa.Array) -> pa.Array:
        parts = [_predicted(part.column(0), network) for part in batches.slices(pa.record_batch([texts], names=["text"]))]
        langs = pa.concat_arrays([pa.array([], pa.string()), *[p[0] for p in parts]])
        return pa.StructArray.from_arrays([langs, pa.concat_arrays([pa.array([], pa.float64()), *[p[1] for p in parts]])], names=["lang_pred", "score"])

    name = next(f"found{k}" for k in range(len(df.columns) + 1) if f"found{k}" not in df.columns)
    return df.withColumn(name, found(F.col(text_col).cast("string"))).select(*df.columns, f"{name}.lang_pred", f"{name}.score")


def _predicted(text: pa.Array, network: Network | None) -> tuple[pa.Array, pa.Array]:
    """The language and the score of each text of a slice."""
    known = np.array([t is not None and _letter(t) is not None for t in text.to_pylist()], bool)
    if network is None:
        known[:] = False
    if not known.any():
        return pa.array([UNDETERMINED] * len(text), pa.string()), pa.array(np.zeros(len(text)))
    x, owner, held = windows(*batches.byte_view(text), network.settings.window)
    total = np.zeros((len(text), len(network.langs)))
    np.add.at(total, owner, network.probabilities(x) * held[:, None])
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
    best, score = total.argmax(axis=1), np.clip(total.max(axis=1), 0, 1)
    return pa.array([network.langs[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()), pa.array(np.where(known, score, 0.0))
