"""Language identification with a byte convolutional network, trained and applied in numpy.

Filters of widths 2, 3 and 4 run over the bytes of a window (A-Z lowered), the largest response of each filter in the
window is kept, and a softmax over these gives the window's language probabilities.  A text is cut into windows of
WINDOW bytes, the last one padded with zeros; its probabilities are the mean over all its windows, weighted by the bytes
in them, so every byte of every text counts.

A filter over one-hot bytes is a table row per byte and offset; for inference neighbouring offsets are merged into
tables of byte pairs, so a response costs one or two look-ups.

The network is fitted on at most `per_language` ids of each language (those of smallest hash; of more than SAMPLE /
`per_language` languages fewer of each, but all languages), one row each and at most `windows` windows of it, which bounds
what the driver holds.  Language, source and id are no inputs.

Defined results: null texts and texts without a letter get `und` and score 0; very long texts are read whole; of equal
scores the language that sorts first is taken; repeated rows each get a row and teach once; of several texts of one id
that of least hash teaches; without any labelled row every text gets `und` and score 0; an empty table gives an empty
table; other input columns are ignored (predict) or kept (keep), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, lean, sample_per_label, schema_with
from lodestone.llm.quality import fold
from lodestone.session import ship

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANGUAGE = 300
#: Rows of all languages together.
SAMPLE = 80_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes handled together.
_CHUNK = 1 << 18


class Network:
    """tables[w]: (width, 256, filters); head: (filters in all, languages)."""

    def __init__(self, languages: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.head = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 128, seed: int = 5) -> Network:
        """Cross-entropy, Adam; the gradient of max pooling goes to the place of the largest response alone."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.head, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), batch):
                b = order[lo : lo + batch]
                x, y = windows[b], labels[b]
                pooled, places = [], []
                for w, t in zip(WIDTHS, self.tables):
                    r = sum(t[o][x[:, o : WINDOW - w + 1 + o]] for o in range(w))
                    at = r.argmax(1)
                    places.append(at)
                    pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
                h = np.concatenate(pooled, 1)
                z = h @ self.head + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = p @ self.head.T
                grads = []
                for k, (w, at) in enumerate(zip(WIDTHS, places)):
                    g = np.zeros((w, 256, FILTERS), np.float32)
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for o in range(w):
                        np.add.at(g[o], (np.take_along_axis(x, at + o, 1), np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
                grads += [h.T @ p + 1e-4 * self.head, p.sum(0)]
                step += 1
                for q, d, m, s in zip(params, grads, first, second):
                    m += 0.1 * (d - m)
                    s += 0.01 * (d * d - s)
                    q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return self

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width: tables by byte pair, for offsets 0 and 2; a last single byte has a table by byte."""
        out = []
        for t in self.tables:
            parts = [(t[o][:, None, :] + t[o + 1][None, :, :]).reshape(65536, FILTERS) for o in range(0, len(t) - 1, 2)]
            out.append([*parts, *([t[-1]] if len(t) % 2 else [])])
        return out

    def window_probabilities(self, stream: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Of a stream of whole windows, a row each."""
        pooled = []
        grid = stream.reshape(-1, WINDOW)
        pair = grid[:, :-1].astype(np.uint16) << 8 | grid[:, 1:]
        for w, parts in zip(WIDTHS, tables):
            n = WINDOW - w + 1
            r = np.take(parts[0], pair[:, :n], axis=0)
            for k, t in enumerate(parts[1:], 1):
                r += np.take(t, (pair if len(t) == 65536 else grid)[:, 2 * k : 2 * k + n], axis=0)
            pooled.append(r.max(1))
        z = np.concatenate(pooled, 1) @ self.head + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: list[str | None], tables: list[list[np.ndarray]]) -> tuple[list[str], list[float]]:
        raws = [(t or "").encode() for t in texts]
        counts = np.array([-(-len(r) // WINDOW) for r in raws], np.int64)
        owner = np.repeat(np.arange(len(raws)), counts)
        fill = np.minimum(WINDOW, np.repeat([len(r) for r in raws], counts) - WINDOW * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)))
        stream = _LOWER[np.frombuffer(b"".join(r.ljust(c * WINDOW, b"\0") for r, c in zip(raws, counts.tolist())), np.uint8)]
        total = np.zeros((len(raws), len(self.languages)))
        per = _CHUNK // WINDOW
        for lo in range(0, len(owner), per):
            p = self.window_probabilities(stream[lo * WINDOW : (lo + per) * WINDOW], tables) * fill[lo : lo + per, None]
            np.add.at(total, owner[lo : lo + per], p)
        total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
        best = total.argmax(1)
        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], [float(total[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]


def windows_of(raw: bytes, most: int) -> list[bytes]:
    """Up to most windows, spread over the text, and its first bytes as a short window."""
    n = -(-len(raw) // WINDOW)
    at = np.unique(np.linspace(0, max(0, n - 1), min(n, most)).astype(int)).tolist() if n else []
    out = [raw[i * WINDOW : (i + 1) * WINDOW] for i in at]
    return [w.ljust(WINDOW, b"\0") for w in [*out, *([out[0][: 16 + len(raw) % 48]] if out else [])]]


def train(docs: DataFrame, label_col: str = "lang", per_language: int = PER_LANGUAGE, windows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Fits a network on a bounded sample of the labelled rows of docs; None without any."""
    ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).filter("k IS NOT NULL AND y IS NOT NULL")
    chosen = sample_per_label(known, "y", "k", per_language, SAMPLE).select("k").distinct()
    texts = docs.select(F.col(id_col).alias("k"), F.col(label_col).alias("y"), F.col(text_col).alias("t")).filter("y IS NOT NULL AND t IS NOT NULL").join(F.broadcast(chosen), "k", "left_semi")
    texts = texts.select("k", "y", "t", F.xxhash64("t").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [windows_of(t.encode(), windows) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(made, pa.list_(pa.binary()))], names=["k", "y", "th", "w"])

    # one row an id, however often it stands in docs: this is what the bound on the driver's rows rests on
    rows = texts.mapInArrow(lean(run), f"k {docs.schema[id_col].dataType.simpleString()}, y string, th long, w array<binary>")
    held = rows.groupBy("k").agg(F.min(F.struct("th", "y", "w")).alias("r")).select("r.y", "r.w").toArrow()
    made = sorted((y, w) for y, own in zip(held.column("y").to_pylist(), held.column("w").to_pylist()) for w in own)  # rows come in no fixed order
    if not made:
        return None
    languages = sorted({y for y, _ in made})
    at = {y: i for i, y in enumerate(languages)}
    x = _LOWER[np.frombuffer(b"".join(w for _, w in made), np.uint8)].reshape(-1, WINDOW)
    return Network(languages).fit(x, np.array([at[y] for y, _ in made]))


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs' other columns, lang_pred and score."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.pair_tables() if network else []
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = batch.column(at).to_pylist()
            lang, score = network.predict(texts, tables) if network and texts else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), schema_with(docs, kept, "lang_pred string, score double"))


def digest(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32 fold of 5 is 0 are held out of fitting."""
    network = train(docs.filter(fold(F.col("doc_id"), 5) != 0), per_language=per_language)
    return predict(docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), network)


def keep(docs: DataFrame, least: float = 0.4, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs, with docs' columns, whose language is known with a score of at least `least`."""
    network = train(docs.filter(fold(F.col("doc_id"), 5) != 0), per_language=per_language)

    @F.pandas_udf("boolean")
    def known(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = network.pair_tables() if network else []
        for texts in parts:
            lang, score = network.predict(texts.tolist(), tables) if network and len(texts) else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pd.Series([y != UNKNOWN and s >= least for y, s in zip(lang, score)], dtype=bool)
        give_back()

    return docs.filter(known("text"))
