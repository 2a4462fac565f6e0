"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (bytes, words and lines).

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)), linear in the text.

The machine is fitted on the driver with numpy, on at most `sample` labelled ids (those of smallest hash; the bound is
the only thing that does not grow with the input), one row each.  Scoring reads every whole text.  Labels, language,
source and id are no inputs.

Defined results: null text counts as the empty text, which gets a score from its structure statistics alone; very long
texts are read whole; equal texts get equal scores, and a score of 0.5 counts as 1; repeated rows each get a row; rows
without a label, or labels of unknown documents, teach nothing; labels of one id that differ teach their larger value, and
of several texts of one id that of least hash teaches; with no labels of both kinds every score is the share of label 1
(0.5 without labels); an empty table gives an empty table; other input columns are ignored (score) or kept (keep),
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, lean, schema_with
from lodestone.session import ship

WORD_BUCKETS = 2048
RANK = 8
BINS = 12
SAMPLE = 6000
CACHE = 1 << 17

#: Byte classes that structure statistics count: lower, upper, digit, white space, line end, above ASCII, other.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_RATIOS = 13
#: Metadata: bytes, words and lines of the text as powers of two.
LENGTHS = 24
FEATURES = WORD_BUCKETS + _RATIOS * BINS + 3 * LENGTHS


class WordBuckets(dict):
    """word -> its bucket; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = bucket = xxhash.xxh32_intdigest(word) % WORD_BUCKETS
        return bucket


def _ratios(raw: bytes, words: list[bytes], buckets: np.ndarray) -> list[float]:
    """Structure statistics between 0 and 1."""
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = max(1, len(raw)), max(1, len(words))
    lower, upper, digit, space, line, high, other = np.bincount(_CLASS, by_byte, 7).tolist()
    marks = by_byte[_CLASS == 6]
    return [
        upper / max(1, lower + upper + high), digit / n, min(1, 4 * other / n), (space + line) / n, min(1, 20 * line / n),
        high / n, min(1, 8 * (by_byte[33] + by_byte[63]) / n), min(1, 8 * by_byte[[35, 36, 37, 38, 42]].sum() / n), min(1, 8 * by_byte[124] / n),
        len(set(words)) / k, float((buckets[1:] == buckets[:-1]).sum()) / k, min(1, len(raw) / k / 20), float(marks.max()) / max(1, marks.sum()) if k > 3 else 0.0,
    ]


class Features:
    """Turns texts into bucket numbers and values."""

    def __init__(self) -> None:
        self.buckets = WordBuckets()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode()
        words = raw.split()
        at = np.fromiter(map(self.buckets.__getitem__, words), np.int64, len(words))
        seen = np.flatnonzero(np.bincount(at, minlength=WORD_BUCKETS))
        bins = np.minimum((np.array(_ratios(raw, words, at)) * BINS).astype(np.int64), BINS - 1)
        lengths = [FEATURES - (k + 1) * LENGTHS + min(LENGTHS - 1, n.bit_length()) for k, n in enumerate((len(raw), len(words), raw.count(b"\n")))]
        index = np.concatenate((seen, WORD_BUCKETS + np.arange(_RATIOS) * BINS + bins, lengths))
        value = np.concatenate((np.full(len(seen), 1 / np.sqrt(max(1, len(seen)))), np.ones(_RATIOS + 3)))
        return index, value


class Machine:
    """A fitted factorisation machine."""

    def __init__(self, bias: float, weight: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weight, self.factors = bias, weight, factors

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        z = self.bias + float(self.weight[index] @ value) + 0.5 * float((vx.sum(0) ** 2).sum() - (vx**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 12, seed: int = 7) -> Machine:
    """Logistic loss, Adam on small batches, with weight decay."""
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    w, v = np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32)
    if not len(y) or not 0 < share < 1:
        return Machine(bias, w, v)
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.05, v.shape).astype(np.float32)
    x = np.zeros((len(y), FEATURES), np.float32)
    for i, (index, value) in enumerate(rows):
        x[i, index] = value
    params = [np.array([bias], np.float32), w, v]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 128):
            b = order[lo : lo + 128]
            xb, (b0, w, v) = x[b], params
            vx = xb @ v
            z = b0 + xb @ w + 0.5 * ((vx**2).sum(1) - (xb**2 @ v**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
            grads = [np.array([g.sum()]), xb.T @ g + 1e-5 * w, xb.T @ (g[:, None] * vx) - ((xb**2).T @ g)[:, None] * v + 1e-4 * v]
            step += 1
            for p, d, m, s in zip(params, grads, first, second):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return Machine(float(params[0][0]), params[1], params[2])


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits a machine on at most sample ids of labels and one document of each."""
    ship(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col, F.lit(1)), id_col).limit(sample)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col(id_col)).select("t", "y", "k", F.xxhash64("t").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features.of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([i.tolist() for i, _ in rows], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float32()))], names=["y", "k", "th", "i", "v"])

    # one row an id, however often it stands in docs: this is what the bound on the driver's rows rests on
    made = texts.mapInArrow(lean(run), f"y int, k {docs.schema[id_col].dataType.simpleString()}, th long, i array<int>, v array<float>")
    held = made.groupBy("k").agg(F.min(F.struct("th", "y", "i", "v")).alias("r")).select("r.y", "r.i", "r.v").toArrow()
    rows = [(np.array(i), np.array(v)) for i, v in zip(held.column("i").to_pylist(), held.column("v").to_pylist())]
    order = sorted(range(len(rows)), key=lambda k: (len(rows[k][0]), rows[k][0].tolist()))  # rows come in no fixed order
    return fit([rows[k] for k in order], [held.column("y")[k].as_py() for k in order])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' other columns, score and predicted (1 from 0.5 on) of every row."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            at = batch.schema.names.index(text_col)
            s = np.array([machine.score(*features.of(t)) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(lean(run), schema_with(docs, kept, "score double, predicted int"))


def digest(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 fold of 3 is 1 are held out of fitting."""
    machine = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1), sample=sample)
    return score(docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), machine)


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with docs' columns, that the classifier predicts 1 for."""
    machine = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1), sample=sample)

    @F.pandas_udf("boolean")
    def good(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for texts in parts:
            yield pd.Series([machine.score(*features.of(t)) >= 0.5 for t in texts], dtype=bool)
        give_back()

    return docs.filter(good("text"))
