"""Toxicity by classifier chains.

Categories are predicted one after another, each by a linear (logistic) model over the counts of hashed words and word
beginnings; the probabilities of all earlier categories are further inputs.  While fitting, those probabilities are
out-of-fold predictions, so a later model never sees what an earlier one has learnt by heart.

The chain is fitted on the driver with numpy, on at most `sample` labelled ids of each combination of labels (those of
smallest hash), one row each.  Only features whose mean differs clearly between the classes enter a model.  Scoring reads
every whole text, with a look-up for each word.  Two parameters belong to the model, not to the data: a word counts MOST
times at most, and TOP features at most make one linear model.

Defined results: null text counts as the empty text; very long texts are read whole; a probability of 0.5 counts as toxic;
repeated rows each get a row and teach once; of several texts of one id that of least hash teaches, of several labels the
larger; a category without rows of both kinds gets its share of 1 as every probability (0.5 without labels); an empty
table gives an empty table; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean, sample_per_label, schema_with
from lodestone.llm.quality import fold
from lodestone.session import ship

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
BUCKETS = 1 << 20
#: Labelled rows of each combination of labels.
SAMPLE = 1500
TOP = 600
CLEAR = 5.0
FOLDS = 3
MOST = 3
CACHE = 1 << 17


def features_of(word: bytes) -> tuple[int, ...]:
    """Buckets of the word and of its first five, six and seven bytes."""
    return tuple({xxhash.xxh32_intdigest(w, s) % BUCKETS for s, w in ((0, word), *((n, word[:n]) for n in (5, 6, 7) if len(word) > n))})


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words, and how many words fall in each (MOST at most)."""
    counts: dict[int, int] = {}
    for word, n in Counter(WORD.findall((text or "").encode().lower())).items():
        for i in features_of(word):
            counts[i] = counts.get(i, 0) + n
    at = np.array(sorted(counts), np.int64)
    return at, np.minimum([counts[i] for i in at.tolist()], MOST).astype(np.int64)


class Linear:
    """A logistic model over some buckets and the earlier probabilities."""

    def __init__(self, buckets: np.ndarray, weight: np.ndarray, chain: np.ndarray, bias: float) -> None:
        self.buckets, self.weight, self.chain, self.bias = buckets, weight, chain, bias

    def probability(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + earlier @ self.chain + self.bias, -30, 30)))


def _clear_buckets(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """The TOP buckets whose mean count differs most between the classes, in standard errors, CLEAR at least."""
    at = np.concatenate([i for i, _ in rows])
    n = np.concatenate([v for _, v in rows]).astype(float)
    own = np.repeat(y, [len(i) for i, _ in rows])
    seen, at = np.unique(at, return_inverse=True)
    one, zero = (np.bincount(at, n * (own == k), len(seen)) / max(1, (y == k).sum()) for k in (1, 0))
    square = np.bincount(at, n * n, len(seen)) / len(y)
    var = np.maximum(square - (np.bincount(at, n, len(seen)) / len(y)) ** 2, 1e-9)
    z = np.abs(one - zero) / np.sqrt(var * (1 / max(1, y.sum()) + 1 / max(1, (1 - y).sum())))
    best = np.argsort(-z, kind="stable")[:TOP]
    return np.sort(seen[best[z[best] >= CLEAR]])


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], buckets: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(buckets)), np.float32)
    if len(buckets):
        for r, (i, v) in enumerate(rows):
            at = np.minimum(np.searchsorted(buckets, i), len(buckets) - 1)
            ok = buckets[at] == i
            x[r, at[ok]] = v[ok]
    return x


def _logistic(x: np.ndarray, earlier: np.ndarray, y: np.ndarray, buckets: np.ndarray, steps: int = 200) -> Linear:
    share = float(y.mean()) if len(y) else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    # the classes weigh alike
    each = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / max(1, len(y))
    z = np.concatenate((x, earlier.astype(np.float32)), 1)
    w, b = np.zeros(z.shape[1], np.float32), 0.0 if 0 < share < 1 else bias
    if 0 < share < 1:
        m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            g = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y) * each
            d = np.append(z.T @ g + 1e-4 * w, g.sum())
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
            w, b = w - move[:-1].astype(np.float32), b - float(move[-1])
    return Linear(buckets, w[: x.shape[1]], w[x.shape[1] :], b)


class Chain:
    """The fitted models in order."""

    def __init__(self, models: list[Linear]) -> None:
        self.models = models
        weights: dict[int, np.ndarray] = {}
        for k, model in enumerate(models):
            for i, v in zip(model.buckets.tolist(), model.weight.tolist()):
                weights.setdefault(i, np.zeros(len(models)))[k] = v
        self.weights = weights
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def _known(self, word: bytes) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = found = tuple(i for i in features_of(word) if i in self.weights)
        return found

    def probabilities(self, text: str | None) -> list[float]:
        counts: dict[int, int] = {}
        for word, n in Counter(WORD.findall((text or "").encode().lower())).items():
            for i in self._known(word):
                counts[i] = counts.get(i, 0) + n
        total = np.zeros(len(self.models))
        for i in sorted(counts):
            total += self.weights[i] * min(counts[i], MOST)
        out: list[float] = []
        for model, t in zip(self.models, total.tolist()):
            z = t + model.bias + sum(c * p for c, p in zip(model.chain.tolist(), out))
            out.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Chain:
    """labels: a row each, a column for each category in chain order."""
    fold = np.arange(len(rows)) % FOLDS
    earlier, models = np.zeros((len(rows), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        buckets = _clear_buckets(rows, y) if 0 < y.sum() < len(y) else np.zeros(0, np.int64)
        x = _dense(rows, buckets)
        models.append(_logistic(x, earlier, y, buckets))
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            rest, own = fold != f, fold == f
            if own.any():
                # buckets are chosen without the fold too: what is predicted has taught nothing
                b = _clear_buckets([r for r, ok in zip(rows, rest) if ok], y[rest]) if 0 < y[rest].sum() < rest.sum() else np.zeros(0, np.int64)
                xf = _dense(rows, b)
                out[own] = _logistic(xf[rest], earlier[rest], y[rest], b).probability(xf[own], earlier[own])
        earlier = np.column_stack((earlier, out))
    return Chain(models)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """categories: in chain order, each a 0/1 expression over labels; at most sample rows of each combination are used."""
    ship(docs.sparkSession)
    y = F.array(*[F.max(c.cast("int")) for c in categories.values()])
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(y.alias("y")).filter(~F.exists("y", lambda v: v.isNull()))
    chosen = sample_per_label(known.withColumnRenamed(id_col, "k"), "y", "k", sample, sample << len(categories))
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k").select("y", "t", "k", F.xxhash64("t").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([i.tolist() for i, _ in rows], pa.list_(pa.int32())), pa.array([n.tolist() for _, n in rows], pa.list_(pa.int32()))], names=["y", "k", "th", "i", "n"])

    # one row an id, however often it stands in docs: this is what the bound on the driver's rows rests on
    each = texts.mapInArrow(lean(run), f"y array<int>, k {docs.schema[id_col].dataType.simpleString()}, th long, i array<int>, n array<int>")
    held = each.groupBy("k").agg(F.min(F.struct("th", "y", "i", "n")).alias("r")).select("r.y", "r.i", "r.n").toArrow()
    made = zip(held.column("y").to_pylist(), (np.array(i, np.int64) for i in held.column("i").to_pylist()), (np.array(n, np.int64) for n in held.column("n").to_pylist()))
    made = sorted(made, key=lambda r: (len(r[1]), r[1].tolist(), r[0]))  # rows come in no fixed order
    order = np.random.default_rng(1).permutation(len(made))
    return fit([made[k][1:] for k in order], np.array([made[k][0] for k in order]).reshape(-1, len(categories)))


def score(docs: DataFrame, chain: Chain, categories: list[str], text_col: str = "text") -> DataFrame:
    """docs' other columns, and p_<category> of every row."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            p = np.array([chain.probabilities(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(categories))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], *(pa.array(p[:, k]) for k in range(len(categories)))], names=[*kept, *(f"p_{c}" for c in categories)])

    return docs.mapInArrow(lean(run), schema_with(docs, kept, ", ".join(f"`p_{c}` double" for c in categories)))


def categories() -> dict[str, Column]:
    """The annotations of the labels table in chain order: low quality, toxicity, and both at once."""
    junk, toxic = 1 - F.col("quality"), F.col("toxic")
    return {"junk": junk, "toxic": toxic, "toxic_junk": junk * toxic}


def digest(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, p_junk, p_toxic, p_toxic_junk and toxic (p_toxic >= 0.5) of every document; rows whose crc32 fold of
    3 is 1 are held out of fitting."""
    own = categories()
    chain = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1), own, sample)
    return score(docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), chain, [*own]).withColumn("toxic", F.col("p_toxic") >= 0.5)
