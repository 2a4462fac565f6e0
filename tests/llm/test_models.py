"""Fitted operators: held-out accuracy on the driver's tables where they exist, odd rows, bounded fitting."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, quality, toxicity
from tests.llm.helpers import empty_frame, frame, odd_frame, words

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
LABELS = "doc_id long, quality int, toxic int"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@needs_data
def test_quality_accuracy(spark):
    labels = table(spark, "labels")
    got = quality.digest(table(spark, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


@needs_data
def test_language_accuracy(spark):
    docs = table(spark, "documents")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def mixed(rng):
    """Texts, labels: shouting is junk, a few words are toxic."""
    rows, labels = [], []
    for i in range(400):
        toxic, junk = i % 5 == 0, i % 4 == 1
        text = words(rng, rng.randint(20, 60))
        if toxic:
            text += " " + " ".join(rng.choice(("zonk", "blarg", "frumpish", "frumpy")) for _ in range(3))
        rows.append((i, text.upper() + "!!" if junk else text))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_toxicity_finds_its_words(spark):
    rng = random.Random(6)
    rows, labels = mixed(rng)
    got = toxicity.digest(frame(spark, rows), spark.createDataFrame(labels[:300], LABELS)).collect()
    fresh = {r.doc_id: r.toxic for r in got if r.doc_id >= 300}
    assert np.mean([fresh[i] == bool(t) for i, _, t in labels[300:]]) > 0.97
    assert got[0].asDict().keys() == {"doc_id", "held_out", "p_junk", "p_toxic", "p_toxic_junk", "toxic"}


@needs_data
def test_toxicity_accuracy(spark):
    labels = table(spark, "labels")
    got = toxicity.digest(table(spark, "documents"), labels).join(labels.filter("toxic IS NOT NULL").withColumnRenamed("toxic", "truth"), "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r.toxic == bool(r.truth) for r in got]) > 0.95
    assert np.mean([r.toxic for r in got if r.truth]) > 0.8


def pair_sum(machine, index, value):
    """The factorisation machine's logit by all pairs of features."""
    z = machine.bias + sum(float(machine.weight[i]) * v for i, v in zip(index, value))
    return z + sum(float(machine.factors[index[a]] @ machine.factors[index[b]]) * value[a] * value[b] for a in range(len(index)) for b in range(a))


def test_quality_query_against_all_pairs(spark):
    rng = random.Random(17)
    rows, labels = mixed(rng)
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    machine = quality.train(docs, labels.filter(quality.fold(F.col("doc_id"), 3) != 1))
    texts = dict(rows)
    for r in quality.digest(docs, labels).collect()[::20]:
        index, value = quality.Features().of(texts[r.doc_id])
        want = 1 / (1 + np.exp(-pair_sum(machine, index.tolist(), value.tolist())))
        assert abs(r.score - want) < 1e-4 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_query_against_plain_network(spark):
    rng = random.Random(18)
    rows = [(i, words(rng, rng.randint(1, 120), ("the", "of", "and") if i % 2 else ("der", "und", "für")), "en" if i % 2 else "de") for i in range(80)]
    docs = frame(spark, rows)
    net = langid.train(docs.filter(quality.fold(F.col("doc_id"), 5) != 0))
    texts = {r[0]: r[1] for r in rows}

    def plain(text):
        raw = text.encode().lower()
        total = np.zeros(len(net.languages))
        for lo in range(0, len(raw), langid.WINDOW):
            own = raw[lo : lo + langid.WINDOW]
            x = own.ljust(langid.WINDOW, b"\0")
            pooled = [max(sum(t[o][x[i + o]][f] for o in range(w)) for i in range(langid.WINDOW - w + 1)) for w, t in zip(langid.WIDTHS, net.tables) for f in range(langid.FILTERS)]
            e = np.exp(np.array(pooled) @ net.head + net.bias)
            total += e / e.sum() * len(own)
        return net.languages[int(total.argmax())], total.max() / total.sum()

    for r in langid.digest(docs).collect()[::12]:
        lang, score = plain(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_query_against_plain_chain(spark):
    rng = random.Random(19)
    rows, labels = mixed(rng)
    docs, labels = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    chain = toxicity.train(docs, labels.filter(quality.fold(F.col("doc_id"), 3) != 1), toxicity.categories())
    texts = dict(rows)
    for r in toxicity.digest(docs, labels).collect()[::15]:
        at, n = toxicity.counts_of(texts[r.doc_id])
        counts, earlier = dict(zip(at.tolist(), n.tolist())), []
        for m in chain.models:
            z = m.bias + sum(counts.get(b, 0) * w for b, w in zip(m.buckets.tolist(), m.weight.tolist())) + sum(c * p for c, p in zip(m.chain.tolist(), earlier))
            earlier.append(1 / (1 + np.exp(-z)))
        assert np.allclose([r.p_junk, r.p_toxic, r.p_toxic_junk], earlier, atol=1e-5)


def test_repeated_ids_teach_once(spark):
    """One labelled id that makes most rows brings one row to the driver."""
    rng = random.Random(20)
    rows, labels = mixed(rng)
    many = [*rows, *[(0, f"{rows[0][1]} {i}") for i in range(1500)]]
    labels = spark.createDataFrame(labels, LABELS)
    taught = []
    for module, train in ((quality, lambda d: quality.train(d, labels)), (toxicity, lambda d: toxicity.train(d, labels, toxicity.categories()))):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "fit", lambda held, y: taught.append(len(held)))
            train(frame(spark, many))
    assert taught == [400, 400]


def test_every_language_is_learnt(spark):
    rows = [(i, f"word{i % 400} text of language {i % 400}", f"l{i % 400:03d}") for i in range(800)]
    net = langid.train(frame(spark, rows), per_language=2)
    assert len(net.languages) == 400


def test_chain_uses_out_of_fold_predictions():
    """A second category that repeats the first leans on the first's probability."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    rows = [(np.array(sorted({int(rng.integers(10, 50)), 5 if t and rng.random() < 0.9 else 6})), np.array([1, 1])) for t in y]
    rows = [(i, np.ones(len(i), np.int64)) for i, _ in rows]
    chain = toxicity.fit(rows, np.stack((y, y), 1))
    assert len(chain.models[1].chain) == 1 and chain.models[1].chain[0] > 0


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.RANK)) / 10)
    index, value = np.array([3, 50, 700, 2100]), np.array([0.5, 1.0, 0.25, 1.0])
    z = m.bias + sum(m.weight[i] * v for i, v in zip(index, value))
    z += sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert abs(m.score(index, value) - 1 / (1 + np.exp(-z))) < 1e-12


def test_scores_need_no_other_columns(spark):
    rng = random.Random(7)
    rows, labels = mixed(rng)
    labels = spark.createDataFrame(labels, LABELS)
    one = {r.doc_id: r.score for r in quality.digest(frame(spark, rows), labels).collect()}
    other = frame(spark, rows).withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(0).cast("long")})
    assert one == {r.doc_id: r.score for r in quality.digest(other, labels).collect()}


def test_odd_rows(spark):
    docs, rng = odd_frame(spark), random.Random(8)
    rows, labels = mixed(rng)
    labels = spark.createDataFrame([*labels, (1, None, 1), (5, 1, None), (None, 1, 1), (6, 0, 0), (6, 1, 1)], LABELS)
    n = docs.count()
    assert quality.digest(docs, labels).count() == n
    assert toxicity.digest(docs, labels).count() == n
    assert {r.score for r in quality.digest(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert {r.p_toxic for r in toxicity.digest(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    got = langid.digest(docs).collect()
    assert len(got) == n
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    for r in got:
        own = [t for i, t in texts if i == r.doc_id]
        if all(t is None or not any(c.isalpha() for c in t) for t in own):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {(r.lang_pred, r.score) for r in langid.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    for f in (lambda d: quality.digest(d, labels), lambda d: toxicity.digest(d, labels), langid.digest, lambda d: quality.keep(d, labels), langid.keep):
        assert f(empty_frame(spark)).count() == 0


def test_keep(spark):
    docs, rng = odd_frame(spark), random.Random(9)
    _, labels = mixed(rng)
    for kept in (quality.keep(docs, spark.createDataFrame(labels, LABELS)), langid.keep(docs)):
        assert kept.columns == docs.columns
        assert kept.subtract(docs).isEmpty()


def test_network_covers_every_byte():
    net = langid.Network(["a", "b"])
    tables = net.pair_tables()
    x = np.zeros((1, langid.WINDOW), np.uint8)
    x[0, 100:104] = (1, 2, 3, 4)
    want = []
    for w, t in zip(langid.WIDTHS, net.tables):
        want.append(max((sum(t[o][x[0, i + o]] for o in range(w)) for i in range(langid.WINDOW - w + 1)), key=lambda v: v[0])[0])
    grid = [sum(t[o][x[:, o : langid.WINDOW - w + 1 + o]] for o in range(w)).max(1)[0, 0] for w, t in zip(langid.WIDTHS, net.tables)]
    assert np.allclose(want, grid)
    z = np.concatenate([sum(t[o][x[:, o : langid.WINDOW - w + 1 + o]] for o in range(w)).max(1) for w, t in zip(langid.WIDTHS, net.tables)], 1) @ net.head + net.bias
    p = np.exp(z) / np.exp(z).sum()
    assert np.allclose(net.window_probabilities(x.reshape(-1), tables), p, atol=1e-5)
