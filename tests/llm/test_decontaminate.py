"""The FM-index and its hits against plain search."""

import hashlib
import random

import duckdb
import numpy as np

from lodestone.llm import decontaminate as D
from lodestone.llm import oracles
from tests.llm.helpers import empty_frame, frame, odd_frame, words

ITEMS = "item_id long, text string"


def plain(rows, items, size=10):
    found = {}
    for item, text in items:
        w = D.words_of(text)
        if item is None:
            continue
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w = D.words_of(text)
        hit, own = [False] * len(w), set()
        for n in {len(f) for f in found}:
            for i in range(len(w) - n + 1):
                names = found.get(tuple(w[i : i + n]))
                if names:
                    own |= names
                    hit[i : i + n] = [True] * n
        out.append((doc, len(w), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def case(rng):
    items = [(i, words(rng, rng.choice((1, 4, 9, 10, 11, 25)))) for i in range(1, 40)]
    rows = []
    for i in range(150):
        parts = [words(rng, rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, len(w))
            parts.insert(rng.randint(0, len(parts)), " ".join(w[a - 12 if a > 12 else 0 : a + 12]).upper())
        rows.append((i, ", ".join(parts)))
    return rows, [*items, (100, None), (101, "?!"), (102, items[0][1]), (None, "of no number")]


def test_hits(spark):
    rows, items = case(random.Random(3))
    bench = spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, D.digest(frame(spark, rows), bench).collect()), key=str) == plain(rows, items)


def test_long_items_and_groups(spark, monkeypatch):
    rows, items = case(random.Random(4))
    items = [x for x in items if x[1] is None or len(D.words_of(x[1])) >= 9]
    monkeypatch.setattr(D, "GROUP_WORDS", 20)  # a benchmark of several groups
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    bench = spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, D.digest(frame(spark, rows), bench).collect()), key=str) == plain(rows, items)


def test_odd_rows(spark):
    docs = odd_frame(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [(1, "one two three"), (2, rows[8][1][5000:5400]), (3, "")]
    bench = spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, D.digest(docs, bench).collect()), key=str) == plain(rows, items)
    none = spark.createDataFrame([], ITEMS)
    assert {r.n_hit for r in D.digest(docs, none).collect()} == {0}
    assert D.digest(empty_frame(spark), bench).count() == 0


def test_clean(spark):
    rows, items = case(random.Random(5))
    items = [x for x in items if x[1] is not None and len(D.words_of(x[1])) >= 9]
    bench, docs = spark.createDataFrame(items, ITEMS), frame(spark, rows)
    cleaned = D.clean(docs, bench)
    assert cleaned.columns == docs.columns
    after = {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()}
    assert not any(r[5] for r in plain([(i, t) for i, (t, _) in after.items()], items))
    assert all(len(t) == n for t, n in after.values())
    clean = {r[0] for r in plain(rows, items) if not r[5]}
    assert all(after[i][0] == t for i, t in rows if i in clean)
    odd = odd_frame(spark)
    assert D.clean(odd, bench).count() == odd.count()
    gone = frame(spark, [(1, items[0][1]), (2, "left " + items[0][1] + " over")])
    assert [(r.doc_id, r.text) for r in D.clean(gone, bench).collect()] == [(2, "left  over")]


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(2, 6, 3000)
    index = D.FmIndex(np.append(text, 1), 6)
    for n in (1, 3, 7):
        rows = np.stack([text[i : i + n] for i in rng.integers(0, 2900, 50)])
        lo, hi = index.search(rows)
        for row, a, b in zip(rows, lo, hi):
            want = [i for i in range(3000 - n + 1) if (text[i : i + n] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_items_without_id_against_sql(spark, monkeypatch, tmp_path):
    rng = random.Random(6)
    rows, _ = case(rng)
    texts = [words(rng, n) for n in (4, 10, 25, 12)]
    items = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[1]), (None, texts[3])]
    rows += [(1000 + i, f"before {t} after") for i, t in enumerate(texts)]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, ITEMS)
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    want = sorted(con.execute(oracles.HITS).fetchall(), key=str)
    assert [r for r in want if r[0] == 1003][0][2:4] == (12, 1)
    for words_a_group in (2_000_000, 5):
        monkeypatch.setattr(D, "GROUP_WORDS", words_a_group)
        assert sorted(map(tuple, D.digest(docs, bench).collect()), key=str) == want
    assert [r.text for r in D.clean(docs, bench).filter("doc_id = 1003").collect()] == ["before  after"]


def test_benchmark_stays_off_the_driver(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item{i} " * 12) for i in range(50)], ITEMS)
    monkeypatch.setattr(D, "GROUP_WORDS", 200)
    groups = D._groups(bench, "item_id", "text")
    assert len(groups) > 1 and sum(n for _, n in groups) == 50 and all(isinstance(path, str) for path, _ in groups)
    assert sorted(t for g in groups for _, t in D._items(g)) == sorted(f"item{i} " * 12 for i in range(50))
