"""Classes against all pairs, and components against union-find."""

import random
from collections import defaultdict

import pytest

from lodestone.llm import jaccard
from lodestone.llm.components import components
from tests.llm.helpers import empty_frame, frame, odd_frame, words


def plain(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and den * n >= num * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = defaultdict(list)
    for a in range(len(rows)):
        if rows[a][0] is not None:
            least[top(a)].append(rows[a][0])
    return sorted(((rows[a][0], len(sets[a]), (min(least[top(a)]) if least[top(a)] else None) if sets[a] else rows[a][0]) for a in range(len(rows))), key=str)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(("changed", "other", "new"))
    return " ".join(w)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_classes(spark, k, num, den):
    rng = random.Random(k)
    base = [words(rng, rng.randint(1, 120)) for _ in range(80)]
    rows = base + [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(120)]
    chain = words(rng, 80)
    for _ in range(15):  # a chain of copies of copies
        chain = edited(rng, chain, 1)
        rows.append(chain)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert sorted(map(tuple, jaccard.classes(frame(spark, rows), k, num, den).collect()), key=str) == plain(rows, k, num, den)


def test_large_groups(spark, monkeypatch):
    """Keys of many members, some in other components, in blocks smaller than the group."""
    rng = random.Random(8)
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    one, two = words(rng, 100), words(rng, 100)
    half = " ".join(one.split()[:50] + two.split()[50:])
    rows = [edited(rng, rng.choice((one, two, half)), rng.randint(0, 5)) for _ in range(90)] + [one] * 20
    rows = list(enumerate(rows))
    assert sorted(map(tuple, jaccard.classes(frame(spark, rows), 4, 85, 100).collect()), key=str) == plain(rows, 4, 85, 100)


def test_unused_keys_lose_nothing():
    """By each of two linked sets' own allocation, a key that it uses is shared."""
    import numpy as np

    rng = np.random.default_rng(1)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        bands = jaccard.Bands(num, den)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))))
            if np.array_equal(a, b) or not jaccard._linked(a, b, num, den):
                continue
            often = np.unique(rng.choice(a, len(a) // 2))
            (ka, ma), (kb, mb) = bands.keys(a, often), bands.keys(b, often)
            for keys, marks, others in ((ka, ma, kb), (kb, mb, ka)):
                exact = set(keys[(marks & jaccard.USED) > 0].tolist())
                assert exact & set(others.tolist()) or set(keys.tolist()) & set(others.tolist())


def test_odd_rows(spark):
    docs = odd_frame(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.classes(docs, 4, 85, 100).collect()), key=str) == plain(rows, 4, 85, 100)
    assert jaccard.classes(empty_frame(spark), 4, 85, 100).count() == 0


def test_keep_first(spark):
    docs = odd_frame(spark)
    kept = jaccard.keep_first(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    before, after = docs.select("doc_id", "text").collect(), kept.select("doc_id", "text").collect()
    assert len(after) == len(before) - 1  # the repeated row
    assert {tuple(r) for r in after} == {tuple(r) for r in before}
    assert jaccard.keep_first(empty_frame(spark), 5, 80, 100).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)] + [(5, 5), (7, None)] + [(2000, x) for x in range(2001, 2060)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(c):
        root.setdefault(c, c)
        while root[c] != c:
            c = root[c]
        return c

    for a, b in edges:
        if b is not None and a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    assert got == {c: top(c) for c in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_link(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [" ".join([*text.split()[i:], *(f"n{j}" for j in range(i))]) for i in (0, 3, 6)]
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2])]  # 1 and 2 link over a text without an id only
    alone = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(None, alone), (3, alone + " more")]
    got = sorted(map(tuple, jaccard.classes(frame(spark, rows), 4, 80, 100).collect()), key=str)
    assert got == plain(rows, 4, 80, 100)
    assert {c for i, _, c in got if i in (1, 2)} == {1} and sorted(c for i, _, c in got if i is None) == [1, 1, 3]


def test_one_token_row_a_set(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(vocabulary) for _ in range(80))
    rows = [(i, text) for i in range(40)] + [(100 + i, text + " more") for i in range(40)] + [(None, text)] * 5
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 64)  # most copies pass by chance
    monkeypatch.setattr(jaccard, "FILTER_EACH", 1, raising=False)
    seen, verify = [], jaccard._verify

    def watched(pairs, tokens, num, den):
        seen.append((tokens.count(), tokens.select("sid").distinct().count()))
        return verify(pairs, tokens, num, den)

    monkeypatch.setattr(jaccard, "_verify", watched)
    got = sorted(map(tuple, jaccard.classes(frame(spark, rows).repartition(8), 4, 80, 100).collect()), key=str)
    assert got == plain(rows, 4, 80, 100)
    assert seen and all(n == distinct for n, distinct in seen)


def test_one_name_for_two_sets(spark, monkeypatch):
    """If two sets get one name, all are renamed by another seed."""
    rng = random.Random(13)
    rows = list(enumerate(words(rng, 30) for _ in range(20)))
    true = jaccard.set_id
    monkeypatch.setattr(jaccard, "set_id", lambda tokens, seed=5: 4 if seed == 5 else true(tokens, seed))
    base, reps, seed = jaccard._named(frame(spark, rows), 4, "doc_id", "text")
    assert seed == 6 or reps.count() == 20  # workers may hold the function as it was
    monkeypatch.undo()
    base, reps, seed = jaccard._named(frame(spark, rows), 4, "doc_id", "text")
    assert seed == 5 and reps.count() == 20 and base.count() == 20


def test_blocks_against_all_pairs():
    """The whole of a block has all linked pairs of different components; a forest joins what they join."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 200)), dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[rng.random(len(base)) > rng.random() / 5], rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)))) for _ in range(25)]
    component = [min(i, i // 3 * 3) for i in range(len(sets))]
    for two in (False, True):
        own = [i % 2 if two else 0 for i in range(len(sets))]
        table = pa.table({"sid": list(range(len(sets))), "component": component, "n": [len(s) for s in sets], "parity": [jaccard.parity_of(s) for s in sets], "own": own, "i": [0] * len(sets), "j": [int(two)] * len(sets)})
        ask = lambda whole: list(zip(*jaccard._blocks(80, 100, whole)(table).to_pydict().values()))  # noqa: B023, E731
        whole, forest = ask(True), ask(False)
        linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if component[a] != component[b] and not (two and own[a] == own[b]) and jaccard._linked(sets[a], sets[b], 80, 100)}
        assert linked and linked <= set(whole) and set(forest) <= set(whole) and len(forest) < len(set(component))

        def joined(pairs):
            root = {c: c for c in component}
            for a, b in pairs:
                a, b = component[a], component[b]
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            for c in root:
                while root[root[c]] != root[c]:
                    root[c] = root[root[c]]
            return root

        assert joined(whole) == joined(forest)


def test_hot_keys(spark, monkeypatch):
    """Keys that many sets of one part share reach their group by a few sets only, and lose no link."""
    rng = random.Random(21)
    one, two = words(rng, 90), words(rng, 90)
    half = " ".join(one.split()[:45] + two.split()[45:])
    rows = [edited(rng, rng.choice((one, two, half)), rng.randint(0, 6)) for _ in range(110)] + [words(rng, rng.randint(1, 60)) for _ in range(40)] + [one] * 5
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = plain(rows, 4, 85, 100)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    seen = []
    for size in (2, 5, 20):
        monkeypatch.setattr(jaccard, "HOT", size)
        import numpy as np

        key = np.array([7] * 12 + [9] * 2 + [11], np.uint64)
        ids = (np.arange(15) << 2) | np.array([3] * 6 + [2] * 6 + [3] * 3)
        k, i, hot = jaccard._hot_parted(key, ids, size)
        seen.append((int(hot.sum()), len(k)))
        for parts in (1, 4):
            got = sorted(map(tuple, jaccard.classes(frame(spark, rows).repartition(parts), 4, 85, 100).collect()), key=str)
            assert got == want, (size, parts)
    assert seen == [(14, 4 + 1 + 2 + 1 + 1), (12, 4 + 1 + 3), (0, 15)]
