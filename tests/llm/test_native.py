"""Shards against a plain recursion, and fingerprints against plain SimHash."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import sharding, simhash
from tests.llm.helpers import empty_frame, frame, odd_frame, words


def plain_shards(rows, limit):
    h = [int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) for i, _ in rows]
    size = [len((t or "").encode()) for _, t in rows]
    out = {}

    def split(own, depth):
        total = sum(size[k] for k in own)
        if total <= limit or len({h[k] for k in own}) == 1:
            for k in own:
                out[k] = (rows[k][0], size[k], depth, h[k] >> (60 - depth), total, len(own))
            return
        for bit in (0, 1):
            half = [k for k in own if h[k] >> (59 - depth) & 1 == bit]
            if half:
                split(half, depth + 1)

    if rows:
        split(range(len(rows)), 0)
    return sorted(out.values(), key=str)


def test_shards(spark):
    rng = random.Random(5)
    for limit in (1, 300, 5000, 10**9):
        rows = [(i, words(rng, rng.randint(0, 60))) for i in range(300)]
        got = sharding.assign(frame(spark, rows), limit).collect()
        assert sorted(map(tuple, got), key=str) == plain_shards(rows, limit)


def test_shards_odd(spark):
    docs = odd_frame(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, sharding.assign(docs, 2000).collect()), key=str) == plain_shards(rows, 2000)
    assert sharding.assign(empty_frame(spark), 10).count() == 0


def test_hot_key_and_rounds(spark):
    rows = [(1, "x" * 100)] * 200 + [(i, "y" * 10) for i in range(2, 150)]
    got = sharding.assign(frame(spark, rows), 64, spare_bits=0).collect()
    assert sorted(map(tuple, got), key=str) == plain_shards(rows, 64)


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [(i, "z" * 50) for i in range(60)])
    sharding.write_shards(docs, f"{tmp_path}/out", 500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 60
    assert back.groupBy("shard_depth", "shard_prefix").agg(F.sum(F.length("text")).alias("b")).filter("b > 500").count() == 0


def test_written_shards_beside_clashing_names(spark, tmp_path):
    docs = frame(spark, [(i, "z" * 50) for i in range(60)] + [(None, "no id")]).withColumns({"shard_depth": F.lit("x"), "Shard_Prefix": F.lit(3), "shard_prefix_": F.lit(4), "row": F.lit(1), "own": F.lit(2), "_key": F.lit(5)})
    sharding.write_shards(docs, f"{tmp_path}/out", 500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == 61
    assert back.groupBy("shard_depth__", "shard_prefix__").agg(F.sum(F.length("text")).alias("b")).filter("b > 500").isEmpty()


def test_shards_by_shuffle(spark, monkeypatch):
    """Many cells and shards are joined by shuffle, with the same result."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 60))) for i in range(200)]
    assert sorted(map(tuple, sharding.assign(frame(spark, rows), 300).collect()), key=str) == plain_shards(rows, 300)


def plain_fp(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = [x for x in text.lower().replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    t = h if len(h) < 2 else [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
    return signed(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in t) > len(t)))


def plain_digest(rows):
    rows = sorted(rows)
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = plain_fp(t), plain_fp(edited), plain_fp(nxt)
        like = lambda x, y: 1 - bin((x ^ y) & ((1 << 64) - 1)).count("1") / 64
        near = sum(like(a, plain_fp(u)) >= 1 - 3 / 64 for _, u in rows) - 1 if i % 100 == 0 else None
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a & (1 << 64) - 1:016x}", f"{b & (1 << 64) - 1:016x}", like(a, b), like(a, c), near))
    return out


def test_fingerprints(spark):
    rng = random.Random(9)
    rows = [(i * 50, words(rng, rng.randint(0, 40))) for i in range(60)]
    rows += [(7, rows[3][1]), (9, rows[3][1] + " end"), (11, ""), (13, "alone"), (15, "äöü 漢字 😀 text")]
    got = sorted(map(tuple, simhash.digest(frame(spark, rows)).collect()))
    assert got == plain_digest(rows)


def test_fingerprints_odd(spark):
    docs = odd_frame(spark)
    got = simhash.digest(docs).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in docs.select("doc_id", "text").collect():
        by_text.setdefault((r.doc_id, len(r.text or "")), set()).add(f"{plain_fp(r.text or '') & (1 << 64) - 1:016x}")
    assert all(r.fingerprint in by_text[r.doc_id, r.n_chars] for r in got if r.n_chars not in (0,))
    assert simhash.digest(empty_frame(spark)).count() == 0
    (one,) = simhash.digest(frame(spark, [(1, "only one text")])).collect()
    assert one.near_next == 1.0


def test_search_is_exact(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.fp, r.near_fp, r.distance) for r in simhash.near_pairs(df, df, 3).collect()}
    flip = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert got == {(a, b, flip(a, b)) for a in signed for b in signed if flip(a, b) <= 3}
    assert simhash.near_pairs(df, df, 3).count() == len(got)
