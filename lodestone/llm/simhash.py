"""SimHash fingerprints and search within a Hamming radius, in DataFrame operations only.

A text's terms are its pairs of neighbouring words (a text of one word: that word); each term votes with its 64-bit
hash, once for every time that it occurs, so its weight is its frequency.  A bit is set where more votes are for it than against it.  The votes are summed as
32 longs that each count two bits in their halves, so a text may have up to 2^31 terms.

The search cuts fingerprints into radius + 2 blocks.  Two fingerprints within the radius agree in at least two blocks,
so tables keyed by each pair of blocks hold all of them; a pair is reported by the first table that has it.

Defined results: null text counts as the empty text, whose fingerprint is 0; very long texts vote whole; a bit with as
many votes for as against it is 0; equal texts have equal fingerprints;
rows with equal id and text are one document, returned as often as it occurs; texts of one id follow each other by
their hash; a table of one document has itself as its next; an empty table gives an empty table; other input columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

LANES = 32
_LANE_MASK = (1 << 32) | 1


def terms(text: Column) -> Column:
    """The hashes of a text's terms."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.transform(words, lambda w: F.xxhash64(w))
    pairs = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.xxhash64(F.get(a, i - 1), F.get(a, i)))
    return F.transform(F.array(h), lambda a: F.when(F.size(a) < 2, a).otherwise(pairs(a)))[0]


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and the fingerprint (a long; 0 without terms) of each text; texts with equal keys have to be equal."""
    votes = texts.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("t"))
    sums = [F.sum(F.shiftright("t", k).bitwiseAND(F.lit(_LANE_MASK))).alias(f"s{k}") for k in range(LANES)]
    held = votes.groupBy(*keys).agg(*sums, F.count("t").alias("n"))
    long = lambda x: F.lit(x).cast("bigint")
    bit = lambda count, k: F.when(count * 2 > F.col("n"), long((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(long(0))
    low = [bit(F.col(f"s{k}").bitwiseAND(F.lit((1 << 32) - 1)), k) for k in range(LANES)]
    high = [bit(F.shiftrightunsigned(f"s{k}", 32), k + 32) for k in range(LANES)]
    return held.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), [*low, *high]).cast("bigint").alias("fp"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _next_of(ids: DataFrame, partitions: int) -> DataFrame:
    """ids (doc_id, th, n, copies) with the doc_id and th that follow in ascending order; the first follows the last.

    Rows are dealt by range; what follows a range's last row comes from a table of one row a range.
    """
    ranged = ids.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "th").withColumn("pid", F.spark_partition_id())
    ranged = materialize(ranged)
    w = Window.partitionBy("pid").orderBy(F.col("doc_id").asc_nulls_first(), "th")
    own = F.struct(F.col("doc_id").alias("next_id"), F.col("th").alias("next_th"))
    held = ranged.withColumn("nx", F.lead(own).over(w))
    starts = ranged.groupBy("pid").agg(F.min(F.struct("doc_id", "th")).alias("s"))
    every = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.struct(F.col("s.doc_id").alias("next_id"), F.col("s.th").alias("next_th"))
    edges = starts.select("pid", F.coalesce(F.lead(start).over(Window.orderBy("pid")), F.first(start).over(every)).alias("edge"))
    return held.join(edges, "pid").withColumn("nx", F.coalesce("nx", "edge")).select("doc_id", "th", "n", "copies", "nx.*")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, th, text, edited), (links: doc_id, th, n, copies, next_id, next_th).

    edited: the last floor(n/2) code points of the text replaced by the first as many of the next document.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ids = materialize(base.groupBy("doc_id", "th").agg(F.max(F.length("text").cast("bigint")).alias("n"), F.count(F.lit(1)).alias("copies")))
    if not ids.filter("copies > 1").isEmpty():
        base = base.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    links = materialize(_next_of(ids, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    wanted = links.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), F.expr("int(n div 2)").alias("cut"), F.col("next_id").alias("w_id"), F.col("next_th").alias("w_th"))
    pieces = base.join(wanted, (F.col("th") == F.col("w_th")) & same("doc_id", "w_id")).select("p_id", "p_th", "cut", F.expr("substring(text, 1, cut)").alias("piece"))
    texts = base.join(pieces, (F.col("th") == F.col("p_th")) & same("doc_id", "p_id"))
    return texts.select("doc_id", "th", "text", F.expr("concat(substring(text, 1, length(text) - cut), piece)").alias("edited")), links


def near_counts(fps: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """For each distinct fp of queries: n_near, the rows of fps whose fp is within radius bits of it."""
    pairs = near_pairs(queries.select("fp").distinct(), fps.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")), radius)
    return pairs.groupBy("fp").agg(F.sum("copies").alias("n_near"))


def near_pairs(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """fp, near_fp, distance and index's other columns, for every pair within radius bits; each pair once."""
    blocks = radius + 2
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edge, edge[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(masks[i] | masks[j]) for i, j in combinations(range(blocks), 2)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])
        return df.withColumn("k", F.explode(keys)).select("k.*", F.col("fp").alias(name), *[c for c in df.columns if c != "fp"])

    diff = F.col("q_fp").bitwiseXOR(F.col("near_fp"))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    q, x = keyed(queries.select("fp"), "q_fp").alias("q"), keyed(index, "near_fp").alias("x")
    found = q.join(x, (F.col("q.tab") == F.col("x.tab")) & (F.col("q.key") == F.col("x.key")) & (F.bit_count(diff) <= radius) & (first == F.col("q.tab")))
    return found.select(F.col("q_fp").alias("fp"), "near_fp", F.bit_count(diff).alias("distance"), *[c for c in index.columns if c != "fp"])


def digest(docs: DataFrame, radius: int = 3, every: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, edited_sha256, both fingerprints, near_edited, near_next, and n_near: how many other rows'
    fingerprints are within radius bits (for ids divisible by every; null for the rest)."""
    texts, links = with_edits(docs, id_col, text_col)
    side = lambda e, t, sha: F.struct(F.lit(e).alias("e"), t.alias("t"), sha.alias("sha"))
    sides = F.array(side(False, F.col("text"), F.lit(None).cast("string")), side(True, F.col("edited"), F.sha2("edited", 256)))
    votes = fingerprints(texts.select("doc_id", "th", F.explode(sides).alias("x")).select("doc_id", "th", "x.*"), ["doc_id", "th", "e", "sha"], "t")
    rows = votes.groupBy("doc_id", "th").agg(F.max(F.when(~F.col("e"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("e"), F.col("fp"))).alias("efp"), F.max("sha").alias("edited_sha256"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = rows.join(links.select(F.col("doc_id").alias("l_id"), F.col("th").alias("l_th"), "n", "copies", "next_id", "next_th"), (F.col("th") == F.col("l_th")) & same("doc_id", "l_id")).drop("l_id", "l_th")
    rows = materialize(rows)
    after = rows.select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), F.col("fp").alias("nfp"))
    out = rows.join(after, (F.col("next_th") == F.col("a_th")) & same("next_id", "a_id"))
    single = rows.withColumn("i", F.explode(F.expr("sequence(1L, copies)")))
    near = near_counts(single, rows.filter(F.col("doc_id") % every == 0), radius)
    out = out.join(near, "fp", "left").withColumn("i", F.explode(F.expr("sequence(1L, copies)")))
    return out.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n_near") - 1).alias("n_near"),
    )
