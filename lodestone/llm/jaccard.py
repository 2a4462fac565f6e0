"""Exact n-gram Jaccard join by universe-partition pigeonhole.

A document's set is its distinct shingles of k words, hashed to 64 bits.  Two sets link if num/den of their union is
shared.  Documents of equal sets are one class from the start.

*Size bands.*  A set's partners have sizes in its own band or a neighbouring one, so it is indexed twice: for its own
band and for the next larger one.  Linked sets of a band differ in at most H tokens.

*Segments.*  The token universe is cut into H + 1 ranges.  Sets that differ in at most H tokens agree wholly in one of
them (pigeonhole).  A set's tokens in a range, as one hash, are its segment's key.

*One-deletion neighbourhoods and allocation.*  D of the segments, twice as wide, are indexed with every key that
dropping one token gives, so they also match when one token differs and count twice in the pigeonhole.  That lets each
set leave D other segments unused: it leaves those that cost most candidates, the ones whose tokens are all frequent in
the corpus (empty ones above all), then those with the fewest tokens.  A left segment is still indexed for sets that use
it; a pair is a candidate if either set uses the shared key.  Frequencies steer the cost alone, never the result.

*Candidates.*  Keys are dealt by hash in packed arrays.  A key that few sets share gives all its pairs.  A key that many
share gives the pairs with one member, its pivot (the least), which are linear in number; the members are kept by pivot.
A key that HOT sets of one part of a task share goes to its group by a few of them only; all its members are kept by key,
and get the key's pivot afterwards.  So no group is as large as a family.

*Families.*  After the first components are known, pivots of one component are one family, so members that share many
keys meet once.  A family whose members all fell into one component is done.  Of the rest, members of different components
are compared by their parities in blocks of bounded size.  A block gives a least spanning forest of its components, fewer
pairs than members; these are verified and the components joined.  What is then left between different components,
the pairs too close to call, is given whole.  So no group is expanded into all pairs, and no link between different
components is lost.

*Verification* first compares how many tokens fall in each of 128 ranges, then the parities of how many tokens fall in
each of two or more buckets a token; both bound from below how many tokens differ.  What is left intersects full sets.

A set is named by 62 bits of a hash; a second hash of 64 bits tells if two sets got one name, and then all are renamed.

Defined results: null and empty texts (and texts without a word) have an empty set and link with nothing; a text of
fewer than k words is one shingle; very long texts are taken whole; repeated rows fall into one class, whose id is the
least, so ties decide nothing; rows with a null id get null as their class id if no other member has one; an empty table
gives an empty table; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, lean, materialize, release, sided, slices
from lodestone.llm.components import components
from lodestone.session import ship

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], _U)
#: Keys shared by at most so many sets give all their pairs.
SMALL = 8
#: Of other keys, those that at most so many sets use give all pairs of these sets with the rest.
FEW = 3
#: Sets of one part of a task that make a key hot.
HOT = 64
#: Rows of one block; a task holds two.
BLOCK = 2048
#: Rounds of spanning forests.
FORESTS = 1
#: Words of parities that are compared at once.
TILE = 1 << 19
#: Packed keys in one group of the deal, on average.
GROUP_KEYS = 1 << 20
#: Bits of the filter that spares documents without candidates a second hashing: so many an asked document, within least
#: and most, which bounds what is sent to tasks.
FILTER_EACH, FILTER_BITS, FILTER_MOST = 16, 1 << 23, 1 << 28
CACHE = 1 << 17
#: Bytes of text that are hashed together.
CHUNK = 1 << 22
#: Ranges of the coarse comparison.
COARSE = 128
#: A token is frequent if it is in so many documents, of those so many in one part of a task count; at most so many are told to tasks.
FREQUENT, LOCAL, FREQUENT_TOKENS = 12, 3, 1 << 16
USED, EXACT, _NONE = 1, 2, -1
#: Mark of a set that stands for a hot key's others.
_STANDS = 1
#: Rows of _meet: a pair; a member and its pivot; a hot key and its pivot, or one of its few users; a hot key and a member.
PAIR, STAR, HOT_PIVOT, HOT_USER, HOT_MEMBER = range(5)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class WordHashes(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(len(w), k), _U)
    for i in range(min(k, len(w))):
        h += w[i : i + n] * (_ODD[i % len(_ODD)] + _U(2 * (i // len(_ODD))))
    return np.unique(_mix(h))


def set_id(tokens: np.ndarray, seed: int = 5) -> int:
    """A signed 64-bit name of a set, its two lowest bits free for marks."""
    return int.from_bytes(xxhash.xxh64_digest(tokens.tobytes(), seed), "little", signed=True) & ~3


def check_of(tokens: np.ndarray) -> int:
    """Another signed hash of a set, of 64 bits."""
    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "little", signed=True)


def _among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are in known (sorted)."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def coarse_of(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each of COARSE ranges, 255 at most."""
    return np.minimum(np.bincount((tokens >> _U(57)).astype(np.int64), minlength=COARSE), 255).astype(np.uint8).tobytes()


def parity_of(tokens: np.ndarray) -> bytes:
    """For each of at least two buckets a token (a power of two): whether an odd number of tokens falls in it."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """The parities over half as many buckets (of one set, or a row each)."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def _odd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many parities differ: no more than tokens do. a: one set; b: one set, or a row each."""
    while a.shape[-1] > b.shape[-1]:
        a = _folded(a)
    while b.shape[-1] > a.shape[-1]:
        b = _folded(b)
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Band:
    """The segments for sets of at most hi tokens."""

    def __init__(self, number: int, hi: int, num: int, den: int) -> None:
        self.differ = 2 * hi * (den - num) // (den + num)
        m = self.differ + 1
        per = (den + num) / (2 * (den - num))
        self.spare = min(m // 4, 2 + round(1.5 * m * math.exp(-per)))
        units = m + self.spare
        edge = [2 * min(i, self.spare) + max(0, i - self.spare) for i in range(1, m)]
        self.inner = np.array([(e << 64) // units for e in edge], _U)
        self.salt = _mix(np.arange(m, dtype=_U) + _U((number + 1) << 32))


class Bands:
    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.lows = num, den, [1]
        self.bands = {}

    def of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def get(self, number: int) -> Band:
        if number not in self.bands:
            while len(self.lows) < number + 2:
                self.lows.append(self.lows[-1] * self.den // self.num + 1)
            self.bands[number] = Band(number, self.lows[number + 1] - 1, self.num, self.den)
        return self.bands[number]

    def keys(self, tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys of a set, and a mark for each: USED and EXACT, EXACT (left out by allocation), or 0 (a deletion)."""
        own = self.of(len(tokens))
        mixed = tokens * _U(0xD6E8FEB86659FD93)
        mixed ^= mixed >> _U(32)
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mixed, dtype=_U)))
        often = np.concatenate(([0], np.cumsum(_among(tokens, frequent))))
        keys, marks = [], []
        for number in (own, own + 1):
            band = self.get(number)
            if not band.differ:
                continue
            at = np.concatenate(([0], np.searchsorted(tokens, band.inner), [len(tokens)]))
            sums = total[at[1:]] - total[at[:-1]]
            mark = np.full(len(sums), USED | EXACT, np.int64)
            d = band.spare
            if d:
                size = at[d + 1 :] - at[d:-1]
                cheap = (often[at[d + 1 :]] - often[at[d:-1]] < size).astype(np.int64)
                mark[d + np.argsort((cheap << 32) + size, kind="stable")[:d]] = EXACT
                # a set leaves its first empty segments; of two sets that match in an empty one only, one uses another
                # that the other has not left, so a left empty key, which any number of sets would share, is not needed
                mark[d:][(size == 0) & (mark[d:] == EXACT)] = _NONE
                seg = np.repeat(np.arange(d), at[1 : d + 1] - at[:d])
                keys.append(_mix((sums[seg] - mixed[: at[d]]) + band.salt[seg]))
                marks.append(np.zeros(len(seg), np.int64))
            kept = mark != _NONE
            keys.append(_mix(sums + band.salt)[kept])
            marks.append(mark[kept])
        if not keys:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(marks)


@lru_cache(maxsize=4)
def _bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def sets(docs: DataFrame, k: int, id_col: str, text_col: str, seed: int = 5) -> DataFrame:
    """id, th (a hash of the text), n (how many shingles), sid (null for an empty set), check (a second hash of the set),
    coarse, parity, and on one row of each part the tokens that are frequent in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, 2, 4 * CHUNK)):
            held = [shingles(t, k, hashes) for t in batch.column(2).to_pylist()]
            flat = np.sort(np.concatenate(held)) if held else np.zeros(0, _U)
            start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(flat)))
            often = count >= LOCAL
            rest = [None] * (len(held) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in held], pa.int64()), pa.array([set_id(s, seed) if len(s) else None for s in held], pa.int64()), pa.array([check_of(s) for s in held], pa.int64()), pa.array([coarse_of(s) for s in held], pa.binary()), pa.array([parity_of(s) for s in held], pa.binary()),
                    pa.array([flat[start[often]].view(np.int64).tolist(), *rest] if held else [], pa.list_(pa.int64())), pa.array([count[often].tolist(), *rest] if held else [], pa.list_(pa.int64())),
                ],
                names=["id", "th", "n", "sid", "check", "coarse", "parity", "often", "times"],
            )

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(lean(run), f"id {kind}, th long, n long, sid long, check long, coarse binary, parity binary, often array<long>, times array<long>")


def _frequent(base: DataFrame) -> np.ndarray:
    """The most frequent tokens, sorted; FREQUENT_TOKENS at most."""
    counts = base.filter("often IS NOT NULL").select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("c"))
    top = counts.filter(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "often").limit(FREQUENT_TOKENS).select("often")
    return np.sort(top.toArrow().column(0).to_numpy().view(_U))


def _hot_parted(key: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and ids of one part of a task without most members of its hot keys (`least` or more); and which of the given are hot.

    Of a hot key as many users stay as tell few from many, and one set that stands for it.
    """
    order = np.lexsort((ids & ~3, -(ids & USED), key))
    k, i = key[order], ids[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    hot = np.repeat(size >= least, size)
    if not hot.any():
        return key, ids, np.zeros(len(key), bool)
    place = np.arange(len(k)) - np.repeat(start, size)
    users = hot & (place <= FEW) & ((i & USED) > 0)
    stand = hot & (place == 0)
    was = np.zeros(len(key), bool)
    was[order[hot]] = True
    return np.concatenate((k[~hot | users], k[stand])), np.concatenate((i[~hot | users], i[stand] & ~3 | _STANDS)), was


def _packed_keys(docs: DataFrame, k: int, num: int, den: int, groups: int, frequent: np.ndarray, id_col: str, text_col: str, seed: int) -> DataFrame:
    """p, keys, ids: the keys of all sets (copies within a partition once), packed by group of the deal."""
    told, least = docs.sparkSession.sparkContext.broadcast(frequent), HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen = WordHashes(), _bands(num, den), set()
        for batch in (part for whole in batches for part in slices(whole, 1, CHUNK)):
            keys, ids = [], []
            for t in batch.column(1).to_pylist():
                tokens = shingles(t, k, hashes)
                sid = set_id(tokens, seed) if len(tokens) else None
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                key, mark = bands.keys(tokens, told.value)
                keys.append(key)
                ids.append(sid | mark)
            every = np.concatenate(keys) if keys else np.zeros(0, _U)
            marked = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            group = lambda key: ((key >> _U(32)) % _U(groups)).astype(np.int64)
            key, sid, hot = _hot_parted(every, marked, least)
            if hot.any():
                names = group(every[hot]) << 32 | (every[hot] & _U(0xFFFFFFFF)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([-1 - (int(marked[0]) >> 2) % groups], pa.int64()), pa.array([names.tobytes()], pa.binary()), pa.array([(marked[hot] & ~3).tobytes()], pa.binary())], names=["p", "keys", "ids"])
            p = group(key)
            order = np.argsort(p, kind="stable")
            key, sid, p = key[order].astype(np.uint32), sid[order], p[order]
            start = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
            cut = [*start.tolist(), len(p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[start], pa.int64()), pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([sid[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["p", "keys", "ids"]
            )

    return docs.select(id_col, text_col).mapInArrow(lean(run), "p long, keys binary, ids binary")


def _meet(table: pa.Table) -> pa.Table:
    """One group of the deal: candidate pairs, members of keys that many sets share with their pivots, and what hot keys
    have for theirs (PAIR to HOT_MEMBER)."""
    p = table.column("p")[0].as_py()
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    packed = b"".join(table.column("keys").to_pylist())
    made: dict[int, list[np.ndarray]] = {kind: [np.zeros((0, 2), np.int64)] for kind in range(5)}
    if p < 0:
        made[HOT_MEMBER].append(np.stack((np.frombuffer(packed, np.int64), ids), 1))
    else:
        _met(p, np.frombuffer(packed, np.uint32), ids & ~3, ids & 3, made)
    rows = {kind: np.unique(np.concatenate(x), axis=0) for kind, x in made.items()}
    both = np.concatenate([*rows.values()])
    return pa.table({"kind": pa.array(np.repeat([*rows], [len(x) for x in rows.values()]), pa.int32()), "a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def _met(p: int, key: np.ndarray, sid: np.ndarray, mark: np.ndarray, made: dict[int, list[np.ndarray]]) -> None:
    hot_keys = np.unique(key[mark == _STANDS])
    mark = np.where(mark == _STANDS, 0, mark)
    order = np.lexsort((-mark, sid, key))
    key, sid, mark = key[order], sid[order], mark[order]
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))  # a set's strongest mark for a key
    key, sid, mark = key[first], sid[first], mark[first]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    used = np.add.reduceat(mark & USED, start) > 0
    hot = np.isin(key[start], hot_keys)
    pairs = lambda x, y: made[PAIR].append(np.stack((np.minimum(x, y), np.maximum(x, y)), 1))
    for s in range(2, SMALL + 1):
        rows = start[(size == s) & used & ~hot][:, None] + np.arange(s)
        for i in range(s):
            for j in range(i + 1, s):
                x, y = rows[:, i], rows[:, j]
                ok = ((mark[x] | mark[y]) & USED) > 0
                pairs(sid[x[ok]], sid[y[ok]])
    for g in np.flatnonzero(((size > SMALL) | hot) & used).tolist():
        rows = np.arange(start[g], start[g] + size[g])
        members = sid[rows]
        users = members[(mark[rows] & USED) > 0]
        name = p << 32 | int(key[start[g]])
        if len(users) <= FEW:  # all pairs of these, and no more
            for user in users:
                pairs(user, members[members != user])
            if hot[g]:
                made[HOT_USER].append(np.stack((np.full(len(users), name), users), 1))
            continue
        rest = members[members != users[0]]
        pairs(users[0], rest)
        made[STAR].append(np.stack((rest, np.full(len(rest), users[0])), 1))
        if hot[g]:
            made[HOT_PIVOT].append(np.array([[name, users[0]]]))


def _filter_of(asked: DataFrame) -> np.ndarray:
    """A bit map that has every hash asked for (one column of distinct rows); extra hits only cost time."""
    (c,) = asked.columns
    bits = min(FILTER_MOST, max(FILTER_BITS, 1 << (FILTER_EACH * asked.count()).bit_length()))
    words = asked.select(F.pmod(F.col(c), F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("v"))
    held = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[held.column("w").to_numpy()] = held.column("v").to_numpy()
    return out


def _token_sets(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """sid and tokens, a row a sid, of (at least) the documents whose hash of id and text hash is asked for (one column)."""
    # null ids too: the hash passes over nulls
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(id_col, F.xxhash64(text_col)).alias("at"), F.col(text_col).alias("t"))
    asked = asked.distinct()
    if asked.count() <= BROADCAST_ROWS:
        bits = None
        rows = rows.join(F.broadcast(asked.toDF("at")), "at", "left_semi")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(_filter_of(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in (part for whole in batches for part in slices(whole, 1, CHUNK)):
            if bits is not None:
                at = batch.column(0).to_numpy() % (len(bits.value) * 64)
                batch = batch.filter(pa.array((bits.value[at >> 6] >> (at & 63)) & 1).cast(pa.bool_()))
            held = {}
            for t in batch.column(1).to_pylist():
                tokens = shingles(t, k, hashes)
                sid = set_id(tokens, seed)
                if sid not in seen:
                    seen.add(sid)
                    held[sid] = tokens.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int64()), pa.array([*held.values()], pa.binary())], names=["sid", "tokens"])

    # copies in several tasks: repeated rows, null ids or chance hits of the filter
    return rows.mapInArrow(lean(run), "sid long, tokens binary").dropDuplicates(["sid"])


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    n = _shared(x, y)
    return den * n >= num * (len(x) + len(y) - n)


def _verify(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x, _U), np.frombuffer(y, _U), num, den) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(tokens.withColumnsRenamed({"sid": "b", "tokens": "tb"}), "b").join(tokens.withColumnsRenamed({"sid": "a", "tokens": "ta"}), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def _may_link(n_a: np.ndarray, n_b: np.ndarray, coarse_a: np.ndarray, coarse_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and coarse counts leave room for a link; never false for linked sets."""
    differ = np.abs(coarse_a.astype(np.int64) - coarse_b).sum(-1)
    return (den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)) & ((den + num) * differ <= (den - num) * (n_a + n_b))


def _plausible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, ask_a, ask_b of the pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COARSE)
        for batch in batches:
            ok = _may_link(batch.column(4).to_numpy(), batch.column(5).to_numpy(), grid(batch.column(6)), grid(batch.column(7)), num, den)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "ask_a", "ask_b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "ask_a", "ask_b", "n_a", "n_b", "coarse_a", "coarse_b").mapInArrow(lean(run), "a long, b long, ask_a long, ask_b long")


def _close(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, ask_a, ask_b of the pairs that may link by their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lambda c: [np.frombuffer(x, _U) for x in c.to_pylist()]
        for batch in batches:
            odd = np.array([_odd(x, y) for x, y in zip(words(batch.column(6)), words(batch.column(7)))], np.int64)
            ok = (den + num) * odd <= (den - num) * (batch.column(4).to_numpy() + batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "ask_a", "ask_b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "ask_a", "ask_b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(lean(run), "a long, b long, ask_a long, ask_b long")


class _Block:
    """The members of two blocks of a family: who may link with whom."""

    def __init__(self, table: pa.Table, num: int, den: int) -> None:
        held = [np.frombuffer(x, _U) for x in table.column("parity").to_pylist()]
        width, n = np.array([len(x) for x in held]), table.column("n").to_numpy()
        order = np.lexsort((n, width))
        self.num, self.den, self.n = num, den, n[order]
        self.sid, self.own = (table.column(c).to_numpy()[order] for c in ("sid", "own"))
        self.component = np.unique(table.column("component").to_numpy()[order], return_inverse=True)[1]
        self.two = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        #: of each width its first row, and the parities of its rows by how far they are folded
        self.start = np.flatnonzero(np.concatenate(([True], np.diff(width[order]) > 0)))
        self.grids = []
        for lo, hi in zip(self.start, [*self.start[1:], len(order)]):
            grid = np.stack([held[r] for r in order[lo:hi]])
            self.grids.append({grid.shape[1]: grid})

    def _grid(self, g: int, width: int) -> np.ndarray:
        grids = self.grids[g]
        if width not in grids:
            grids[width] = _folded(self._grid(g, 2 * width))
        return grids[width]

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of rows of different components that may link, by their sizes and how many parities differ, and how
        many do; some rows at once, against all that are as wide or wider."""
        widths = [next(iter(g)) for g in self.grids]
        for g, lo in enumerate(self.start.tolist()):
            w, rows = widths[g], len(next(iter(self.grids[g].values())))
            for h in range(g, len(self.grids)):
                first, other = int(self.start[h]), self._grid(h, w)
                sizes, at = self.n[first : first + len(other)], 0
                while at < rows:
                    # rows of a width are sorted by size, so those of fitting sizes follow each other
                    a = int(np.searchsorted(sizes, -(-self.num * self.n[lo + at] // self.den)))
                    step = max(1, TILE // max(1, (len(other) - a) * w))
                    end = min(rows, at + step)
                    b = int(np.searchsorted(sizes, self.den * self.n[lo + end - 1] // self.num, "right"))
                    if g == h:
                        a = max(a, at + 1)
                    if a < b:
                        yield self._compared(np.arange(lo + at, lo + end), np.arange(first + a, first + b), self._grid(g, w)[at:end], other[a:b])
                    at = end

    def _compared(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = np.bitwise_count(px[:, None] ^ py[None]).sum(-1, dtype=np.int64)
        nx, ny = self.n[x][:, None], self.n[y][None]
        ok = ((self.den + self.num) * odd <= (self.den - self.num) * (nx + ny)) & (self.den * np.minimum(nx, ny) >= self.num * np.maximum(nx, ny))
        ok &= (self.component[x][:, None] != self.component[y][None]) & (x[:, None] < y[None])
        if self.two:
            ok &= self.own[x][:, None] != self.own[y][None]
        i, j = np.nonzero(ok)
        return x[i], y[j], odd[i, j]

    def _spanning(self, x: np.ndarray, y: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some pairs a least spanning forest of the components: each takes its least pair, until none is left."""
        order = np.argsort(odd, kind="stable")
        x, y, odd = x[order], y[order], odd[order]
        label, taken = np.arange(self.component.max() + 1), []
        while True:
            a, b = label[self.component[x]], label[self.component[y]]
            open_ = np.flatnonzero(a != b)
            if not len(open_):
                break
            ends, other = np.concatenate((a[open_], b[open_])), np.concatenate((b[open_], a[open_]))
            pair = np.concatenate((open_, open_))
            rank = np.lexsort((pair, ends))
            one = rank[np.concatenate(([True], ends[rank][1:] != ends[rank][:-1]))]
            taken.append(np.unique(pair[one]))
            up = np.arange(len(label))
            up[ends[one]] = other[one]
            both = (up[up] == np.arange(len(up))) & (np.arange(len(up)) < up)  # two that take the same pair
            up[both] = np.flatnonzero(both)
            while (up[up] != up).any():
                up = up[up]
            label = up[label]
        at = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        return x[at], y[at], odd[at]

    def found(self, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """All pairs, or a least spanning forest of them (taken again and again, so that few pairs are held)."""
        held, size = [], 0
        for tile in self.tiles():
            if len(tile[0]):
                held.append(tile)
                size += len(tile[0])
                if not whole and size > TILE:
                    held = [self._spanning(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y, odd = map(np.concatenate, zip(*held))
        return (x, y) if whole else self._spanning(x, y, odd)[:2]


def _blocks(num: int, den: int, whole: bool):
    def run(table: pa.Table) -> pa.Table:
        """One pair of blocks of a family: pairs of different components that may link, a spanning forest of them or the whole."""
        block = _Block(table, num, den)
        x, y = block.found(whole)
        ends = np.sort(block.sid[np.stack((x, y), 1)], 1)
        return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

    return run


def classes(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id of the class) of every document."""
    found = _classes(docs, k, num, den, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _named(docs: DataFrame, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """All sets, one row for each different one, and the seed under which no two of them have one name."""
    seed = 5
    while True:
        base = materialize(sets(docs, k, id_col, text_col, seed))
        reps = base.filter("sid IS NOT NULL").groupBy("sid").agg(
            F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("first"), F.max("n").alias("n"), F.any_value("coarse").alias("coarse"), F.any_value("parity").alias("parity"), F.min("check").alias("c"), F.max("check").alias("d")
        )
        # of each set the document of the least id (null if there is none other), and the hash that its tokens are asked for by
        reps = reps.select("sid", F.col("first.id").alias("rep"), F.xxhash64("first.id", "first.th").alias("ask"), "n", "coarse", "parity", (F.col("c") != F.col("d")).alias("two"))
        reps = materialize(reps, base.count())
        if reps.filter("two").isEmpty():
            return base, reps.drop("two"), seed
        release(base, reps)
        seed += 1


def _classes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    base, reps, seed = _named(docs, k, id_col, text_col)
    n_sets, total = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // GROUP_KEYS)
    keys = _packed_keys(docs, k, num, den, groups, _frequent(base), id_col, text_col, seed)
    met = materialize(keys.groupBy("p").applyInArrow(_meet, "kind int, a long, b long").distinct(), 8 * n_sets)

    def of(c: str, *columns: str) -> DataFrame:
        return reps.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (of a, b, ask_a, ask_b) that link."""
        asked = pairs.select(F.col("ask_a").alias("i")).unionAll(pairs.select(F.col("ask_b").alias("i")))
        return _verify(pairs.select("a", "b"), _token_sets(docs, asked, k, id_col, text_col, seed), num, den)

    hot = met.filter(F.col("kind").isin(HOT_PIVOT, HOT_USER)).select(F.col("a").alias("key"), "kind", F.col("b").alias("with"))
    hot = met.filter(F.col("kind") == HOT_MEMBER).select(F.col("a").alias("key"), F.col("b").alias("sid")).join(sided(hot, hot.count()), "key").filter("sid != with")
    pairs = met.filter(F.col("kind") == PAIR).select("a", "b").unionAll(hot.select(F.least("sid", "with"), F.greatest("sid", "with"))).distinct()
    likely = materialize(_plausible(pairs.join(of("a", "n", "ask", "coarse"), "a").join(of("b", "n", "ask", "coarse"), "b"), num, den), n_sets)
    close = materialize(_close(likely.join(of("a", "n", "parity"), "a").join(of("b", "n", "parity"), "b"), num, den), n_sets)
    release(likely)
    links, done = components(verified(close)), close.select("a", "b")
    members = met.filter(F.col("kind") == STAR).select(F.col("b").alias("family"), F.col("a").alias("sid")).unionAll(hot.filter(F.col("kind") == HOT_PIVOT).select("with", "sid")).distinct()
    for whole in [*[False] * FORESTS, True]:
        members = _apart(members, links, n_sets)
        more = _between(members, reps, num, den, whole, n_sets)
        if more is None:
            break
        fresh = materialize(more.join(done, ["a", "b"], "left_anti").join(of("a", "ask"), "a").join(of("b", "ask"), "b"), more.count())
        release(more)
        links = components(verified(fresh).unionAll(links.select("node", "component")))
        done = done.unionAll(fresh.select("a", "b"))
    named = reps.join(links, reps["sid"] == links["node"], "left").select("sid", "rep", F.coalesce("component", "sid").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "c").select(F.col("sid").alias("s"), F.col("c").alias("class"), "component_id")
    out = base.join(named, F.col("sid") == F.col("s"), "left")
    return out.select("id", "th", "n", "sid", "class", F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _apart(members: DataFrame, links: DataFrame, n_sets: int) -> DataFrame:
    """family, sid, component and size of the families that have members in different components. A family is named by its
    pivot, or by the component that the pivot has fallen into since."""
    of = lambda c, name: links.select(F.col("node").alias(c), F.col("component").alias(name))
    merged = members.select("family", "sid").join(of("family", "f"), "family", "left").select(F.coalesce("f", "family").alias("family"), "sid").distinct()
    merged = merged.join(of("sid", "c"), "sid", "left").select("family", "sid", F.coalesce("c", "sid").alias("component"))
    apart = merged.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo != hi")
    return materialize(merged.join(apart.select("family", "size"), "family"), n_sets)


def _between(members: DataFrame, reps: DataFrame, num: int, den: int, whole: bool, n_sets: int) -> DataFrame | None:
    """Pairs (a, b) of one family and different components that may link: a spanning forest a block, or the whole; None
    without any."""
    rows = members.join(reps.select("sid", "n", "parity"), "sid")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid", "family"), F.ceil(F.col("size") / BLOCK))).withColumn("other", F.explode(F.expr(f"sequence(0L, ceil(size / {BLOCK}) - 1)")))
    rows = rows.select("family", "sid", "component", "n", "parity", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = materialize(rows.groupBy("family", "i", "j").applyInArrow(_blocks(num, den, whole), "a long, b long").distinct(), n_sets)
    return None if found.isEmpty() else found


def keep_first(docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that of the smallest id (of the smallest text hash, if an id has several texts).

    Texts without words are no class and all stay, as do rows with a null id.
    """
    found = materialize(_classes(docs, k, num, den, id_col, text_col).filter("sid IS NOT NULL AND id IS NOT NULL").select("id", "th", "class"), docs.count())
    # written first: both sides of the join are then plain exchanges, and Spark splits a class of very many copies
    least = materialize(found.groupBy("class").agg(F.min(F.struct("id", "th")).alias("least")), docs.count())
    go = materialize(found.join(least, "class").filter(F.struct("id", "th") != F.col("least")).select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct(), found.count())
    side = sided(go, go.count())
    kept = docs.join(side, (docs[id_col] == side["_id"]) & (F.xxhash64(docs[text_col]) == side["_th"]), "left_anti")
    if found.groupBy("id", "th").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter(F.col(id_col).isNull() | F.col(text_col).isNull()).unionAll(kept.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).dropDuplicates([id_col, text_col]))
