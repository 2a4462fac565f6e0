"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of a partition's documents.  Its words become symbols of the benchmark's vocabulary; stretches
of words that are too short to hold a window, or that hold words the benchmark never uses, cannot contain an occurrence
and stand in the index as one separator (an exact reduction).  The shard's Burrows-Wheeler transform sits in a wavelet
matrix; all windows are searched backward at once through its ranks, occurrences are located by walking to sampled
suffix positions, and overlapping occurrences merge into removal spans.

Spark writes the benchmark to the shared folder in groups of about GROUP_WORDS words, and tasks read one group a pass; a
larger benchmark takes several passes, and none of it goes through the driver.

Defined results: null text has no words; a document or item without words is never hit; very long texts are searched
whole (a shard of their own); overlapping hits are one span, so ties decide nothing; repeated rows each get a row;
repeated items (same id and text) count once; items with a null id hit words like others and count together as one item,
without a name (null, last in items); an empty table gives an empty table, an empty benchmark hits nothing;
other input columns are ignored (find) or passed on (clean), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean, written
from lodestone.session import ship

#: A word: any run of characters but ASCII ones that are neither letter nor digit; upper case is lowered first.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GROUP_WORDS = 2_000_000
SHARD_WORDS = 1_000_000
SAMPLE = 16


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Windows:
    """The distinct windows of some benchmark items, as rows of symbols."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 2) for x in words_of(text)]
            for i in range(max(1, len(w) - size + 1) if w else 0):
                owners.setdefault(tuple(w[i : i + size]), set()).add(item)
        self.rows, self.items = [*owners], [_by_name(s) for s in owners.values()]
        self.length = np.array([len(r) for r in self.rows], np.int64)
        self.least = int(self.length.min()) if self.rows else 0


class FmIndex:
    """Backward search and location over one array of symbols (each at least 1; 0 is the end mark)."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        t = np.append(text, 0).astype(np.int64)
        n = len(t)
        self.suffix = self._suffixes(t)
        self.bwt = t[self.suffix - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=symbols))))
        self.levels, seq = [], self.bwt
        for bit in reversed(range(max(1, int(symbols - 1).bit_length()))):
            ones = (seq >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))), n - int(ones.sum())))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))
        marked = self.suffix % SAMPLE == 0
        self.marks, self.sampled = marked, np.concatenate(([0], np.cumsum(marked)))
        self.samples = self.suffix[marked]
        del self.suffix

    @staticmethod
    def _suffixes(t: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling the length of the compared prefixes."""
        n, k = len(t), 1
        rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
        while True:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
            if new[order[-1]] == n - 1:
                return order
            rank, k = new, 2 * k

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end in the transform."""
        lo = np.zeros(len(end), np.int64)
        hi = end
        for bit, ones, zeros in self.levels:
            is_one = (symbol >> bit) & 1 == 1
            lo, hi = (np.where(is_one, zeros + ones[x], x - ones[x]) for x in (lo, hi))
        return hi - lo

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row (all rows of one length)."""
        c = rows[:, -1]
        lo, hi = self.before[c], self.before[c + 1]
        live = np.flatnonzero(lo < hi)
        for j in range(rows.shape[1] - 2, -1, -1):
            c = rows[live, j]
            a, b = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, by steps back to a sampled one."""
        at, out, steps = at.copy(), np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            here = at[open_]
            hit = self.marks[here]
            done = open_[hit]
            out[done] = self.samples[self.sampled[at[done]]] + steps[done]
            open_ = open_[~hit]
            here = at[open_]
            c = self.bwt[here]
            at[open_] = self.before[c] + self.rank(c, here)
            steps[open_] += 1
        return out


def _runs(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of benchmark words of at least `least`, each followed by a separator; and where each word was."""
    known = np.concatenate(([False], symbols > 1, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    start, end = start[keep], end[keep]
    size = end - start + 1
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    text = symbols[np.minimum(place, len(symbols) - 1)].astype(np.int64)
    text[np.cumsum(size) - 1] = 1
    return text, place


def search_shard(texts: list[str | None], win: Windows) -> tuple[list[int], list[np.ndarray], list[set[str | None]]]:
    """For each text: how many words, which words are hit (a mask), and the items with occurring windows."""
    get, none = win.vocab.get, repeat(1)
    ids = [np.fromiter(map(get, w, none), np.int32, len(w)) for w in map(words_of, texts)]
    n = [len(x) for x in ids]
    # one separator after each text, so that no window reaches over its end
    flat = np.concatenate([y for x in ids for y in (x, np.ones(1, np.int32))]) if ids else np.zeros(0, np.int32)
    begin = np.concatenate(([0], np.cumsum([k + 1 for k in n])))
    change = np.zeros(len(flat) + 1, np.int64)
    items: list[set[str | None]] = [set() for _ in texts]
    text, place = _runs(flat, win.least) if win.rows else (np.zeros(0, np.int64), None)
    if len(text):
        index = FmIndex(text, len(win.vocab) + 2)
        for length in np.unique(win.length):
            which = np.flatnonzero(win.length == length)
            lo, hi = index.search(np.array([win.rows[i] for i in which], np.int64))
            size = hi - lo
            if not size.sum():
                continue
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            found = place[index.locate(at)]
            np.add.at(change, found, 1)
            np.add.at(change, found + length, -1)
            doc = np.searchsorted(begin, found, "right") - 1
            for d, w in np.unique(np.stack((doc, np.repeat(which, size)), 1), axis=0).tolist():
                items[d].update(win.items[w])
    hit = np.cumsum(change)[:-1] > 0
    return n, [hit[b : b + k] for b, k in zip(begin.tolist(), n)], items


def _shards(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of shards of about SHARD_WORDS words (six bytes each)."""
    start, room = 0, SHARD_WORDS * 6
    for i, t in enumerate(texts):
        room -= len(t or "")
        if room < 0 or i == len(texts) - 1:
            yield start, i + 1
            start, room = i + 1, SHARD_WORDS * 6


def _groups(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[str, int]]:
    """Folders with the benchmark in groups of about GROUP_WORDS words (by bytes, six a word), and their items' number."""
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // (GROUP_WORDS * 6)))
    path = written(items.withColumn("g", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition("g"), "g")
    held = benchmark.sparkSession.read.schema("i string, t string, g long").parquet(path).groupBy("g").count().orderBy("g").collect()
    return [(f"{path}/g={r.g}", r["count"]) for r in held] or [("", 0)]


def _items(group: tuple[str, int]) -> list[tuple[str | None, str]]:
    """The items of one group, read in a task."""
    path, count = group
    if not count:
        return []
    files, at = fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
    parts = [x.path for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet")]
    held = [r for x in parts for t in [pq.read_table(files.open_input_file(x), columns=["i", "t"])] for r in zip(t.column(0).to_pylist(), t.column(1).to_pylist())]
    if len(held) != count:
        raise OSError(f"{len(held)} of {count} benchmark items found in {path}")
    return held


def _by_name(items: set[str | None]) -> list[str | None]:
    """Sorted, the item without an id last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, hits (begin and end word of each merged span) and items (sorted ids) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    state = "n_words long, hits array<struct<begin:int,end:int>>, items array<string>"
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("CAST(array() AS array<struct<begin:int,end:int>>)").alias("hits"), F.expr("CAST(array() AS array<string>)").alias("items"))
    for group in _groups(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            win = Windows(_items(group), size)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                n, spans, items = [], [], []
                before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
                for lo, hi in _shards(texts):
                    for k, mask, own in zip(*search_shard(texts[lo:hi], win)):
                        old_spans, old_items = next(before)
                        for s in old_spans:
                            mask[s["begin"] : s["end"]] = True
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()
                        n.append(k)
                        spans.append([{"begin": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
                        items.append(_by_name(own | set(old_items)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "n_words", "hits", "items"])

        held = held.mapInArrow(lean(run), f"id {kind}, text string, {state}")
    return held.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def digest(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find(docs, benchmark, size)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut_spans(text: str, mask: np.ndarray) -> str:
    """text without its hit words and what stands between two of them."""
    raw = text.encode()
    out, last, open_ = [], 0, False
    for hit, m in zip(mask.tolist(), WORD.finditer(raw.lower())):
        if hit and not open_:
            out.append(raw[last : m.start()])
        if hit:
            last = m.end()
        open_ = hit
    return (b"".join(out) + raw[last:]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every benchmark window cut out of the text; documents that have no word left go.

    A cut that brings a window together is cut in turn.  Untouched texts stay as they are, without words or null too.
    """
    columns, at = docs.columns, docs.columns.index(text_col)
    for group in _groups(benchmark, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            win = Windows(_items(group), size)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                keep = [True] * len(texts)
                for lo, hi in _shards(texts):
                    todo = [*range(lo, hi)]
                    while todo:
                        n, masks, _ = search_shard([texts[i] for i in todo], win)
                        again = []
                        for i, mask in zip(todo, masks):
                            if mask.any():
                                texts[i] = cut_spans(texts[i], mask)
                                keep[i] = not mask.all()
                                again.append(i)
                        todo = again
                arrays = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
                if chars_col in columns:
                    j = columns.index(chars_col)
                    changed = [len(t) if t is not None and t != old else n for t, old, n in zip(texts, batch.column(at).to_pylist(), batch.column(j).to_pylist())]
                    arrays[j] = pa.array(changed, batch.schema.field(j).type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def sha_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
