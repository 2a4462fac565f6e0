"""Byte-pair encoding, decoding and token counts for byte-level BPE vocabularies in the tokenizers library's JSON form.

Encoding cuts each text three times before any merge is tried:

1. at added (special) token strings, which become their own id;
2. into pre-tokens, by the vocabulary's published split pattern;
3. at *forced boundaries*: two adjacent bytes that stand side by side inside no vocabulary token can never end up in
   one token, so the place between them is a certain cut.

Each fragment is encoded on its own and the ids are concatenated.  Ids travel as little-endian unsigned 32-bit bytes.
Short fragments are merged together, one pair each a pass.  Long fragments are merged together rule by rule, in order of
rank: a rule only joins tokens that rules of lower rank have made, so each rule is applied once, at all its places, and
the work is linear in the length (up to the sorting of places).

Token counts use the *whole-token shortcut*: the merge rules are run over every vocabulary string before the job, which
proves which strings come out as exactly one token; the proof is sent to the tasks.  A pre-token in that set counts 1 and
is never merged.

Defined results: null text counts as the empty text; the empty text has 0 tokens and decodes to ''; repeated rows each
get a row, and equal texts equal values, so ties decide nothing; texts and words of any length are handled whole; an empty
table gives an empty table; input columns other than those named are ignored, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm.common import lean
from lodestone.session import ship

#: The byte-level split pattern (fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beyond ASCII's six: a text that has any is split by PATTERN as a whole.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: White space, then the run after it. No pre-token holds white space after other characters, so these cuts are exact.
_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Stands for "no merge rule": above every rank << 20 | id.
_NONE = 1 << 60
#: Entries, and characters of them, that a cache holds before it becomes the old half.
CACHE, CACHE_CHARS = 1 << 16, 1 << 22
#: Bytes from which a fragment is long.
LONG = 96
#: Characters of text that are encoded together.
_CHUNK = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Generations:
    """A cache of bounded size: when the young half is full it becomes the old half."""

    def __init__(self) -> None:
        self.young, self.old, self.chars = {}, {}, 0

    def fill(self, keys: set, make) -> dict:
        """The cache, holding all of keys; make(list of missing keys) gives their values."""
        if len(self.young) + len(keys) > CACHE or self.chars > CACHE_CHARS:
            self.old, self.young, self.chars = self.young if self.chars <= 2 * CACHE_CHARS else {}, {}, 0
        missing = [k for k in keys if k not in self.young]
        if self.old:
            self.young.update((k, self.old[k]) for k in missing if k in self.old)
            missing = [k for k in missing if k not in self.young]
        if missing:
            self.young.update(zip(missing, make(missing)))
            self.chars += sum(map(len, missing))
        return self.young


class Bpe:
    """One vocabulary, ready to encode, decode and count."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or prefix space is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or need word edges are not supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.vocab = {raw(s): i for s, i in model["vocab"].items() if s not in self.added}
        self.bytes_of = {i: b for b, i in self.vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.base = np.array([self.vocab[bytes([b])] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rules = [(self.vocab[x] << 20 | self.vocab[y], self.vocab[x + y]) for x, y in ((raw(a), raw(b)) for a, b in merges)]
        key, merged = (np.array(x, np.int64) for x in zip(*rules))
        order = np.argsort(key)
        #: sorted left id << 20 | right id, and beside it rank << 20 | merged id
        self.pair_key, self.pair_rule = key[order], (np.arange(len(key)) << 20 | merged)[order]
        #: whether every rule comes after those that make its parts
        made = np.full(int(merged.max()) + 1 if len(merged) else 1, -1)
        made[merged] = np.arange(len(merged))
        parts = np.stack((key >> 20, key & 0xFFFFF))
        self.in_order = len(np.unique(merged)) == len(merged) and bool((np.where(parts < len(made), made[np.minimum(parts, len(made) - 1)], -1) < np.arange(len(key))).all())
        #: joined[a * 256 + b]: the two bytes stand side by side in some token; elsewhere a cut is certain
        self.joined = np.zeros(256 * 256, bool)
        self.joined[[a * 256 + b for t in self.vocab for a, b in zip(t, t[1:])]] = True
        self.pattern = regex.compile(PATTERN)
        self.packs, self.counts = _Generations(), _Generations()
        self._whole: frozenset[bytes] | None = None

    def _rules(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair of ids, _NONE where no rule joins them."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rule[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has.

        Words are cut at forced boundaries; in every short fragment the pair of lowest rank (leftmost on ties) is merged,
        in all fragments at once, until no rule applies.  Long fragments go to merge_long.
        """
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if not len(flat):
            return flat, np.zeros(len(words), np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids, done = self.base[flat], []
        first = np.ones(len(flat), bool)
        first[1:] = (word[1:] != word[:-1]) | ~self.joined[flat[:-1] * 256 + flat[1:]]
        place = np.arange(len(flat))
        size = np.diff(np.append(np.flatnonzero(first), len(flat)))
        if self.in_order and size.max() >= LONG:
            long = np.repeat(size >= LONG, size)
            kept, merged = self.merge_long(ids[long], first[long])
            done.append((place[long][kept], merged, word[long][kept]))
            ids, first, place, word = ids[~long], first[~long], place[~long], word[~long]
        rule = np.full(len(ids), _NONE)
        at = np.flatnonzero(~first[1:])
        rule[at] = self._rules(ids[at], ids[at + 1])
        while len(ids):
            start = np.flatnonzero(first)
            best = np.minimum.reduceat(rule, start)
            live = best != _NONE
            size = np.diff(np.append(start, len(ids)))
            if not live.all():
                keep = np.repeat(live, size)
                done.append((place[~keep], ids[~keep], word[~keep]))
                ids, first, place, rule, word = ids[keep], first[keep], place[keep], rule[keep], word[keep]
                if not len(ids):
                    break
                size, best = size[live], best[live]
                start = np.concatenate(([0], np.cumsum(size)[:-1]))
            hit = np.flatnonzero(rule == np.repeat(best, size))
            frag = np.searchsorted(start, hit, "right") - 1
            hit = hit[np.concatenate(([True], frag[1:] != frag[:-1]))]
            ids[hit] = rule[hit] & 0xFFFFF
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            ids, first, place, rule, word = ids[keep], first[keep], place[keep], rule[keep], word[keep]
            last = np.append(first[1:], True)
            rule[new] = _NONE
            at = new[~last[new]]
            rule[at] = self._rules(ids[at], ids[at + 1])
            at = new[~first[new]] - 1
            rule[at] = self._rules(ids[at], ids[at + 1])
        place, ids, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return ids[order], np.bincount(word, minlength=len(words))

    def merge_long(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that stay after all merges, and their ids; first marks the beginnings of fragments."""
        n = len(ids)
        after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
        after[np.flatnonzero(first[1:])] = -1
        before[first] = -1
        rule, there, waiting, ranks = np.full(n, _NONE), np.ones(n, bool), {}, []

        def note(at: np.ndarray) -> None:
            """Looks up the rules of the pairs that begin at `at`, and has them wait for their rank."""
            rule[at] = _NONE
            at = at[after[at] >= 0]
            rule[at] = found = self._rules(ids[at], ids[after[at]])
            some = found != _NONE
            at, found = at[some], found[some]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            edge = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))).tolist() if len(at) else []
            for lo, hi in zip(edge, [*edge[1:], len(at)]):
                r = int(found[lo])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(at[lo:hi])

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            lists = waiting.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[there[at] & (rule[at] == r)]
            if not len(at):
                continue
            # of pairs that overlap (x x x) every other one, from the left
            joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if joined.any():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            gone = after[at]
            ids[at], there[gone], rule[gone] = r & 0xFFFFF, False, _NONE
            after[at] = after[gone]
            on = at[after[at] >= 0]
            before[after[on]] = on
            left = before[at]
            note(np.union1d(at, left[left >= 0]))
        kept = np.flatnonzero(there)
        return kept, ids[kept]

    def whole(self) -> frozenset[bytes]:
        """The vocabulary strings that the merge rules bring to one token."""
        if self._whole is None:
            tokens = [*self.vocab]
            self._whole = frozenset(t for t, n in zip(tokens, self.merge(tokens)[1].tolist()) if n == 1)
        return self._whole

    def _words(self, pieces: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The pre-tokens of all pieces, and where each piece's begin (with the end of the last)."""
        words, ends = [], [0]
        for piece in pieces:
            words += self.pattern.findall(piece)
            ends.append(len(words))
        return [w.encode() for w in words], np.array(ends)

    def _pack_pieces(self, pieces: list[str]) -> list[bytes]:
        words, ends = self._words(pieces)
        ids, n = self.merge(words)
        packed = ids.astype("<u4").tobytes()
        at = (4 * np.concatenate(([0], np.cumsum(n)))[ends]).tolist()
        return [packed[i:j] for i, j in zip(at, at[1:])]

    def _count_pieces(self, pieces: list[str]) -> list[int]:
        words, ends = self._words(pieces)
        whole, n = self.whole(), np.ones(len(words), np.int64)
        rest = [i for i, w in enumerate(words) if w not in whole]
        n[rest] = self.merge([words[i] for i in rest])[1]
        return np.diff(np.concatenate(([0], np.cumsum(n)))[ends]).tolist()

    def _parts(self, text: str) -> list[str]:
        """text as pieces that can be encoded one by one, added token strings among them."""
        if self.split_added and self.split_added.search(text):
            spans = [s for s in self.split_added.split(text) if s]
        else:
            spans = [text] if text else []
        out = []
        for s in spans:
            if s in self.added or _RARE_SPACE.search(s):
                out.append(s)
            else:
                out += _PIECE.findall(s)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        own = {s: i.to_bytes(4, "little") for s, i in self.added.items()}
        return self._each(texts, self.packs, lambda new: self._keyed(new, own, self._pack_pieces), b"".join)

    def count(self, texts: list[str]) -> list[int]:
        """How many tokens encode() gives for each text."""
        own = dict.fromkeys(self.added, 1)
        return self._each(texts, self.counts, lambda new: self._keyed(new, own, self._count_pieces), sum)

    @staticmethod
    def _keyed(pieces: list[str], own: dict, make) -> list:
        rest = [p for p in pieces if p not in own]
        made = own | dict(zip(rest, make(rest)))
        return [made[p] for p in pieces]

    def _each(self, texts: list[str], cache: _Generations, make, join) -> list:
        out, chunk, room = [], [], _CHUNK
        for i, t in enumerate(texts):
            chunk.append(self._parts(t))
            room -= len(t)
            if room < 0 or i == len(texts) - 1:
                held = cache.fill({p for parts in chunk for p in parts}, make)
                out += [join(map(held.__getitem__, parts)) for parts in chunk]
                chunk, room = [], _CHUNK
        return out

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian uint32 bytes) and decoded text of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            packed = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array([bpe.decode(p) for p in packed], pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _renamed(docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, ids binary, decoded string"), id_col)


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and whether the text came back as it was."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for t, packed in zip(texts, bpe.encode(texts)):
                back = bpe.decode(packed)
                rows.append((len(packed) // 4, sha(packed), sha(back.encode()), back == t))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _renamed(docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"), id_col)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    ship(docs.sparkSession)
    proof = docs.sparkSession.sparkContext.broadcast(load(path).whole())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe._whole = proof.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = bpe.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return _renamed(docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean"), id_col)


def _renamed(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumnRenamed("id", id_col)
