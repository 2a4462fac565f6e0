"""Encoding, decoding and counts against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe
from tests.llm.helpers import empty_frame, odd_frame, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "½", "!", "#", "\xa0", "　", "\x1c", "\x85", "😀", "漢", "<|endoftext|>", "\r\n", "ß", "​", "ⅷ", "_", "the", " the", "\x00", "﻿"]
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    mine = bpe.load(PATH).encode([text])[0]
    assert np.frombuffer(mine, "<u4").tolist() == ids
    assert bpe.load(PATH).count([text]) == [len(ids)]
    assert bpe.load(PATH).decode(mine) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_pieces(parts):
    same(LIBRARY, "".join(parts))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    if not any("\ud800" <= c <= "\udfff" for c in text):
        same(LIBRARY, text)


def test_whole_tokens_are_proved(library):
    b = bpe.load(PATH)
    whole = b.whole()
    rng = random.Random(1)
    for token in rng.sample(sorted(whole), 300):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if len(b.pattern.findall(text)) == 1:
            assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_cuts_are_certain():
    b = bpe.load(PATH)
    assert not any(not b.joined[x * 256 + y] for t in list(b.vocab)[:5000] for x, y in zip(t, t[1:]))


def test_odd_rows(spark, library):
    docs = odd_frame(spark)
    got = sorted(bpe.encode_digest(docs, PATH).collect(), key=str)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    counts = sorted(map(tuple, bpe.count_tokens(docs, PATH, 512).collect()), key=str)
    assert counts == sorted(((r.doc_id, len((r.text or "").encode()), n, n > 512) for r in docs.select("doc_id", "text").collect() for n in [len(library.encode(r.text or "", add_special_tokens=False).ids)]), key=str)
    full = {tuple(r)[0:1] + (tuple(r)[2],) for r in bpe.encode_documents(docs, PATH).collect()}
    assert full == {(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()}


def test_empty(spark):
    assert bpe.encode_digest(empty_frame(spark), PATH).count() == 0
    assert bpe.count_tokens(empty_frame(spark), PATH).count() == 0


def test_small_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 8)
    b = bpe.Bpe(PATH)
    texts = [t or "" for t in odd_texts()] * 2
    assert [len(p) // 4 for p in b.encode(texts)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_words(library):
    """Words of a million characters cost about what ordinary text costs, and come out as the library has them."""
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    cases = ["x" * 1_000_000, "!?" * 400_000, "abcdefghij" * 80_000, "aaab" * 100_000, "é漢字" * 60_000, "".join(rng.choice(letters) for _ in range(500_000)), "".join(rng.choice(("the", "ing", "tion", "er", "con")) for _ in range(150_000))]
    b = bpe.Bpe(PATH)
    began = time.perf_counter()
    packed = b.encode(cases)
    assert time.perf_counter() - began < 40
    for text, ids in zip(cases, packed):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert b.count(cases) == [len(p) // 4 for p in packed]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abxé!1 ", min_size=1, max_size=300))
def test_long_and_short_ways_agree(text):
    b = bpe.load(PATH)
    words = [w.encode() for w in b.pattern.findall(text)]
    one = b.merge(words)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "LONG", 1)
        other = b.merge(words)
    assert one[0].tolist() == other[0].tolist() and one[1].tolist() == other[1].tolist()
