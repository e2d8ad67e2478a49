"""Long words and the worker's memory of BPE, against the tokenizers library."""

import random
import time

import numpy as np
import pytest

from lectern.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return bpe.WordBpe(path), lambda t: library.encode(t, add_special_tokens=False).ids


def ids(coded: bytes) -> list[int]:
    return np.frombuffer(coded, dtype="<u4").tolist()


def test_rounds_of_one_word_equal_the_library(both, monkeypatch):
    model, library = both
    monkeypatch.setattr(bpe, "LONG_WORD", 2)
    monkeypatch.setattr(bpe, "CACHED_CHUNK", 0)
    rng = random.Random(5)
    for alphabet in ("a", "ab", "the", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzéüß", "日本語中文", "!?-=#"):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
        words += ["".join(rng.choice(("ing", "the", "ation", "aa", "ss")) for _ in range(20))]
        assert [ids(x) for x in model.encode(words)] == [library(w) for w in words]


def test_long_words_take_time_by_length(both):
    model, library = both
    text = "".join(random.Random(6).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    begin = time.time()
    assert ids(model.encode([text])[0]) == library(text)
    assert time.time() - begin < 30  # minutes, if every round went over the whole word


def test_memory_is_bounded_by_bytes(both, monkeypatch):
    model, library = both
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100_000)
    rng = random.Random(7)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (50, 100, 4000)] + [f"some word {rng.random()}" for _ in range(30)]
        assert [ids(x) for x in model.encode(texts)] == [library(t) for t in texts]
        assert sum(4 * len(c) + len(x) + bpe.ENTRY_BYTES for c, x in model.known.items()) <= model.held < 200_000
        assert max(map(len, model.known), default=0) <= bpe.CACHED_CHUNK
