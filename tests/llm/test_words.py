import random

import numpy as np
from quillon.llm.words import LETTERS_DIGITS, STEP, WordHasher, slices


def test_hashes_tell_words_apart():
    """Equal words have equal hashes wherever they stand, others have others."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcü漢") for _ in range(rng.randrange(1, 6))) for _ in range(5000)]
    data = b"  ".join(w.encode() for w in words) + b" "
    starts, ends, hashes = WordHasher()(data)
    found = [data[s:e].decode() for s, e in zip(starts, ends)]
    assert found == words
    by_word = dict(zip(words, hashes.tolist()))
    assert [by_word[w] for w in words] == hashes.tolist()
    assert len(set(by_word.values())) == len(by_word) and 0 not in hashes


def test_words_around_the_longest_part():
    long, rng = b"x" * (STEP + 5), np.random.default_rng(0)
    letters = rng.integers(97, 123, STEP, dtype=np.uint8).tobytes()
    fill = b" ".join(letters[i : i + 5] for i in range(0, STEP, 5))
    data = b" a " + long + b" " + fill + b"   " + long + b" a"
    starts, ends, hashes = WordHasher()(data)
    words = data.split()
    assert [data[s:e] for s, e in zip(starts, ends)] == words
    assert hashes[1] == hashes[-2] and hashes[0] == hashes[-1]
    alone = WordHasher()(fill)[2]
    assert (hashes[2:-2] == alone).all()


def test_no_words():
    for data in (b"", b"   "):
        assert all(len(x) == 0 for x in WordHasher()(data))


def test_letters_and_digits():
    assert "Ab-9_ü!".encode().translate(LETTERS_DIGITS).decode() == "ab 9 ü "


def test_slices():
    assert list(slices([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices([], 6)) == []
