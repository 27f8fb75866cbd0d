import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def check(df, **more):
    rows = tokens.count_tokens(df, PATH, **more).collect()
    assert Counter((r.doc_id, r.text, r.n_tokens) for r in rows) == Counter(
        (r.doc_id, r.text, count(r.text)) for r in df.collect()
    )


def random_text(rng, n):
    parts = ["a", "the ", "don't", "'ll", "'", "  ", "   \n", "\n\n", "\t", "ü", "漢", "☃", "12", "!?",
             "<|endoftext|>", "<|endof", "text|>", " ", " ", "\x85", " \x1c ", "lowei", "é", "😀"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_odd_rows(odd):
    check(odd)


def test_chunks_of_any_text(make):
    """Short chunks, so that every kind of text is cut everywhere."""
    rng = random.Random(3)
    rows = [(i, random_text(rng, 300), None, None, None) for i in range(150)]
    rows += [(900, "x" * 2000, None, None, None), (901, " " * 2000, None, None, None),
             (902, "a " + " " * 900 + "b" * 900 + "<|endoftext|>" * 40, None, None, None)]
    check(make(rows + rows[:3]), chunk=64, overlap=24)


def test_overlap_is_widened(make):
    """A word longer than the overlaps has no boundary at first."""
    check(make([(1, "one " + "y" * 700 + " two " * 100, None, None, None)]), chunk=50, overlap=5)


def test_text_without_spaces(make, monkeypatch):
    """However wide the overlap must become, a text is encoded at most twice each time."""
    sizes, spliced = [], tokens._spliced
    monkeypatch.setattr(tokens, "_spliced", lambda t, p, c, o: sizes.append((c, o)) or spliced(t, p, c, o))
    check(make([(1, "abc" * 20_000, None, None, None)]), chunk=64, overlap=8)
    assert len(sizes) > 2 and all(c >= o for c, o in sizes)
    encoded = sum(60_000 + 60_000 // c * o for c, o in sizes)
    assert encoded <= 2 * 60_000 * len(sizes)


def test_long_words_are_not_kept():
    encoder = tokens.Encoder(PATH)
    texts = [f"{i} short " + "漢" * (1000 + i) for i in range(20)]
    for t in texts:
        assert encoder.totals([t]) == [count(t)]
        assert encoder.boundaries([t])[0][-1] == (len(t), count(t))
    assert max(map(len, encoder.counts)) <= encoder.KEPT_LENGTH
    assert len(encoder.counts) == 21


ENCODER = tokens.Encoder(PATH)


def library_boundaries(text):
    e = LIBRARY.encode(text, add_special_tokens=False)
    starts = [i for i in range(len(e.ids)) if i == 0 or e.word_ids[i] != e.word_ids[i - 1]]
    return {e.offsets[i][0]: i for i in starts}


@pytest.mark.parametrize("seed", range(40))
def test_boundaries(seed):
    """Words begin where the library's pre-tokens do, with as many tokens before."""
    text = random_text(random.Random(seed), 80)
    for t in (text, text.replace("<|", ""), " ".join(text.replace("<|", "").split())):
        whole = library_boundaries(t)
        (places,) = ENCODER.boundaries([t])
        assert all(whole[p] == n for p, n in places if 0 < p < len(t))
        assert places[-1] == (len(t), count(t))
        assert ENCODER.totals([t]) == [count(t)]


@pytest.mark.parametrize("seed", range(40))
def test_trusted_boundaries(seed):
    """What the first part of a text shows of the library's boundaries below the trusted
    place is what the whole text has."""
    text = random_text(random.Random(seed), 60)
    whole = library_boundaries(text)
    for cut in range(1, len(text)):
        sure = tokens._trusted(text[:cut], len("<|endoftext|>"))
        seen = library_boundaries(text[:cut])
        assert {p for p in seen if p < sure} == {p for p in whole if p < sure}


def test_empty_and_clashing(none, odd):
    assert tokens.count_tokens(none, PATH).collect() == []
    out = tokens.count_tokens(odd.withColumns({"N_tokens": F.lit(1), "row": F.lit("r"), "text_id": F.lit(2)}), PATH)
    assert out.columns == [*odd.columns, "row", "text_id", "n_tokens"]
    assert {(r.row, r.text_id) for r in out.collect()} == {("r", 2)}
