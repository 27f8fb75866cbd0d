from collections import Counter

import re

from odd_docs import ODD, SCHEMA, prose
from quillon.llm import audit


def brute(rows, min_docs, top):
    """The audit by plain loops over (text, lang, source)."""
    docs = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for text, lang, source in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holders = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in holders.items() if n >= min_docs}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}

        def share(c, kept=kept):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n) for n, (v, i) in enumerate(found[:most], 1)]
    return sorted(out)


def run(df, **how):
    return sorted(map(tuple, audit.audit(df, **how).collect()))


def test_equals_plain_loops(make):
    rows = [(i, prose(i, 10 + i % 40), "en" if i % 3 else "de", f"s{i % 4}", 1) for i in range(120)]
    df = make(rows, SCHEMA).repartition(5)
    for min_docs, top in ((1, 5), (20, 50), (1000, 3)):
        assert run(df, min_docs=min_docs, top=top) == brute([r[1:4] for r in rows], min_docs, top)


def test_odd_rows(odd, none):
    assert run(odd, min_docs=1) == brute([r[1:4] for r in ODD], 1, 50)
    assert run(odd, min_docs=2, top=3) == brute([r[1:4] for r in ODD], 2, 3)
    assert run(none) == []


def test_documents_that_hold_a_term_in_several_chunks_count_once(make):
    texts = ["word word, (word) x", "Word! word? éWORD", "word-word", "word.", 'x "word"', "no"]
    df = make([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    for least in range(1, 8):
        assert run(df, min_docs=least) == brute([(t, "en", "a") for t in texts], least, 50)


def test_extra_columns_with_names_used_inside(make):
    schema = "term string, chunk string, n int, row_id int, p int, text string, lang string, source string"
    df = make([("t", "c", 1, 2, 3, f"a b{i}", "en", str(i % 2)) for i in range(4)], schema)
    assert run(df, min_docs=1) == brute([(f"a b{i}", "en", str(i % 2)) for i in range(4)], 1, 50)


def test_few_held_chunks(make, monkeypatch):
    texts = [prose(i, 30) for i in range(6)]
    df = make([(i, t, "en", str(i % 2), 1) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(audit, "HELD", 5)
    monkeypatch.setattr(audit, "BLOCK_TERMS", 3)
    assert run(df, min_docs=2) == brute([(t, "en", str(i % 2)) for i, t in enumerate(texts)], 2, 50)
