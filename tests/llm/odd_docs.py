"""Small tables with all that may be odd about documents, and plain helpers."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = (
    "the of and to in a is that it was for on are with as be this have from or one had by "
    "word but not what all were we when your can said there use an each which she do how"
).split()


def prose(seed: int, n: int) -> str:
    """n words in an order that `seed` gives, a line break after every 12."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 7 % len(WORDS)] + ("\n" if i % 12 == 11 else " "))
    return "".join(out).strip()


#: Nulls in every column, empty and blank texts, a very long one, copies, repeated rows and
#: ids, ties, letters beyond ASCII.
ODD = [
    (1, prose(1, 40), "en", "a", 1),
    (1, prose(1, 40), "en", "a", 1),
    (1, prose(2, 30), "en", "b", 1),
    (2, prose(1, 40), "de", "a", 2),
    (3, None, None, None, None),
    (None, None, None, None, None),
    (None, prose(3, 25), "en", None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n\x0b\f\r ", None, "b", 7),
    (6, prose(6, 30_000), "en", "a", 6),
    (7, "Ünï çödé ñ 漢字 naïve ☃ 12,5% don't!", "fr", "c", 9),
    (8, "word", "en", "b", 4),
    (9, "word", "en", "b", 4),
    (10, "x" * 50_000, "en", "c", 5),
    (11, "\n".join([prose(11, 12)] * 5), "en", "a", 5),
]


def groups(n, edges):
    """The smallest member of the group of each of n members, linked by edges."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
