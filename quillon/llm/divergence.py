"""Quality rules: how far a document's histograms are from those of its language.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import WORD, col, without, written

#: Common words a language's reference has.
COMMON = 16
#: A document of fewer letters-only words, or characters, is not judged by the histogram.
MIN_WORDS, MIN_CHARS = 50, 300
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a document is rejected.
MAX_WORD_DISTANCE, MAX_CHAR_DISTANCE = 0.32, 0.22

#: Characters beside letters: digits, white space, usual punctuation. All else is a class too.
CLASSES = (r"\p{N}", r"\s", r"""[.,;:!?'"()\-]""")
#: Marks of words: one for a word that is not common, and one for each common word.
MARKS = ".abcdefghijklmnop"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ADDED = (*BASE, "word_distance", "char_distance", "kept")


def judge(
    docs: DataFrame,
    *,
    max_word_distance: float = MAX_WORD_DISTANCE,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """`docs` (text, lang) with plain counts, distances from the language and a verdict.

    Counts: n_words; word_chars, characters of words; n_symbols, characters of #*$%&|<>;
    n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words in
    8-word windows found twice or more. base_failed: fewer than 20 words, or more than 30%
    of them in repeated windows.

    The reference of a language is taken from all its texts: the shares of character classes
    (capital letters, other letters, digits, white space, punctuation, all else), and those of
    its COMMON most frequent words and of all other words. Rows without a language have a
    reference of their own. char_distance and word_distance are the Jensen-Shannon distances
    of the document's shares from them; null where the document is too short to judge by it
    (`min_chars`, `min_words`). kept: not base_failed, and neither distance is beyond its
    maximum. A null text counts as empty and fails. Columns of these names in `docs` are
    replaced. Every row is judged by its own text and language, so repeated rows and ids need
    no care; an empty table gives an empty result.
    """
    docs = without(docs, ADDED)
    names = [col(c) for c in docs.columns]
    rows = _profiles(
        docs.select(
            F.struct(*names).alias("row"),
            F.coalesce(col("text").cast("string"), F.lit("")).alias("text"),
            F.coalesce(F.concat(F.lit("="), col("lang").cast("string")), F.lit("")).alias("tongue"),
        )
    )
    reference = written(references(rows))
    met = rows.join(reference.withColumnRenamed("tongue", "of"), F.col("tongue") == F.col("of"), "left")
    # No common word has more characters than the longest, and lower case never has fewer.
    short = F.filter("letter_words", lambda w: F.char_length(w) <= F.col("longest"))
    mark = F.array(*[F.lit(m) for m in MARKS[0] + MARKS])  # none found, an empty word, the common ones
    marks = F.array_join(F.transform(short, lambda w: F.get(mark, F.find_in_set(_lowered(w), F.col("listed")))), "")
    met = _base(met.withColumn("marks", marks))
    n = F.col("n_letter_words")
    counts = [F.length("marks") - F.length(F.replace("marks", F.lit(m))) for m in MARKS[1 : COMMON + 1]]
    counts.append(n - sum(counts[1:], counts[0]))
    word_distance = F.when(n >= min_words, distance(F.array(*[c / n for c in counts]), F.col("word_shares")))
    total = F.length("text")
    char_distance = F.when(
        total >= min_chars, distance(F.transform("classes", lambda c: c / total), F.col("char_shares"))
    )
    far = (F.col("word_distance") > max_word_distance, F.col("char_distance") > max_char_distance)
    return (
        met.withColumn("word_distance", word_distance)
        .withColumn("char_distance", char_distance)
        .select(
            "row.*",
            *BASE,
            "word_distance",
            "char_distance",
            (~F.col("base_failed") & ~F.coalesce(far[0], F.lit(False)) & ~F.coalesce(far[1], F.lit(False))).alias("kept"),
        )
    )


def _profiles(rows: DataFrame) -> DataFrame:
    """Adds the characters of no class (`others`), counts by class, and words of letters only.

    The words of a text in ASCII alone (`plain`) are in lower case, as its lower case has the same
    words; others are as written. There is an empty one where the text begins or ends with no
    letter; n_letter_words does not count those.
    """
    numbers, spaces, usual = CLASSES
    rows = rows.withColumn("rest", F.regexp_replace("text", r"\p{L}+", ""))
    # no character is of two classes, and most are white space
    for name, of, c in (("dense", "rest", spaces), ("marked", "dense", numbers), ("others", "marked", usual)):
        rows = rows.withColumn(name, F.regexp_replace(of, f"{c}+", ""))
    capital = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    sizes = [F.length(c) for c in ("text", "rest", "dense", "marked", "others")]
    letters, space, number, mark = (a - b for a, b in zip(sizes, sizes[1:], strict=False))
    counts = [capital, letters - capital, number, space, mark, sizes[-1]]
    plain = F.octet_length("text") == F.length("text")
    rows = rows.withColumns(
        {
            "classes": F.array(*[c.cast("double") for c in counts]),
            "letter_words": F.split(F.when(plain, F.lower("text")).otherwise(F.col("text")), r"\P{L}+"),
            "plain": plain,
        }
    )
    size = F.size("letter_words")
    first = (F.get("letter_words", F.lit(0)) == "").cast("int")
    last = ((size > 1) & (F.get("letter_words", size - 1) == "")).cast("int")
    return rows.withColumn("n_letter_words", size - first - last).drop("rest", "dense", "marked")


def _lowered(word: Column) -> Column:
    """A word of `letter_words` in lower case."""
    return F.when(F.col("plain"), word).otherwise(F.lower(word))


def references(rows: DataFrame) -> DataFrame:
    """(tongue, common, listed, longest, word_shares, char_shares) from all rows of a language.

    common: words in lower case; listed: an empty word and these, with commas between; longest:
    the characters of the longest one.
    """
    n = 3 + len(CLASSES)
    sums = rows.groupBy("tongue").agg(
        *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)]
    )
    total = sum((F.col(f"c{i}") for i in range(1, n)), F.col("c0"))
    sums = sums.select(
        "tongue", F.array(*[F.try_divide(F.col(f"c{i}"), total) for i in range(n)]).alias("char_shares")
    )
    counted = (
        rows.select("tongue", "plain", F.explode("letter_words").alias("word"))
        .where(F.col("word") != "")
        .groupBy("tongue", _lowered(F.col("word")).alias("word"))
        .agg(F.count("*").alias("n"))
    )
    words = counted.groupBy("tongue").agg(F.sum("n").alias("words"))
    nth = F.row_number().over(Window.partitionBy("tongue").orderBy(F.desc("n"), "word"))
    top = (
        counted.withColumn("nth", nth)
        .where(F.col("nth") <= COMMON)
        .groupBy("tongue")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "word", "n"))).alias("top"))
    )
    met = sums.join(top, "tongue", "left").join(words, "tongue", "left")
    none = F.array().cast("array<struct<nth:int,word:string,n:bigint>>")
    met = met.withColumn("top", F.coalesce("top", none))
    shares = [
        F.coalesce(F.try_divide(F.get("top", F.lit(i))["n"], F.col("words")), F.lit(0.0)) for i in range(COMMON)
    ]
    return met.select(
        "tongue",
        F.transform("top", lambda t: t["word"]).alias("common"),
        F.array(*shares).alias("common_shares"),
        "char_shares",
    ).select(
        "tongue",
        "common",
        F.concat(F.lit(","), F.array_join("common", ",")).alias("listed"),
        F.coalesce(F.array_max(F.transform("common", lambda w: F.char_length(w))), F.lit(0)).alias("longest"),
        F.concat(
            "common_shares",
            F.array(F.lit(1.0) - F.aggregate("common_shares", F.lit(0.0), lambda a, b: a + b)),
        ).alias("word_shares"),
        "char_shares",
    )


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2) of two lists of shares."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y)) / 2).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _pairs(name: str, step: int, of: Callable[[Column, Column], Column]) -> Column:
    """`of` each element of a list and the one `step` after it."""
    n = F.greatest(F.size(name) - step, F.lit(0))
    return F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(1 + step), n), of)


def _repeats(name: str, least: int = 1) -> Column:
    """Whether so many elements of a list equal an earlier one."""
    return F.size(F.array_distinct(name)) + least <= F.size(name)


def _base(rows: DataFrame) -> DataFrame:
    """The plain counts of `text`.

    Windows are compared by 64-bit hashes: of words, of pairs of them, of pairs of those,
    and again. A window found twice makes seven pairs and five fours that equal an earlier one,
    so a text with fewer of these is not hashed further. No function of a list refers to another list from within, as Spark would
    build that one again for every element. Only a text in which two
    are equal goes on to count the words that such windows cover.
    """
    word = WORD.replace("^", "", 1)  # all that is between words
    words = F.array_remove(F.split("text", f"{word}"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = (
        rows.withColumn("words", words)
        .withColumn("lines", lines)
        .withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    )
    hashed: Callable[[Column, Column], Column] = lambda a, b: F.xxhash64(a, b)
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("two", _pairs("one", 1, hashed))
    for name, of, step, least in (("four", "two", 2, 7), ("windows", "four", 4, 5)):
        rows = rows.withColumn(name, F.when(_repeats(of, least), _pairs(of, step, hashed)).otherwise(none))
    repeats = _repeats("windows")
    sorted_ = F.when(
        repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("sorted", sorted_)

    rows = rows.withColumn("equal", _pairs("sorted", 1, lambda a, b: a["h"] == b["h"]))
    found = F.transform(
        "sorted",
        lambda x, k: F.when(
            F.coalesce(F.get("equal", k), F.lit(False)) | F.coalesce(F.get("equal", k - 1), F.lit(False)),
            x["i"],
        ),
    )
    rows = rows.withColumn("at", F.sort_array(F.filter(found, lambda x: x.isNotNull())))
    covered = F.aggregate(
        _pairs("at", 1, lambda a, b: F.least(b - a, F.lit(8))), F.lit(0), lambda n, x: n + x
    )
    repeated = F.when(F.size("at") > 0, covered + 8).otherwise(0)
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length("others") - F.length(F.regexp_replace("others", "[#*$%&|<>]+", "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated,
    }
    rows = rows.withColumns({k: v.cast("bigint") for k, v in counts.items()})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)
