"""Spelling variants: words one edit apart, by asymmetric q-chunks, grouped under their frequent form.

Of two words one edit apart the shorter (or either of equals) is cut into two disjoint
chunks that cover it. One edit touches at most one of them, so the other stands in the
longer word as a positional gram: in its place, or one place later where the edit inserts
before it. Each word therefore gives its two chunks, and of all its positional grams those
that a chunk can meet: of words as long (shift 0 for both chunks) and of words one shorter
(shift 0 for the first chunk, 1 for the second). Chunks and grams are joined on text,
place and length, which leaves few candidates, and Levenshtein's distance verifies them.
A pair that meets in both chunks is counted once: the second chunk's meeting is dropped
where the first chunk meets too.

All is DataFrame code: words are counted with map-side combination, so a word that makes
up a third of all rows is one row a task; a word has a bounded number of neighbours (edits
of its letters), so no group of pairs grows with the corpus. Common chunks can be met by
many words; the join spreads them over tasks where they are large (AQE), and only verified
pairs leave it.

Defined results: null and empty texts have no words; a null id counts as an empty one in
the hash of ``garble``; texts and words of any length pass whole; repeated rows count each;
ties between forms go to the smallest word in code-point order; an empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.llm.core import staged

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
FACTOR = 5


def lowered(word: Column) -> Column:
    """A-Z in lower case, all else unchanged; words of ASCII alone take Spark's short cut."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(
        F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    )


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id as text, run): every maximal run of letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUNS), F.lit(0))
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), found.alias("found"))
    return named.select("id", F.explode("found").alias("raw")).select("id", lowered(F.col("raw")).alias("run"))


def garble(found: DataFrame) -> DataFrame:
    """(word): the runs; where 199 divides crc32 of ``id:run``, code point hash % length is taken out."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.expr("substring(run, 1, 0 + at)"), F.expr("substring(run, at + 2)"))
    return (
        found.withColumn("h", h)
        .withColumn("at", at)
        .select(F.when(F.col("h") % 199 == 0, without).otherwise(F.col("run")).alias("word"))
    )


def count(occurrences: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    words = occurrences.filter(F.length("word") >= least_length).groupBy("word")
    return words.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _half(size: str) -> str:
    return f"int({size} div 2)"


def chunks(words: DataFrame) -> DataFrame:
    """Two rows a word: (size, slot, piece) of its disjoint chunks, and the word."""
    half = _half("size")
    sized = words.select("word", "n", F.length("word").alias("size"))
    pieces = F.expr(
        f"array(struct(0 AS slot, substring(word, 1, {half}) AS piece),"
        f" struct(1 AS slot, substring(word, 1 + {half}) AS piece))"
    )
    return sized.select("word", "n", "size", F.inline(pieces))


def grams(words: DataFrame) -> DataFrame:
    """Four rows a word: the positional grams that chunks of words of ``size`` can meet.

    ``size`` is the length of the word that gives the chunk: the gram's own word's, or one
    less. ``shift`` is how far the chunk has moved: 1 only behind an insertion.
    """
    length = "length(word)"
    shorter = f"({length} - 1)"

    def gram(size: str, slot: int, shift: int) -> str:
        half = _half(size)
        start, long = (f"1 + {shift}", half) if slot == 0 else (f"1 + {half} + {shift}", f"{size} - {half}")
        return (
            f"struct({size} AS size, {slot} AS slot, {shift} AS shift, substring(word, {start}, {long}) AS piece)"
        )

    pieces = [gram(length, 0, 0), gram(length, 1, 0), gram(shorter, 0, 0), gram(shorter, 1, 1)]
    return words.select("word", "n", F.inline(F.expr(f"array({', '.join(pieces)})")))


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart, in both directions, once."""
    left = chunks(words).alias("c")
    right = grams(words).alias("g")
    same = F.length("g.word") == F.col("c.size")
    # Of words of equal length either could give the chunks: the smaller does.
    once = ~same | (F.col("c.word") < F.col("g.word"))
    first = F.expr(f"substring(c.word, 1, {_half('c.size')}) = substring(g.word, 1, {_half('c.size')})")
    met = (
        (F.col("c.size") == F.col("g.size"))
        & (F.col("c.slot") == F.col("g.slot"))
        & (F.col("c.piece") == F.col("g.piece"))
        & once
        & ((F.col("c.slot") == 0) | ~first)
        & (F.levenshtein("c.word", "g.word", 1) == 1)
    )
    pair = left.join(right, met).select(
        F.expr(
            "array(struct(c.word AS word, c.n AS n, g.word AS other, g.n AS other_n),"
            " struct(g.word AS word, g.n AS n, c.word AS other, c.n AS other_n))"
        ).alias("both")
    )
    return pair.select(F.inline("both"))


def forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word if frequent enough, else null."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    by_word = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    return words.join(by_word, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling.

    Counts grow at least ``FACTOR`` times along a chain, so there is no cycle and a chain
    of k words takes log2(k) rounds.
    """
    links = staged(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = staged(links.join(up, "root", "left").select("word", "root", "top"))
        if moved.filter("top IS NOT NULL").isEmpty():
            return links
        links = moved.select("word", F.coalesce("top", "root").alias("root"))


def group(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for counted ``words`` (word, n)."""
    words = staged(words)
    formed = staged(forms(words, near(words), factor))
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
