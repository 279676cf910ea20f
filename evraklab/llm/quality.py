"""Quality rules: statistics of each text, and line frequency across a host's documents.

Base statistics need the document alone. The cross-document rule hashes normalised
lines (words joined by one blank, lower-cased), counts for each host in how many
distinct documents a line stands, takes lines above the limits away as boilerplate,
and rejects documents of which too little is left; ``without_boilerplate`` returns the
texts without those lines. Exact copies of a text count as one document there: copying is
for the near-duplicate operators to judge.

Null texts are empty. A null host is a host of its own. Repeated rows are judged row by
row, and rows are told apart by position, so ``docs`` must be a stored table. An empty
table gives an empty result; other columns are not read. A text is held whole by its task,
however long; lines that tie at a limit stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evraklab.llm.core import fresh, map_batches, ragged, staged, utf8

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = re.compile(rb"[#*$%&|<>]")
CONTINUATION = bytes(range(0x80, 0xC0))

# A line is boilerplate where more documents of its host have it than LINE_DOCS, or, on hosts
# too small for that, LEAST_DOCS or more that are above LINE_SHARE of the host's documents.
LINE_DOCS = 20
LEAST_DOCS = 3
LINE_SHARE = 0.5
SALTS = 16
# A document is depleted when fewer words than either bound are left.
LEFT_WORDS = 20
LEFT_SHARE = 0.2

STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that stand twice or more in the text."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = [code.setdefault(w, len(code)) for w in words]
    if len(code) == len(words):
        return 0
    seen: dict[tuple, int] = {}
    first = [seen.setdefault(w, i) for i, w in enumerate(zip(*(ids[k:] for k in range(REPEAT_WINDOW))))]
    if len(seen) == n:
        return 0
    first = np.array(first)
    twice = np.bincount(first, minlength=n)[first] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _stats(text: bytes) -> tuple[tuple[int, ...], list[int], list[int]]:
    """The base statistics, and hash and words of each line that has a word."""
    words = text.split()
    chars = len(text.translate(None, CONTINUATION + b" \t\n\x0b\x0c\r"))
    seen: set[bytes] = set()
    duplicates = 0
    hashes, sizes = [], []
    for line in text.split(b"\n"):
        parts = line.split()
        if parts:
            duplicates += line in seen
            seen.add(line)
            hashes.append(_line_hash(parts))
            sizes.append(len(parts))
    stats = (len(words), chars, len(SYMBOLS.findall(text)), duplicates, _repeat_words(words))
    return stats, hashes, sizes


def _line_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words).lower())


def _measured(docs: DataFrame, host_col: str) -> DataFrame:
    """A staged row per document: its statistics, and hash and words of each of its lines."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats, hashes, sizes, counts, digests = [], [], [], [], []
        for text in utf8(batch.column(3)):
            s, h, n = _stats(text)
            stats.append(s)
            hashes += h
            sizes += n
            counts.append(len(h))
            digests.append(xxhash.xxh64_intdigest(text))
        stats = np.array(stats, np.int64)
        hashes = np.array(hashes, np.uint64).view(np.int64)
        out = [batch.column(0), batch.column(1), batch.column(2)]
        out += [pa.array(stats[:, i]) for i in range(5)]
        out += [ragged(hashes, counts, pa.int64()), ragged(np.array(sizes, np.int64), counts, pa.int64())]
        out.append(pa.array(np.array(digests, np.uint64).view(np.int64)))
        names = ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.RecordBatch.from_arrays(out, [*names, "lines", "sizes", "text_hash"])

    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        F.col("text").cast("string").alias("text"),
    )
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return staged(
        map_batches(
            slim,
            run,
            f"row bigint, doc_id {id_type}, host string, {STATS}, lines array<bigint>, sizes array<bigint>, text_hash bigint",
        )
    )


def _boilerplate(read: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """(row, line, size) of every line that is boilerplate of its document's host.

    Only (host, line hash) rows are shuffled, counted map-side first, so a host or line with
    a third of all rows stays spread. Small hosts have at most ``line_docs / line_share``
    documents; they meet their lines under ``SALTS`` keys, so that the lines of a large host,
    which match none, are spread there too.
    """
    texts = read.groupBy("host", "text_hash").agg(F.min("row").alias("row"))
    once = read.join(texts.select("row"), "row", "left_semi")
    lines = once.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min(LEAST_DOCS, line_docs + 1))
    many = counted.filter(F.col("docs") > line_docs).select("host", "line")
    hosts = texts.groupBy("host").agg(F.count("*").alias("host_docs"))
    small = hosts.filter(line_share * F.col("host_docs") < line_docs)
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    few = counted.filter((F.col("docs") >= LEAST_DOCS) & (F.col("docs") <= line_docs))
    few = few.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int")).join(small, ["host", "salt"])
    few = few.filter(F.col("docs") > line_share * F.col("host_docs")).select("host", "line")

    pairs = read.select("row", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x"))
    pairs = pairs.select("row", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    return pairs.join(many.unionByName(few), ["host", "line"]).select("row", "line", "size")


def judge(
    docs: DataFrame,
    host_col: str = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    left_words: int = LEFT_WORDS,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """One row per document: doc_id, base statistics, words in boilerplate, verdicts.

    The text is read once.
    """
    read = _measured(docs, host_col)
    gone = _boilerplate(read, line_docs, line_share).groupBy("row").agg(F.sum("size").alias("gone"))

    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (F.col("n_line_words") > 0) & (
        (left < left_words) | (left < left_share * F.col("n_words"))
    )
    return (
        read.drop("lines", "sizes", "text_hash", "host")
        .join(gone, "row", "left")
        .withColumn("n_line_words", F.coalesce("gone", F.lit(0)).cast("bigint"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words",
            failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
        )
    )


def without_boilerplate(
    docs: DataFrame, host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE
) -> DataFrame:
    """``docs`` with the boilerplate lines of each text taken out; all rows and columns stay.

    The lines left are those of the input, unchanged and in order, joined by ``\\n``. A text
    of which every line goes becomes empty; a null text stays null.
    """
    found = _boilerplate(_measured(docs, host_col), line_docs, line_share)
    row, lines = fresh(docs, "row"), fresh(docs, "lines")
    gone = found.groupBy("row").agg(F.collect_set("line").alias(lines)).withColumnRenamed("row", row)
    marked = docs.withColumn(row, F.monotonically_increasing_id()).join(staged(gone), row, "left")
    marked = marked.select(*(F.col(f"`{c}`") for c in docs.columns), lines)
    position = docs.columns.index("text")

    def clean(text: str, drop: set[int]) -> str:
        kept = []
        for line in text.split("\n"):
            words = line.encode().split()
            if not words or np.uint64(_line_hash(words)).astype(np.int64) not in drop:
                kept.append(line)
        return "\n".join(kept)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column(position).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[position] = pa.array([clean(t, set(d)) if t and d else t for t, d in pairs], pa.string())
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return map_batches(marked, run, docs.schema)
