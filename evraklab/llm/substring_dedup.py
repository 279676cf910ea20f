"""Substring deduplication: Rabin-Karp hashes of every window of words.

A word goes when a window of ``WINDOW`` words over it also starts in a document with a
smaller id. Windows are judged on the input. Overlapping windows merge into maximal
removal intervals.

How it is spread. Documents are dealt to blocks by id, in one shuffle of the text. A
block hashes all its windows and sends, to each of many hash ranges, its distinct hashes
in order with the least document of each; a passage that a third of all documents share
is one entry a block. A range counts in Spark which hashes come from several blocks, and
answers each block with one bit a hash: "a smaller document has this window elsewhere".
Repeats inside a block are settled there. So hashes travel once, sorted and as
differences, and what comes back is a hundredth of that.

Null and empty texts have no words. A null id counts as larger than any other; equal
ids never remove from one another. Other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evraklab.llm.core import splitmix

WINDOW = 13
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK_BYTES = 16 << 20
NULL_ID = np.iinfo(np.int64).max
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Bytes hashed at a time, so that a block's working arrays stay small.
SLICE_BYTES = 4 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every word of a byte buffer.

    The polynomial of a word is the difference of two running sums, brought back to
    position zero by the inverse power.
    """
    space = SPACE[buffer]
    edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(buffer)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(inverse, len(buffer) + 1)[starts]
    return splitmix(value ^ (ends - starts).astype(np.uint64) << np.uint64(52)), starts


def window_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows, the text of each, and the number of words of each text."""
    hashes, owners, sizes = [], [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < SLICE_BYTES):
            total += len(texts[end]) + 1
            end += 1
        buffer = np.frombuffer(b"\n".join(texts[at:end]), np.uint8)
        words, starts = word_hashes(buffer)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
        owner = np.searchsorted(first, starts, side="right") - 1
        sizes[at:end] = np.bincount(owner, minlength=end - at)
        n = len(words) - WINDOW + 1
        if n > 0:
            value = np.zeros(n, np.uint64)
            for k in range(WINDOW):
                value = value * STEP + words[k : k + n]
            whole = owner[:n] == owner[WINDOW - 1 :]
            hashes.append(splitmix(value[whole]))
            owners.append((owner[:n][whole] + at).astype(np.int64))
        at = end
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (
        np.concatenate(hashes) if hashes else none[0],
        np.concatenate(owners) if owners else none[1],
        sizes,
    )


class _Block:
    """Distinct window hashes of a block in order, with the least document of each."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").combine_chunks()
        self.ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.texts = [t or b"" for t in rows.column("text").to_pylist()]
        hashes, self.owner, self.sizes = window_hashes(self.texts)
        self.distinct, self.code = np.unique(hashes, return_inverse=True)
        self.least = np.full(len(self.distinct), NULL_ID, np.int64)
        np.minimum.at(self.least, self.code, self.ids[self.owner])

    def ranges(self, n: int) -> np.ndarray:
        """Where each of ``n`` equal ranges of hashes begins in ``distinct``; the end last."""
        bounds = [(r << 64) // n for r in range(n)]
        at = np.searchsorted(self.distinct, np.array(bounds, np.uint64))
        return np.append(at, len(self.distinct))


def _tabled(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(batches)
    return pa.Table.from_batches(got) if got else None


def removed(docs: DataFrame, bytes_in: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, removal intervals of word positions, kept text.

    ``removed`` holds maximal (start, end) intervals, end exclusive; ``kept`` the other
    words, joined by one blank. ``bytes_in`` is the size of all texts, which sets the
    number of blocks; it is measured when not given.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    if bytes_in is None:
        bytes_in = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, bytes_in // BLOCK_BYTES)
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Salted rows without an id, so that they do not meet in one block.
    key = F.coalesce("doc_id", F.xxhash64("text"))
    dealt = slim.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(parts, "block")
    ranges = parts

    def send(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _tabled(group)
        block = _Block(rows)
        number = rows.column("block")[0].as_py()
        at = block.ranges(ranges)
        for r in range(ranges):
            s, e = at[r], at[r + 1]
            if s == e:
                continue
            ids, rank = np.unique(block.least[s:e], return_inverse=True)
            steps = np.diff(block.distinct[s:e], prepend=np.uint64(0))
            # Byte planes of the differences: the high ones are zero and vanish in compression.
            planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
            small = np.uint16 if len(ids) < 1 << 16 else np.uint32
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r], pa.int32()), pa.array([number], pa.int32()), pa.array([planes], pa.binary()),
                    pa.array([rank.astype(small).tobytes()], pa.binary()), pa.array([np.diff(ids, prepend=0).tobytes()], pa.binary()),
                ],
                ["range", "block", "planes", "ranks", "ids"],
            )

    def count(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _tabled(group).to_pylist()
        hashes, least, sizes = [], [], []
        for row in rows:
            planes = np.frombuffer(row["planes"], np.uint8).reshape(8, -1)
            steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
            hashes.append(np.cumsum(steps, dtype=np.uint64))
            small = np.uint16 if len(row["ranks"]) == 2 * len(steps) else np.uint32
            ids = np.cumsum(np.frombuffer(row["ids"], np.int64))
            least.append(ids[np.frombuffer(row["ranks"], small)])
            sizes.append(len(steps))
        hashes, least = np.concatenate(hashes), np.concatenate(least)
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        lowest = np.minimum.reduceat(least[order], first)
        counts = np.diff(np.append(first, len(order)))
        smallest = np.empty(len(order), np.int64)
        smallest[order] = np.repeat(lowest, counts)
        at = 0
        for row, n in zip(rows, sizes):
            # A window goes from every document above the least one of all blocks; the
            # block knows its own least, so only where another block is below matters.
            lower = smallest[at : at + n] < least[at : at + n]
            at += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]], pa.int32()), pa.array([row["range"]], pa.int32()),
                    pa.array([np.packbits(lower).tobytes()], pa.binary()),
                ],
                ["block", "range", "bits"],
            )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left)
        at = block.ranges(ranges)
        lower = np.zeros(len(block.distinct), bool)
        for row in right.to_pylist():
            s, e = at[row["range"]], at[row["range"] + 1]
            lower[s:e] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=e - s)
        gone = lower[block.code] | (block.least[block.code] < block.ids[block.owner])
        # Windows of a text lie in order, so its slice of ``gone`` is indexed by first word.
        windows = np.bincount(block.owner, minlength=len(block.texts))
        ends = np.cumsum(windows)
        ids, intervals, kept = [], [], []
        for i, text in enumerate(block.texts):
            words = text.split()
            starts = np.flatnonzero(gone[ends[i] - windows[i] : ends[i]])
            spans = []
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > WINDOW)
                begin = starts[np.concatenate([[0], breaks + 1])].tolist()
                end = (starts[np.append(breaks, len(starts) - 1)] + WINDOW).tolist()
                spans = [{"start": s, "end": e} for s, e in zip(begin, end)]
                rest, p = [], 0
                for s, e in zip(begin, end):
                    rest += words[p:s]
                    p = e
                words = rest + words[p:]
            ids.append(None if block.ids[i] == NULL_ID else int(block.ids[i]))
            intervals.append(spans)
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(block.sizes, pa.int64()),
                "removed": pa.array(intervals, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    sent = dealt.groupBy("block").applyInArrow(send, "range int, block int, planes binary, ranks binary, ids binary")
    bits = sent.groupBy("range").applyInArrow(count, "block int, range int, bits binary")
    bits = bits.repartition(parts, "block")
    return dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        cut,
        "doc_id bigint, n_words bigint, removed array<struct<start:int,end:int>>, kept string",
    )
