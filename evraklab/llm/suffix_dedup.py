"""Removal of byte strings that occur twice, by suffix arrays over blocks of meeting passages.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Such
strings may lie in any two documents, so passages that can hold equal ones are first brought
together, without moving the rest of the text:

1. Every window of ``length`` bytes has an anchor, its ``GRAM`` bytes of least hash (the
   leftmost of equals). Equal windows have equal anchors. Windows that share one anchor
   follow each other; their passage, some 280 bytes at 200, is one row of hashes (``anchors``).
2. Anchors found once in the corpus are dropped (``meeting``).
3. Of the rest, equal passages of one anchor are one weighted passage. Their bytes are
   fetched, and blocks of whole anchors are sorted by ``suffix_sort`` (two-stage sorting);
   windows that share ``length`` bytes with a neighbour, or stand for several, are repeated.
4. The repeated windows go back to all places of their passage, overlaps are merged, and
   the texts are cut.

Equal texts are one text throughout, named by two 64-bit hashes. A passage that repeats
itself (a long run of one byte, a period) is one row with its number of times. A passage
shared by a third of the documents amid different text would meet itself in one block: for
anchors with over ``CROWD`` different passages, windows are first counted by hash, and those
that stand alone are left out before the sort, so what remains of such passages is equal and
becomes one. Blocks hold about ``BLOCK`` bytes. Nothing is collected but the number of bytes.

Defined results: null and empty texts are empty and lose nothing; texts of any length pass
whole; repeated rows are each other's copies, so all of them lose all they have from
``length`` bytes on; there is no order and so there are no ties; null ids are kept; an empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evraklab.llm.core import map_batches, splitmix, staged
from evraklab.llm.suffix_sort import repeated_starts

LENGTH = 200
GRAM = 40
BLOCK = 4 << 20
CROWD = 4096
#: Windows of a text looked at together.
PIECE = 1 << 20
#: Low bits of the ordering key that hold a place within a piece.
PLACE_BITS = np.uint64(21)

# Fixed odd base of the rolling hash, and the value of each byte.
BASE = 0x9E3779B97F4A7C15
BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

ANCHOR = "first long, second long, start int, size int, times int, copies long, anchor long, passage long"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class _Rolling:
    """Hashes of any part of ``data``, from one pass: sums of byte values times powers."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        self.inverse = _powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTE[data] * _powers(BASE, n)[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return splitmix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Of all parts of ``length``."""
        return splitmix((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def _least_ahead(key: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every place on (blocks of ``width``: two running minima)."""
    n = len(key) - width + 1
    whole = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(key)] = key
    blocks = whole.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _passages(data: np.ndarray, room: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start, windows, anchor and hash of the passages of one piece.

    ``room``: for every window start whether the window lies within one text.
    """
    roll = _Rolling(data)
    grams = roll.every(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    key = (grams >> PLACE_BITS << PLACE_BITS) | place
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    where = (_least_ahead(key, length - gram + 1) & mask).astype(np.int64)
    starts = np.flatnonzero(room)
    if not len(starts):
        return (starts,) * 4
    anchor = where[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(at, append=len(starts))
    start = starts[at]
    passage = splitmix(roll(start, start + size + (length - 1)) + size.astype(np.uint64))
    return start, size, grams[anchor[at]], passage


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value starts (and the last ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def named(docs: DataFrame) -> DataFrame:
    """(first, second, bytes): every text as UTF-8, null as empty, named by two hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.xxhash64(text).alias("first"),
        F.xxhash64(F.lit(1), text).alias("second"),
        text.cast("binary").alias("bytes"),
    )


def anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each passage of each different text of a batch.

    A row tells of ``size`` * ``times`` windows from ``start`` on: ``times`` equal passages,
    one after the other; ``copies`` texts of the batch have them.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = _read(batch.column("bytes"))
        first = batch.column("first").to_numpy()
        second = batch.column("second").to_numpy()
        pairs = np.stack([first, second], axis=1)
        _, lead, same, copies = np.unique(pairs, axis=0, return_index=True, return_inverse=True, return_counts=True)
        leads = np.zeros(len(first), bool)
        leads[lead] = True
        held = np.zeros(len(first), np.int64)
        held[lead] = copies
        low, high = int(offsets[0]), int(offsets[-1])
        parts = []
        for begin in range(low, max(low, high - length + 1), PIECE):
            stop = min(begin + PIECE, high - length + 1)
            near = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, stop - 1, "right")
            lo = np.maximum(offsets[near[0] : near[1]], begin)
            hi = np.minimum(np.maximum(offsets[near[0] + 1 : near[1] + 1] - length + 1, lo), np.maximum(stop, lo))
            hi = np.where(leads[near[0] : near[1]], hi, lo)
            edge = np.zeros(stop - begin + 1, np.int32)
            np.add.at(edge, lo - begin, 1)
            np.add.at(edge, hi - begin, -1)
            room = np.cumsum(edge[:-1]) > 0
            start, *rest = _passages(data[begin : stop + length - 1], room, length, gram)
            parts.append((start + begin, *rest))
        if not parts:
            return None
        start, size, anchor, passage = map(np.concatenate, zip(*parts, strict=True))
        if not len(start):
            return None
        text = np.searchsorted(offsets, start, "right") - 1
        new = np.ones(len(start), bool)
        new[1:] = (
            (anchor[1:] != anchor[:-1])
            | (passage[1:] != passage[:-1])
            | (text[1:] != text[:-1])
            | (start[1:] != start[:-1] + size[:-1])
        )
        at = np.flatnonzero(new)
        times = np.diff(at, append=len(start))
        start, size, anchor, passage, text = (x[at] for x in (start, size, anchor, passage, text))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(first[text]),
                pa.array(second[text]),
                pa.array((start - offsets[text]).astype(np.int32)),
                pa.array(size.astype(np.int32)),
                pa.array(times.astype(np.int32)),
                pa.array(held[text]),
                pa.array(anchor.view(np.int64)),
                pa.array(passage.view(np.int64)),
            ],
            ["first", "second", "start", "size", "times", "copies", "anchor", "passage"],
        )

    return map_batches(texts, run, ANCHOR)


def meeting(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose anchor stands more than once in the corpus."""
    often = found.groupBy("anchor").agg(F.sum(F.col("times") * F.col("copies")).alias("n")).filter("n > 1")
    return found.join(often.select("anchor"), "anchor", "left_semi")


def different(met: DataFrame) -> DataFrame:
    """Different passages of an anchor with their weight and one place each."""
    order = F.xxhash64("first", "second", "start")
    return met.groupBy("anchor", "passage", "size").agg(
        F.sum(F.col("times") * F.col("copies")).alias("weight"),
        *(F.min_by(c, order).alias(c) for c in ("first", "second", "start")),
    )


def with_bytes(passages: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``passages`` with their bytes, from the texts named in them."""
    piece = F.substring(F.col("bytes"), F.col("start") + 1, F.col("size") + (length - 1))
    held = passages.join(texts, ["first", "second"])
    return held.select("anchor", "passage", "size", "weight", piece.alias("bytes"))


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], marked.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def trimmed(met: DataFrame, passages: DataFrame, texts: DataFrame, length: int, crowd: int = CROWD) -> DataFrame:
    """``met`` without windows that stand alone, for anchors with over ``crowd`` different passages.

    Equal windows have equal hashes, so a hash found once is no repeated window. A passage
    falls into the runs of windows that are left; equal runs are equal passages again.
    """
    crowded = passages.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor")
    crowded = staged(crowded)
    if crowded.isEmpty():
        return met
    inside = staged(with_bytes(passages.join(crowded, "anchor", "left_semi"), texts, length))

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _read(batch.column("bytes"))
        size = batch.column("size").to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        start = offsets[row] - offsets[0] + place
        window = _Rolling(data[offsets[0] : offsets[-1]])(start, start + length)
        columns = [batch.column(c).take(pa.array(row)) for c in ("anchor", "passage", "weight")]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(place.astype(np.int32)), pa.array(window.view(np.int64))],
            ["anchor", "passage", "weight", "place", "window"],
        )

    windows = map_batches(inside, hashes, "anchor long, passage long, weight long, place int, window long")
    windows = staged(windows)
    twice = windows.groupBy("window").agg(F.sum("weight").alias("n")).filter("n > 1").select("window")
    # Runs of windows, their content by the hash of their first window's and all others'.
    by_place = Window.partitionBy("anchor", "passage").orderBy("place")
    left = windows.join(twice, "window", "left_semi").withColumn("run", F.col("place") - F.row_number().over(by_place))
    runs = left.groupBy("anchor", "passage", "run").agg(
        F.min("place").alias("ahead"),
        F.count(F.lit(1)).cast("int").alias("kept"),
        F.array_sort(F.collect_list(F.struct("place", "window"))).alias("all"),
    )
    content = F.xxhash64(F.transform("all", lambda x: x["window"]))
    runs = runs.select("anchor", "passage", "ahead", "kept", content.alias("content"))
    hot = met.join(crowded, "anchor", "left_semi")
    # What repeats itself is repeated whole and stays as it is.
    alone = hot.filter("times = 1").join(runs, ["anchor", "passage"])
    alone = alone.withColumns({"start": F.col("start") + F.col("ahead"), "size": F.col("kept"), "passage": F.col("content")})
    rest = met.join(crowded, "anchor", "left_anti").unionByName(hot.filter("times > 1"))
    return staged(rest.unionByName(alone.select(rest.columns)))


def repeated(passages: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(anchor, passage, low, high): the windows of each passage that are found twice.

    Anchors are dealt over blocks of about ``block`` bytes; each block is sorted alone.
    """
    size = passages.agg(F.sum(F.col("size") + (length - 1))).first()[0] or 0
    blocks = max(1, -(-size // block))
    dealt = passages.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))

    def sort(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        strings = table.column("bytes").to_pylist()
        found = repeated_starts(
            strings, table.column("size").to_numpy(), table.column("weight").to_numpy(), length
        )
        rows = [(i, *run) for i, marked in enumerate(found) for run in _runs(marked)]
        who, low, high = zip(*rows, strict=True) if rows else ((), (), ())
        who = pa.array(who, pa.int64())
        return pa.table(
            {
                "anchor": table.column("anchor").take(who),
                "passage": table.column("passage").take(who),
                "low": pa.array(low, pa.int32()),
                "high": pa.array(high, pa.int32()),
            }
        )

    return dealt.groupBy("block").applyInArrow(sort, "anchor long, passage long, low int, high int")


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (first, second, start, stop) joined into maximal ones."""
    by_start = Window.partitionBy("first", "second").orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start") > before)).cast("int")
    island = F.sum("opens").over(by_start)
    spans = spans.withColumn("opens", opens).withColumn("island", island)
    return spans.groupBy("first", "second", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(first, second, spans, kept): the removed spans of each text in order, and what is left of it."""
    by_text = spans.groupBy("first", "second").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")
    )
    both = texts.join(by_text, ["first", "second"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, gone in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                edges = [0, *(x for span in gone for x in (span["start"], span["stop"])), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            columns = [batch.column(c) for c in ("first", "second", "spans")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], ["first", "second", "spans", "kept"])

    schema = "first long, second long, spans array<struct<start:int,stop:int>>, kept binary"
    return both.select("first", "second", "spans", "bytes").mapInArrow(run, schema)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(first, second, spans, kept) of the different texts that lose something.

    ``named`` gives the two hashes by which documents find their text's row.
    """
    texts = named(docs)
    long_enough = texts.filter(F.length("bytes") >= length)
    found = staged(anchors(long_enough, length, gram))
    met = staged(meeting(found))
    # Texts without a meeting passage are not needed again; copies are one text.
    touched = met.select("first", "second").distinct()
    once = long_enough.groupBy("first", "second").agg(F.first("bytes").alias("bytes"))
    once = staged(once.join(touched, ["first", "second"], "left_semi"))
    passages = staged(different(met))
    trim = trimmed(met, passages, once, length, crowd)
    if trim is not met:
        met, passages = trim, staged(different(trim))
    twice = staged(repeated(with_bytes(passages, once, length), length, block))
    spans = met.join(twice, ["anchor", "passage"]).select(
        "first",
        "second",
        (F.col("start") + F.col("low")).alias("start"),
        (F.col("start") + F.col("high") + (F.col("times") - 1) * F.col("size") + (length - 1)).alias("stop"),
    )
    return staged(cut(once, merged(spans.distinct())))


def remove(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans, and what is left, of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    all_docs = docs.select("doc_id", text.alias("text"))
    all_docs = all_docs.withColumns({"first": F.xxhash64("text"), "second": F.xxhash64(F.lit(1), "text")})
    gone = repeats(docs, **options)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return all_docs.join(gone, ["first", "second"], "left").select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("kept", F.col("text").cast("binary")).alias("kept"),
    )


def digest(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, moving no texts."""
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("bigint")
    all_docs = docs.select(
        "doc_id",
        size.alias("n_bytes"),
        F.xxhash64(text).alias("first"),
        F.xxhash64(F.lit(1), text).alias("second"),
        F.sha2(text.cast("binary"), 256).alias("whole"),
    )
    gone = repeats(docs, **options).select(
        "first",
        "second",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"]).alias("lost"),
        F.size("spans").cast("bigint").alias("spans"),
        F.sha2("kept", 256).alias("kept"),
    )
    zero = F.lit(0).cast("bigint")
    return all_docs.join(gone, ["first", "second"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("lost", zero).alias("n_removed"),
        F.coalesce("spans", zero).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
