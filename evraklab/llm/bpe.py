"""Byte-level BPE encoding and decoding.

Merges are made by Arrow tasks, for many words at once: the words stand side by side in one
table, and each step merges the leftmost pair of least rank in every word and looks up its
two new neighbours (``Merger``). Every distinct chunk is merged once for its count in the
corpus, when it is frequent, or once a batch of documents, when it is rare. The frequent
ones form a dictionary of bounded size (``HEAD``), chosen by counts over all documents; it
decides only where a chunk is merged, never what comes out. Decoding concatenates the
binary pieces of the ids.

Texts are first cut into chunks: white-space runs, and runs of other characters with one
leading blank. A match of the word pattern never crosses a chunk, so chunks can be
encoded apart, and they repeat more than texts do.

A word of more than ``SHORT`` bytes is merged with a heap instead, which takes time in
proportion to its length; the table takes its square. A word that is a token is not merged.

Letters and numbers are those of the ``regex`` package. It also takes some code points for
them that Unicode 15.1 does not assign; there the ids can differ from the tiktoken library's.

Ids must be below 2**24; greater ones are refused. Null and empty texts have no ids. Rows are encoded one by one, so ids may be null or
repeated; other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections import Counter
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evraklab.llm.core import Codes, map_batches, most_frequent, ragged, staged

# Fixed value: the white space of the word pattern.
WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
RARE_WHITE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
# A comma or stop behind something else than a letter or number belongs to a longer match.
JOINED_STOP = re.compile(r"[,.](?<![^\W_][,.])")
HEAD = 3 << 18
LONG = 256
FLUSH = 300_000
SHORT = 64  # bytes of the words that are merged many at once; longer ones go to the heap
BLOCK = 4096  # words merged at once
# A pair's key packs two ids; a pair of a word packs its rank and its row.
ID_BITS, ROW_BITS = 25, 7
NO_RANK = 1 << 24
GONE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file, read by the driver alone."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def chunks(text: str) -> list[str]:
    """Cut a text into white-space runs and runs of other characters with one leading blank.

    Where commas and stops only follow words, those that end a run are apart, so that a
    word is the same chunk with and without them.
    """
    plain = not any(p in text for p in ("\0", "\t", "\r", "\x0b", "\x0c", "  ", " \n", "\n ", "\n\n"))
    if plain and (text.isascii() or not RARE_WHITE.search(text)):
        if not JOINED_STOP.search(text):
            text = text.replace(", ", "\0, ").replace(". ", "\0. ").replace(".\n", "\0.\n")
        return [c for c in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if c]
    return CHUNK.findall(text)


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match of the word pattern, by a heap over its pairs."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: merged away
    before = list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@cache
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids whose union is a token, as sorted keys, and the ids of their unions."""
    if max(ranks.values(), default=0) >= NO_RANK:
        raise ValueError(f"ranks of {NO_RANK} and more are not supported")
    union = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                union[left << ID_BITS | right] = rank
    keys = np.fromiter(union, np.int64, len(union))
    order = np.argsort(keys)
    # One more key, above all others, so that every search ends at a key.
    keys = np.append(keys[order], np.iinfo(np.int64).max)
    return keys, np.append(np.fromiter(union.values(), np.int64, len(union))[order], NO_RANK)


class Merger:
    """Merges many words at once: each step joins one pair in every word that has one left."""

    def __init__(self, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray], pattern: str):
        self.ranks, (self.keys, self.unions) = ranks, pairs
        self.pattern = _compiled(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the union of two parts, ``NO_RANK`` where that is no token."""
        key = left << ID_BITS | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.unions[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words of ``SHORT`` bytes at most, one after another, and how many each has.

        Words are columns, bytes rows, between two rows that pair with nothing. A cell of ``least``
        packs the rank of the pair that a part forms with the next one and its row, so that
        the least of a column is the leftmost pair of least rank.
        """
        sizes = np.array([len(w) for w in words])
        letters = np.frombuffer(b"".join(words), np.uint8)
        rows, n = int(sizes.max()) + 2, len(words)
        word = np.repeat(np.arange(n), sizes)
        row = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        ids = np.full((rows, n), NO_RANK, np.int64)
        ids[row, word] = self.bytes[letters]
        least = np.full((rows, n), NO_RANK << ROW_BITS, np.int64)
        least[:-1] = self.rank(ids[:-1], ids[1:]) << ROW_BITS | np.arange(rows - 1)[:, None]
        after = np.repeat(np.arange(1, rows + 1)[:, None], n, axis=1)
        before = after - 2
        gone = np.zeros((rows, n), bool)
        while True:
            best = least.min(axis=0)
            at = np.flatnonzero(best < NO_RANK << ROW_BITS)
            if not len(at):
                break
            union, left = best[at] >> ROW_BITS, best[at] & ((1 << ROW_BITS) - 1)
            right = after[left, at]
            end, start = after[right, at], before[left, at]
            gone[right, at], least[right, at] = True, NO_RANK << ROW_BITS
            ids[left, at], after[left, at], before[end, at] = union, end, left
            least[left, at] = self.rank(union, ids[end, at]) << ROW_BITS | left
            least[start, at] = self.rank(ids[start, at], union) << ROW_BITS | start
        parts = (ids != NO_RANK) & ~gone
        return ids.T[parts.T].astype(np.int32), parts.sum(axis=0)

    def encode(self, chunks_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of chunks, one after another, and how many each has."""
        matches = [self.pattern.findall(c) for c in chunks_]
        per_chunk = np.array([len(m) for m in matches], np.int64)
        words = [m.encode() for found in matches for m in found]
        # A word that is a token is its id; the others follow, those of like length together.
        known = np.array([self.ranks.get(w, GONE) for w in words], np.int64)
        flat, filled = [known.astype(np.int32)], len(words)
        starts, sizes = np.arange(len(words)), np.ones(len(words), np.int64)
        rest = np.flatnonzero(known == GONE)
        lengths = np.array([len(words[i]) for i in rest.tolist()], np.int64)
        order = np.argsort(lengths, kind="stable")
        rest, short = rest[order], int((lengths <= SHORT).sum())
        blocks = [rest[i : min(i + BLOCK, short)] for i in range(0, short, BLOCK)]
        for block in blocks + [rest[i : i + 1] for i in range(short, len(rest))]:
            found = [words[i] for i in block.tolist()]
            if len(found[0]) <= SHORT:
                ids, n = self.merge(found)
            else:
                ids = np.array(heap_merge(found[0], self.ranks), np.int32)
                n = np.array([len(ids)])
            starts[block], sizes[block] = filled + np.cumsum(n) - n, n
            flat.append(ids)
            filled += len(ids)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_chunk)])]
        return _gather(np.concatenate(flat), starts, sizes), np.diff(bounds)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encoder and decoder for one rank file and word pattern."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.spark, self.ranks, self.pattern = spark, ranks, pattern
        self.shared = spark.sparkContext.broadcast((ranks, *_pairs(ranks)))

    def _merger(self) -> Callable[[], Merger]:
        shared, pattern = self.shared, self.pattern
        return lambda: Merger(shared.value[0], shared.value[1:], pattern)

    def encoded(self, words: Column) -> Column:
        """Token ids of each chunk of an array of chunks."""
        merger = self._merger()

        @F.arrow_udf("array<array<int>>")
        def ids_of(lists: pa.Array) -> pa.Array:
            ids, sizes = merger().encode(lists.flatten().to_pylist())
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, ragged(ids, sizes, pa.int32()), mask=lists.is_null())

        return ids_of(words)

    def head(self, docs: DataFrame, text_col: str, size: int = HEAD) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The most frequent chunks of all texts, ``size`` at most, their flat ids and where each begins.

        All chunks are counted, map-side first.
        """
        merger = self._merger()

        def count(batches):
            seen: Counter[str] = Counter()

            def flush() -> pa.RecordBatch:
                out = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
                seen.clear()
                return pa.RecordBatch.from_arrays(out, ["chunk", "n"])

            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.update(chunks(text or ""))
                    if len(seen) > FLUSH:
                        yield flush()
            yield flush()

        def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes = merger().encode(batch.column(0).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), ragged(ids, sizes, pa.int32())], ["chunk", "ids"])

        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        counted = texts.mapInArrow(count, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
        often = (F.col("n") > 1) & (F.length("chunk") <= LONG)
        counted = staged(counted.filter(often))
        rows = map_batches(most_frequent(counted, size).select("chunk"), merge, "chunk string, ids array<int>")
        rows = rows.toArrow()
        ids = rows.column("ids").combine_chunks()
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = np.diff(ids.offsets.to_numpy())
        return rows.column("chunk").combine_chunks(), flat, np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
        """One row per document: its id and ``ids``, the token ids of the whole text."""
        words, flat, begin = self.head(docs, text_col, head)
        known = self.spark.sparkContext.broadcast(words)
        table = self.spark.sparkContext.broadcast((flat, begin))
        merger = self._merger()

        def look_up(batches):
            codes = Codes((w, i) for i, w in enumerate(known.value.to_pylist()))
            flat, begin = table.value
            rare_ids = merger()
            for batch in batches:
                codes.begin()
                numbers = [
                    np.array([codes[c] for c in chunks(text or "")], np.int64) for text in batch.column(1).to_pylist()
                ]
                # One table of ids: the dictionary's, then the batch's rare chunks.
                own, lengths = rare_ids.encode(list(codes.rare))
                ids = np.concatenate([flat, own])
                starts = np.concatenate([begin[:-1], len(flat) + np.cumsum(lengths) - lengths])
                sizes = np.concatenate([np.diff(begin), lengths])
                out, counts = [np.zeros(0, np.int32)], []
                for n in numbers:
                    at = np.where(n >= 0, n, len(begin) - 2 - n)
                    out.append(_gather(ids, starts[at], sizes[at]))
                    counts.append(len(out[-1]))
                lists = ragged(np.concatenate(out), counts, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

        slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        kind = slim.schema["id"].dataType.simpleString()
        return slim.mapInArrow(look_up, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)

    def decoded(self, ids: Column) -> Column:
        """The bytes of an array of ids: their pieces, concatenated."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.decode("latin-1")
        literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        bound = F.transform(
            F.array(literal), lambda t: F.array_join(F.transform(ids, lambda i: t[i]), "")
        )
        return F.encode(bound[0], "ISO-8859-1")

