"""Over-limit events per key, as a fold over time.

An accepted event counts and restarts the key's expiry; a denied one changes
nothing. So a key that stays busy alternates bursts with denials, which no
session window expresses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evraklab.session import cut_lineage

# Accepted events before denial, and the expiry in seconds.
LIMIT = 20
EXPIRY_SECONDS = 60.0


def fold(
    micros: list[int], count: int, last: int, limit: int, expiry: int
) -> tuple[list[bool], int, int]:
    """Denials of ordered event times from a given state, and the state after them."""
    denied = []
    for t in micros:
        if t - last >= expiry:
            count = 0
        if count >= limit:
            denied.append(True)
        else:
            denied.append(False)
            count += 1
            last = t
    return denied, count, last


# Earlier than any event, so that the first one finds the counter expired.
NEVER = -(1 << 62)


#: Rows that a task looks at together; a block of one key may be larger.
ROWS_TOGETHER = 1 << 16
#: A block is so many times the stretch in which an event decides about later ones.
BLOCK_HALOS = 4


class _Blocks:
    """Rows of whole blocks, sorted by block and time: links between fresh starts, in vectors.

    An event is a fresh start if nothing precedes it within the expiry (a root), or if a
    fresh start leads to it: after that one's ``limit`` accepted events, it is the first
    to come once the last of them has expired. A pause ends what a fresh start leads to.
    """

    def __init__(self, table: pa.Table, key: str, limit: int, expiry: int, block: int) -> None:
        at, mine = (table.column(c).to_numpy() for c in ("_at", "_block"))
        keys = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
        n = self.n = len(at)
        new = np.ones(n, bool)
        new[1:] = (mine[1:] != mine[:-1]) | (keys[1:] != keys[:-1])
        self.first = np.flatnonzero(new)  # of each block
        self.group = np.cumsum(new) - 1
        self.own, self.after = at == mine, at > mine
        self.offset = table.column("_us").to_numpy() - mine * block
        # One time line for all blocks: each begins long after the one before has ended.
        line = self.group * (4 * block + expiry) + (self.offset + block)
        index = np.arange(n)
        pause = np.ones(n, bool)
        pause[1:] = line[1:] - line[:-1] >= expiry
        self.roots = np.flatnonzero(pause & self.own)
        ends = np.append(np.flatnonzero(pause), n)
        self.until = ends[np.searchsorted(ends, index, "right")]  # the next pause
        full = index + limit - 1
        known = full < self.until
        leads = np.searchsorted(line, line[np.where(known, full, 0)] + expiry)
        self.leads = np.where(known & (leads < self.until), leads, n)  # n: to none
        ahead = np.append(self.leads, n)
        stays = np.append(self.own, False)[ahead]
        self.stays = np.where(stays, ahead, n)  # with a last place n for "none"

    def exits(self) -> np.ndarray:
        """For every row the place in the next block that it leads to in the end, or -1."""
        last = np.where(self.stays < self.n, self.stays, np.arange(self.n + 1))
        while not np.array_equal(last, further := last[last]):
            last = further
        target = np.append(self.leads, self.n)[last[:-1]]
        outside = np.append(self.after, False)[target]
        first_after = np.full(len(self.first), self.n)
        rows = np.flatnonzero(self.after)
        np.minimum.at(first_after, self.group[rows], rows)
        return np.where(outside, target - first_after[self.group], -1)

    def denials(self, entry: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows governed by a fresh start of their block, and whether each is denied.

        ``entry``: of each block the place of the fresh start that the block before leads
        to, -1 without. Rows behind the block's end count while its last one governs them.
        """
        first_own = np.full(len(self.first), self.n)
        rows = np.flatnonzero(self.own)
        np.minimum.at(first_own, self.group[rows], rows)
        fresh = np.zeros(self.n + 1, bool)
        fresh[self.roots] = True
        fresh[(first_own + entry)[entry >= 0]] = True
        jump = self.stays
        while (jump < self.n).any():
            fresh[jump[fresh]] = True
            jump = jump[jump]
        fresh = fresh[: self.n]
        index = np.arange(self.n)
        start = np.maximum.accumulate(np.where(fresh, index, -1))
        governed = (start >= self.first[self.group]) & ~((index >= self.until[start]) | (index >= self.leads[start]))
        rows = np.flatnonzero(governed & (self.own | self.after))
        return rows, rows - start[rows] >= limit


def _by_blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole blocks out of sorted batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS_TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        last = table.slice(rows - 1)
        same = pc.and_(
            pc.equal(table.column(key), last.column(key)[0]),
            pc.equal(table.column("_block"), last.column("_block")[0]),
        )
        cut = rows - (pc.sum(same).as_py() or 0)
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def _entries(maps: DataFrame, key: str) -> DataFrame:
    """(key, _block, entry): where each block is entered, by pointer doubling over blocks.

    ``maps`` has a row a block: ``exit``, if a pause in it settles where it leads, else
    ``jump``: for each of its first rows where that leads. What a block is entered by is
    known if the block before has an exit; each round carries it over twice as many blocks.
    """
    known = maps.select(key, (F.col("_block") + 1).alias("_block"), F.col("exit").alias("entry"))
    state = maps.select(key, "_block", "jump").join(known, [key, "_block"], "left")
    # A block without one before it begins with a pause and needs no entry.
    before = maps.select(key, (F.col("_block") + 1).alias("_block"), F.lit(True).alias("led"))
    state = state.join(before, [key, "_block"], "left").withColumn(
        "entry", F.when(F.col("led").isNull(), -1).otherwise(F.col("entry"))
    )
    state = cut_lineage(state.drop("led"))
    step = 1
    while not state.where("entry IS NULL").isEmpty():
        back = state.select(
            key, (F.col("_block") + step).alias("_block"), F.col("entry").alias("e0"), F.col("jump").alias("j0")
        )
        on = state.select(key, (F.col("_block") - step).alias("_block"), F.col("jump").alias("j2"))
        there = lambda jump, at: F.when(at < 0, -1).otherwise(F.get(jump, at))
        state = cut_lineage(
            state.join(back, [key, "_block"], "left")
            .join(on, [key, "_block"], "left")
            .select(
                key,
                "_block",
                F.coalesce("entry", there(F.col("j0"), F.col("e0"))).alias("entry"),
                F.when(
                    F.col("j2").isNotNull(), F.transform("jump", lambda at: there(F.col("j2"), at))
                ).alias("jump"),
            )
        )
        step *= 2
    return state.select(key, "_block", "entry")


def throttle_flags(
    events: DataFrame,
    key: str,
    ts: str,
    tie_breaker: str,
    limit: int = LIMIT,
    expiry_seconds: float = EXPIRY_SECONDS,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """``events`` with a boolean ``denied``; null without a key or a time.

    Which events begin a new count (fresh starts) settles all others. Where one leads to is
    settled within ``(limit + 1) * expiry``: without a pause its ``limit``-th event and the
    first after that one's expiry come by then. So time is cut into blocks of at least
    ``bucket_seconds``, a multiple of that stretch, and a block also gets the stretch behind
    its end. Blocks of a key go to different tasks; each finds all links at once, follows
    them by pointer doubling, and says where it leads for any way it can be entered. That
    is carried over the blocks of a key by doubling as well, and each block then judges the
    events its fresh starts govern, every event once. A key that never pauses is spread like
    any other; a task holds one block of a key. Equal times go by ``tie_breaker``, then by
    the row's hash.
    """
    expiry = int(expiry_seconds * 1_000_000)
    halo = (limit + 1) * expiry
    block = max(bucket_seconds * 1_000_000, BLOCK_HALOS * halo, 1)
    judged = F.col(key).isNotNull() & F.col(ts).isNotNull()
    undecided = events.where(~judged).withColumn("denied", F.lit(None).cast("boolean"))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    keyed = events.where(judged).withColumns({"_us": us, "_row": F.xxhash64(*events.columns)})
    keyed = keyed.withColumn("_at", F.floor(F.col("_us") / F.lit(block)).cast("long"))
    offset = F.col("_us") - F.col("_at") * F.lit(block)
    blocks = F.array(
        F.col("_at"),
        F.when(offset < halo, F.col("_at") - 1),
        F.when(offset >= block - expiry, F.col("_at") + 1),
    )
    order = [key, "_block", "_us", tie_breaker, "_row"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_block", F.explode(F.array_compact(blocks)))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_blocks(batches, key):
            b = _Blocks(table, key, limit, expiry, block)
            exits = b.exits()
            has = np.zeros(len(b.first), bool)
            has[b.group[b.own]] = True
            settled = np.full(len(b.first), -2)
            settled[b.group[b.roots]] = exits[b.roots]  # the last root of a block counts
            open_ = has & (settled == -2)
            early = b.own & (b.offset < halo) & open_[b.group]
            sizes = np.bincount(b.group[early], minlength=len(b.first))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(~open_, False))
            jump = pa.ListArray.from_arrays(offsets, pa.array(exits[early].astype(np.int32)))
            rows = pa.array(b.first)
            out = pa.table(
                {
                    key: table.column(key).take(rows),
                    "_block": table.column("_block").take(rows),
                    "exit": pa.array(settled.astype(np.int32), mask=settled == -2),
                    "jump": jump,
                }
            ).filter(pa.array(has))
            yield from out.combine_chunks().to_batches()

    types, columns = dict(events.dtypes), events.columns
    narrow = dealt(keyed.select(*dict.fromkeys([key, tie_breaker]), "_us", "_at", "_row"))
    maps = narrow.repartition(key, "_block").sortWithinPartitions(*order).mapInArrow(
        links, f"`{key}` {types[key]}, _block bigint, exit int, jump array<int>"
    )
    entries = _entries(cut_lineage(maps), key)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_blocks(batches, key):
            b = _Blocks(table, key, limit, expiry, block)
            entry = table.column("entry").to_numpy()[b.first]
            rows, denied = b.denials(entry, limit)
            out = table.select(columns).take(pa.array(rows)).append_column("denied", pa.array(denied))
            yield from out.combine_chunks().to_batches()

    routed = dealt(keyed).join(entries, [key, "_block"], "left").withColumn("entry", F.coalesce("entry", F.lit(-1)))
    schema = T.StructType([*events.schema.fields, T.StructField("denied", T.BooleanType())])
    flagged = routed.repartition(key, "_block").sortWithinPartitions(*order).mapInArrow(flag, schema)
    return flagged.unionByName(undecided)
