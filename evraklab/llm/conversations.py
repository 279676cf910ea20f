"""Conversation structure repair by Wagner-Fischer alignment to a grammar string.

The role initials of a sound conversation are ``(s?(ua)+)?``. A conversation's turns are
aligned with the prefix of each feasible length of the alternating string (``uaua...``,
``suaua...``): keep 0, rerole to user or assistant 3, delete 4 (forced for blank and
duplicate turns), insert an empty user or assistant turn 3; a truncated turn that stays
costs 3 more. Lengths are tried outwards from the number of turns that may stay. The
cheapest alignment so far (the incumbent) bounds Ukkonen's band of the next table and ends
the search; each table is traced back to its least audit (the edits' initials), and the
lengths are compared by cost, then audit.

Turns are aligned in runs of ``RUN``, from each place of the grammar to each other one, and
the runs are joined: two partial audits of equal cost never start one another, as the cost
follows from the letters, so the least whole audit is made of least partial ones. Runs
bound the tables for conversations of any length, and equal runs are aligned once.

Rows are dealt by conversation, sorted by Spark and streamed: a task holds the turns on
which the alignments still disagree, never a whole conversation. The digest of a repaired
conversation is one chain of hashes, so one task reads a conversation's rows.

Defined results: null role or text count as one space, also a null id or turn in the hash
of ``damage``; null turns come first; turns of equal number are ordered by role, then text;
null conversation ids form one conversation. Repeated rows are duplicates of the first.
Texts of any length pass whole. An empty table gives no rows; a conversation without turns
gives one row without an edit. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = 16
WHITE = "\x20\t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
INFINITE = 1 << 60

#: Places in the grammar: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
PLACE = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
FINAL = (START, AFTER_A)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) after the stated damage.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (``present`` false), 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4
    makes it the user's. Nulls count as one space.
    """
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(
        F.col("fate") == 2, F.regexp_replace(known("text"), "[.!?]", "")
    )
    return conversations.select("conv_id", "turn", "role", "text", fate.alias("fate")).select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(known("role")).alias("role"),
        text.otherwise(known("text")).alias("text"),
        (F.col("fate") != 0).alias("present"),
        F.explode(F.sequence(F.lit(0), (F.col("fate") == 3).cast("int"))).alias("copy"),
    ).drop("copy")


def _bound(deletions: int, cheap: int) -> int:
    """What ``deletions`` cost at least beyond keeping, if ``cheap`` of the turns are truncated."""
    return deletions + 3 * max(0, deletions - cheap)


def _target(place: int, length: int) -> list[str]:
    """The grammar's strings of ``length`` from ``place`` on."""
    first = "au" if place == AFTER_U else "ua"
    plain = (first * (length // 2 + 1))[:length]
    return [plain, ("s" + plain)[:length]] if place == START and length else [plain]


def _table(codes: str, target: str, limit: int) -> tuple[int, str] | None:
    """Cost and least audit of aligning ``codes`` with ``target``, None above ``limit``.

    ``codes`` has a letter a turn: the role's initial (x: none of s, u, a), upper case if
    truncated, ``-`` if it has to go. Cells outside the band cannot lie on an alignment
    within ``limit``.
    """
    n, size = len(codes), len(target)
    stay = [0]
    for code in codes:
        stay.append(stay[-1] + (code != "-"))
    m = stay[n]
    least = 4 * (n - m) + 3 * sum(code.isupper() for code in codes)
    rows: list[list[int]] = [[]] * (n + 1)
    below = None
    for i in range(n, -1, -1):
        row = [INFINITE] * (size + 2)
        code = codes[i] if i < n else "-"
        late = 3 if code.isupper() else 0
        initial = code.lower()
        for j in range(size, -1, -1):
            ahead, rest = j - stay[i], (size - j) - (m - stay[i])
            if least + max(3 * ahead, -ahead) + max(3 * rest, -rest) > limit:
                continue
            best = 0 if i == n and j == size else INFINITE
            wanted = target[j] if j < size else ""
            if below is not None:
                best = min(best, below[j] + 4)
                if wanted and code != "-":
                    if initial == wanted:
                        best = min(best, below[j + 1] + late)
                    elif wanted != "s":
                        best = min(best, below[j + 1] + late + 3)
            if wanted and wanted != "s":
                best = min(best, row[j + 1] + 3)
            row[j] = best
        rows[i] = below = row
    cost = rows[0][0]
    if cost > limit or cost >= INFINITE:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < size:
        here, code = rows[i][j], codes[i] if i < n else "-"
        late, wanted = 3 if code.isupper() else 0, target[j] if j < size else ""
        if i < n and rows[i + 1][j] + 4 == here:
            audit.append("D")
            i += 1
        elif wanted in ROLES and rows[i][j + 1] + 3 == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if code.lower() == wanted else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


@lru_cache(maxsize=1 << 16)
def align(place: int, codes: str, last: bool) -> dict[int, tuple[int, str]]:
    """For every place the grammar can be left at: cost and least audit of ``codes`` from ``place`` on.

    ``last``: only places where the grammar may end.
    """
    m = len(codes) - codes.count("-")
    cheap = sum(code.isupper() for code in codes)
    least = 4 * (len(codes) - m) + 3 * cheap
    found: dict[int, tuple[int, str]] = {}
    many = [p for p in (AFTER_U, AFTER_A) if not last or p in FINAL]
    short = {0: place, 1: AFTER_S}  # lengths that alone end elsewhere
    away = 0
    while True:
        low = least + min(3 * away, _bound(away, cheap))
        if all(p in found and found[p][0] < low for p in many) and m - away < 0:
            break
        for length in {m - away, m + away}:
            if length < 0:
                continue
            bound = least + (3 * (length - m) if length > m else _bound(m - length, cheap))
            for target in _target(place, length):
                end = PLACE[target[-1]] if target else short[0]
                if last and end not in FINAL:
                    continue
                limit = found.get(end, (INFINITE - 1,))[0]
                if bound > limit:
                    continue
                new = _table(codes, target, limit)
                if new is not None and (end not in found or new < found[end]):
                    found[end] = new
        away += 1
    return found


class _Stream:
    """The alignments of one conversation that may still be the cheapest.

    ``paths``: by place, cost and the audit after what all paths share; the shared edits are
    given out at once, so only turns on which the paths disagree are kept.
    """

    def __init__(self) -> None:
        self.paths = {START: (0, "")}
        self.place = START
        self.turns: list[tuple] = []  # turns not given out
        self.codes: list[str] = []  # of the run being filled
        self.seen = 0

    def add(self, turn: tuple, code: str) -> list[tuple]:
        out = self.close(False) if len(self.codes) == RUN else []
        self.turns.append(turn)
        self.codes.append(code)
        return out

    def close(self, last: bool) -> list[tuple]:
        paths: dict[int, tuple[int, str]] = {}
        codes = "".join(self.codes)
        self.codes = []
        for place, (cost, audit) in self.paths.items():
            for end, (more, letters) in align(place, codes, last).items():
                new = (cost + more, audit + letters)
                if end not in paths or new < paths[end]:
                    paths[end] = new
        if last:
            return self.give(min(paths.values())[1])
        # After a, all goes on as from the start but for s, which deleting replaces at 4,
        # and as after s: dearer paths can no longer win.
        done = paths[AFTER_A][0]
        for place, more in ((START, 4), (AFTER_S, 0)):
            if place in paths and paths[place][0] > done + more:
                del paths[place]
        shared = os.path.commonprefix([audit for _, audit in paths.values()])
        self.paths = {place: (cost, audit[len(shared) :]) for place, (cost, audit) in paths.items()}
        return self.give(shared)

    def give(self, letters: str) -> list[tuple]:
        """The next edits as rows (turn, edit, fault, was, role, text)."""
        out, taken = [], 0
        for letter in letters:
            turn, fault, was, text = (None, None, None, "") if letter == "I" else self.turns[taken]
            taken += letter != "I"
            if letter == "D":
                out.append((turn, "D", fault, was, None, None))
                continue
            if letter == "K" and self.place == START and was[:1] == "s":
                wanted = "s"
            else:
                wanted = "a" if self.place == AFTER_U else "u"
            self.place = PLACE[wanted]
            out.append((turn, letter, fault, was, was if letter == "K" else ROLES[wanted], text))
        del self.turns[:taken]
        return out


def _fault(text: str, repeated: bool) -> str | None:
    end = text.rstrip(WHITE)
    if not end:
        return "blank"
    if repeated:
        return "duplicate"
    return None if end[-1] in ".!?" else "truncated"


def _code(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "-"
    initial = role[:1] if role[:1] in PLACE else "x"
    return initial.upper() if fault else initial


def edits(turns: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: what was done to which turn, and what stands.

    ``turns``: conv_id, turn, role, text, and optionally ``present`` (false: the row only
    names its conversation). Rows (conv_id, turn, edit K/R/D/I, fault, was, role, text):
    ``was`` is the role before, role and text are null for deleted turns. A partition holds
    whole conversations, each in order; without turns there is one row with a null edit.
    """
    one = F.lit(" ")
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", one).alias("role"),
        F.coalesce("text", one).alias("text"),
        F.coalesce(present, F.lit(True)).alias("present"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("repeated", F.row_number().over(same) > 1).sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text", "repeated"
    )
    kinds = dict(turns.dtypes)
    schema = (
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, edit string, fault string,"
        " was string, role string, text string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, stream, types = None, None, None
        out: list[tuple] = []

        def end() -> None:
            given = stream.close(True)
            out.extend((conv, *row) for row in given)
            if not given and not stream.seen:
                out.append((conv, *[None] * 6))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["conv_id", "turn", "edit", "fault", "was", "role", "text"],
            )

        for batch in batches:
            fields = batch.schema
            types = [fields.field("conv_id").type, fields.field("turn").type, *[pa.string()] * 5]
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "repeated"))
            for here, turn, role, text, there, repeated in zip(*columns, strict=True):
                if stream is None or here != conv:
                    if stream is not None:
                        end()
                    conv, stream = here, _Stream()
                if there:
                    fault = _fault(text, repeated)
                    stream.seen += 1
                    out.extend((conv, *row) for row in stream.add((turn, fault, role, text), _code(role, fault)))
            if out:
                yield flush()
        if stream is not None:
            end()
            if out:
                yield flush()

    return rows.mapInArrow(run, schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = {"su", "ua", "au"}
PRICE = {"D": 4, "I": 3, "K": 0, "R": 3}


class _Report:
    """Counts, audit and digest of one conversation, edit by edit."""

    def __init__(self) -> None:
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.initial = None
        self.turns = 0
        self.audit = bytearray()
        self.digest = hashlib.sha256()
        self.lines = 0

    def add(self, turn, edit: str, fault: str | None, was: str | None, role: str | None, text: str | None) -> None:
        self.audit += edit.encode()
        self.count["cost"] += PRICE[edit] + (3 if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.count[fault] += 1
        if edit != "I":
            initial = was[:1]
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.count["illegal"] += 1
            self.initial = initial
            if turn is not None:
                self.turns += turn != self.high  # turns ascend
                self.low = turn if self.low is None else self.low
                self.high = turn
        if edit != "D":
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        if self.low is not None:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        return (*self.count.values(), self.audit.decode(), self.digest.hexdigest())


def report(edited: DataFrame) -> DataFrame:
    """One row a conversation from the rows of ``edits``, as they lie in their partitions.

    gaps between turn numbers, faults, adjacent role initials other than su, ua and au,
    the cost, the audit and the sha256 of the repaired ``role:text`` lines.
    """
    kind = dict(edited.dtypes)["conv_id"]
    numbers = ", ".join(f"{c} bigint" for c in COUNTS)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, current, types = None, None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if current is None or row[0] != conv:
                    if current is not None:
                        out.append((conv, *current.row()))
                    conv, current = row[0], _Report()
                if row[2] is not None:
                    current.add(*row[1:])
            if out:
                yield flush()
        if current is not None:
            out.append((conv, *current.row()))
            yield flush()

    return edited.mapInArrow(run, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string")
