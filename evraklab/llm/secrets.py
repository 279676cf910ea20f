"""Secret scan: fixed patterns, and guess costs of values in a credential context.

A value that stands after a credential word may be a weak password, a placeholder or
a secret. It is judged by how many guesses an attacker who knows words, dates,
repeats and keyboard walks would need: the cheapest way to cut the value into such
spans, found by dynamic programming (log10 guesses of the spans, plus log10 of n!
for the order of n spans). At or above ``min_guesses`` the value is a secret.

A value is judged whole, whatever its length, also where a base pattern covers a part.

Null texts count as empty and give no spans; null or repeated ids are kept row by row.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evraklab.llm.core import map_batches

# The base patterns with their least lengths, in the order of the kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "guess")

# Words that announce a credential; the value follows a separator.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"""
    r"""|credentials?|auth(?:orization)?)["']?\x20*(?::|=>|=)\x20*["']?(?:bearer\x20+)?([^\s"'<>,;]{8,})""",
    re.ASCII | re.IGNORECASE,
)
BASE_HINTS = ("passw", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = BASE_HINTS + ("pass", "pwd", "key", "credential", "auth")

# Common parts of passwords and placeholders, by rank.
WORDS = (
    "password pass the and you love admin user login welcome hello monkey dragon master secret "
    "token key api test example sample demo changeme change your here value string none null true "
    "false default dummy placeholder foo bar baz qwerty letmein princess sunshine football baseball "
    "shadow summer winter spring autumn january february march april may june july august september "
    "october november december monday tuesday wednesday thursday friday saturday sunday data base "
    "server client service system root guest public private access code auth env config prod dev "
    "local host my is not for with this that from file path name get set new old"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
LEET = str.maketrans("4301$5@7", "aeoissat")
MIN_GUESSES = 10.0
MOST = 12  # spans of a value: log10 of 13! and of 13 words is above MIN_GUESSES


def _near() -> dict[str, set[str]]:
    at = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {
        c: {d for d, (s, j) in at.items() if d != c and abs(r - s) <= 1 and -1 <= j - i + (s - r) <= 1}
        for c, (r, i) in at.items()
    }


NEAR = _near()


def _alphabet(text: str) -> int:
    size = 26 * any("a" <= c <= "z" for c in text) + 26 * any("A" <= c <= "Z" for c in text)
    size += 10 * any(c.isdigit() for c in text)
    return max(10, size + 33 * any(not c.isalnum() for c in text))


def _runs(same: list[bool]) -> list[int]:
    """How many of ``same`` follow on each other from each position."""
    out = [0] * (len(same) + 1)
    for i in range(len(same) - 1, -1, -1):
        out[i] = out[i + 1] + 1 if same[i] else 0
    return out


class _Starts:
    """Starts of a span that grows: the least of ``base + log10(end - start)``, for growing ends.

    An older start that is once as cheap as a newer one stays so, as its logarithm grows less.
    So the starts that can still win form a stack, each with the end from which the one
    below is as cheap again.
    """

    def __init__(self):
        self.stack: list[tuple[int, float, float]] = []

    def add(self, start: int, base: float, end: int) -> None:
        """A newer start, whose first span is up to ``end``."""
        if self.least(end) <= base + math.log10(end - start):
            return
        stack = self.stack
        until = math.inf
        while stack:
            older, cost, passed = stack[-1]
            # As cheap again where (end - older) / (end - start) has fallen to 10 ** (base - cost).
            gain = math.expm1((base - cost) * math.log(10)) if base > cost else 0.0
            until = start + (start - older) / gain if gain > 0 else math.inf
            if until < passed or passed == math.inf:
                break
            stack.pop()
        stack.append((start, base, until))

    def least(self, end: int) -> float:
        stack = self.stack
        while stack and stack[-1][2] <= end:
            stack.pop()
        return stack[-1][1] + math.log10(end - stack[-1][0]) if stack else math.inf


def guess_cost(value: str) -> float:
    """log10 of the guesses for ``value``: the cheapest segmentation into known spans.

    Every length of every span is tried, whatever the value's length.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.translate(SHIFTED).lower()
    plain = value.lower()
    leet = plain.translate(LEET)
    per_char = math.log10(_alphabet(value))
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    # Runs that spans are cut from: agreeing neighbours from each place, the step and the
    # least length of a span, and its cost but for log10 of its length.
    runs = [
        (_runs([value[i] == value[i + unit] for i in range(n - unit)]), unit, max(3, 2 * unit), unit * per_char - math.log10(unit))
        for unit in range(1, 5)  # a unit of 1 to 4 characters, repeated
    ]
    walks = _runs([low[i + 1] in NEAR.get(low[i], ()) for i in range(n - 1)])
    ups = _runs([ord(value[i + 1]) - ord(value[i]) == 1 for i in range(n - 1)])
    downs = _runs([ord(value[i + 1]) - ord(value[i]) == -1 for i in range(n - 1)])
    runs.append((walks, 1, 3, math.log10(47 * 4)))  # keyboard walks
    runs += [(ups, 1, 3, math.log10(36 * 2)), (downs, 1, 3, math.log10(36 * 2))]  # runs such as abc or 987

    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            rank = RANK.get(plain[i:j]) or RANK.get(leet[i:j])
            if rank:
                case = 0.3 * sum(c.isupper() for c in value[i:j])
                swap = 0.3 * (plain[i:j] != leet[i:j] and plain[i:j] not in RANK)
                spans[j].append((i, math.log10(rank + 1) + case + swap))
        for pattern, cost in DATES:
            if m := pattern.match(value, i):
                spans[m.end()].append((i, cost))
    # Least cost of the first j characters cut into k spans: over all cuts, and over
    # those whose last span is brute force and can grow by a character. Above ``MOST`` spans
    # the order alone costs more than ``MIN_GUESSES`` leaves.
    best = [[0.0] + [math.inf] * MOST]
    brute = [math.inf] * (MOST + 1)
    # Of the latest run of each kind and place within the step: its end, and its starts by k.
    latest: list[list[tuple[int, list[_Starts]]]] = [[(-step, [])] * step for _, step, _, _ in runs]
    for j in range(1, n + 1):
        before = best[j - 1]
        brute = [math.inf] + [min(brute[k], before[k - 1]) + per_char for k in range(1, MOST + 1)]
        row = list(brute)
        for i, cost in spans[j]:
            for k in range(MOST):
                row[k + 1] = min(row[k + 1], best[i][k] + cost)
        for (agree, step, least, cost), held in zip(runs, latest):
            i, at = j - least, j % step
            if i >= 0 and i < len(agree) and agree[i] and agree[i] + step >= least:
                if held[at][0] != i + agree[i]:
                    held[at] = (i + agree[i], [_Starts() for _ in range(MOST)])
                for k, starts in enumerate(held[at][1]):
                    if best[i][k] < math.inf:
                        starts.add(i, best[i][k] + cost, j)
            if j <= held[at][0] + step:
                for k, starts in enumerate(held[at][1]):
                    row[k + 1] = min(row[k + 1], starts.least(j))
        best.append(row)
    return min(c + math.log10(math.factorial(k)) for k, c in enumerate(best[n]) if c < math.inf)


DATES = (
    (re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"), math.log10(365 * 130)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"), math.log10(365 * 130)),
    (re.compile(r"(?:19|20)\d\d"), math.log10(130)),
)


def spans_of(text: str, min_guesses: float = MIN_GUESSES) -> list[tuple[str, int, int]]:
    """Secrets of one text as (kind, start, end), in code points, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in BASE_HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_CHARS:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        base = sorted(found)
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            at = start  # how far the base spans cover the value without a gap
            for s, _, e in base:
                if s <= at:
                    at = max(at, e)
            if at >= end:
                continue
            if guess_cost(m.group(1)) >= min_guesses:
                found.append((start, 3, end))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """One row per document: its id and the array ``spans`` of (kind, start, end).

    An offset pair counts code points and excludes its end. Other columns of ``docs``
    are not read.
    """
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ("kind", "start", "end")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [dict(zip(names, s)) for s in spans_of(t or "", min_guesses)]
            for t in batch.column(1).to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], ["id", "spans"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = map_batches(slim, run, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; nothing else changes.

    For an assignment only its value goes. Overlapping spans are replaced once. A null
    text stays null; all rows and columns stay.
    """

    def clean(text: str) -> str:
        spans = []
        for kind, start, end in spans_of(text, min_guesses):
            if kind == "assign":
                start = ASSIGN.match(text, start).start(2)
            spans.append((start, end))
        out, at = [], 0
        for start, end in sorted(spans):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:]

    position = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else clean(t) for t in batch.column(position).to_pylist()]
        columns = [batch.column(i) for i in range(batch.num_columns)]
        columns[position] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(docs, run, docs.schema)
