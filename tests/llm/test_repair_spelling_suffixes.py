"""Conversation repair, spelling variants and suffix deduplication against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evraklab.llm import conversations, queries, spelling, suffix_dedup
from evraklab.llm.suffix_sort import common_prefixes, repeated_starts, suffixes, words_at

GRAMMAR = re.compile(r"(s?(ua)+)?$")
ROLE = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}


def cheapest(codes):
    """Least (cost, audit) over all sequences of edits."""
    best = (4 * len(codes), "D" * len(codes))

    def search(i, cost, audit, roles, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes) and GRAMMAR.match(roles):
            best = min(best, (cost, audit))
        if inserted < len(codes) + 3:
            for role in "ua":
                search(i, cost + 3, audit + "I", roles + role, inserted + 1)
        if i < len(codes):
            search(i + 1, cost + 4, audit + "D", roles, inserted)
            code = codes[i]
            if code != "-":
                late = 3 if code.isupper() else 0
                search(i + 1, cost + late, audit + "K", roles + code.lower(), inserted)
                for role in "ua":
                    if role != code.lower():
                        search(i + 1, cost + 3 + late, audit + "R", roles + role, inserted)

    search(0, 0, "", "", 0)
    return best


@pytest.mark.parametrize("run", [2, 3, 16])
def test_alignment_finds_the_least_audit(monkeypatch, run):
    monkeypatch.setattr(conversations, "RUN", run)
    rng = random.Random(run)
    for _ in range(120):
        codes = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randint(0, 5)))
        stream, rows = conversations._Stream(), []
        for i, code in enumerate(codes):
            rows += stream.add((i, None, ROLE[code.lower()], "t"), code)
        rows += stream.close(True)
        cost, audit = cheapest(codes)
        assert "".join(r[1] for r in rows) == audit, codes
        kept = "".join(r[4][0] for r in rows if r[1] != "D")
        assert GRAMMAR.match(kept)


def conversation_rows():
    rng = random.Random(5)
    texts = ["Hi there.", "Well", "Yes!", " \t\n", "", "Ça va ?", None, "A. B! C?", "Hi there.", "x" * 50_000 + "."]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return [*rows, *rows[:3], (777, None, None, None)]


def expected_report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        known = lambda x: " " if x is None else x
        damaged = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = known(role), known(text)
            h = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            damaged += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in damaged:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        codes = "".join(
            "-" if f in ("blank", "duplicate") else (r[:1] if r[:1] in ("s", "u", "a") else "x").swapcase() if f else (r[:1] if r[:1] in ("s", "u", "a") else "x")
            for (_, r, _), f in zip(damaged, faults, strict=True)
        )
        cost, audit = cheapest(codes)
        lines, place, k = [], "", 0
        for e in audit:
            if e == "D":
                k += 1
                continue
            role, text = (None, "") if e == "I" else damaged[k][1:]
            k += e != "I"
            if e != "K":
                role = "assistant" if place == "u" else "user"
            place = "s" if e == "K" and not place and role[:1] == "s" else "a" if place == "u" else "u"
            lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in damaged if t is not None]
        initials = [r[:1] for _, r, _ in damaged]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_conversation_query_with_nulls_ties_repeats_and_other_columns(spark, tmp_path):
    rows = conversation_rows()
    folder = written(
        spark, tmp_path, "conversations", [(*r, 1, "x") for r in rows],
        "conv_id long, turn long, role string, text string, fate int, present string",
    )
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversations(spark, folder).collect()}
    assert got == expected_report(rows)


def test_conversation_edits_are_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Ho."), (2, 0, "assistant", "")]
    edits = conversations.edits(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = sorted((r.conv_id, r.edit, r.fault, r.role, r.text) for r in edits.collect() if r.conv_id == 1)
    assert got == [(1, "K", None, "user", "Hi."), (1, "R", None, "assistant", "Ho.")]
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conversations.report(conversations.edits(conversations.damage(empty))).collect() == []


def expected_words(rows, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=(0, None))
        form[w] = best[1] if -best[0] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    stems = ["Étoile", "garden", "gardens", "abcabc", "aaaaaaa", "STRASSE", "naïveté", "x×y÷zé", "longer" * 40]
    alphabet = "abgéÀ×"

    def word():
        w = rng.choice(stems)
        if rng.random() < 0.25:
            i, c = rng.randrange(len(w)), rng.choice(alphabet)
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        return w

    rows = [(rng.choice([i, i, None]), rng.choice([" ", "1", "-"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(5, None), (6, ""), *rows[:20], (7, "garden " * 20_000)]
    folder = written(spark, tmp_path, "documents", [(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in queries.op12_spelling(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_words(rows)
    assert any(r[1] for r in got) and any(r[1] != r[2] for r in got if r[1])


def test_spelling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(spelling.count(spelling.garble(spelling.runs(empty)))).collect() == []


def expected_cut(rows, length):
    texts = [(text or "").encode() for _, text in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), text in zip(rows, texts, strict=True):
        gone = np.zeros(len(text) + 2, bool)
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(text, gone[1:], strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def suffix_rows(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["ab", "c", "éa", "x", "yy", "\x00foo"]) for _ in range(n))
    shared = some(40)
    make = [
        lambda: "a" * rng.randint(0, 90),
        lambda: "ab" * rng.randint(0, 40),
        lambda: None,
        lambda: "",
        lambda: some(rng.randint(0, 60)),
        lambda: some(10) + shared + some(10),
        lambda: shared[rng.randint(0, 20) :],
    ]
    rows = [(i, rng.choice(make)()) for i in range(60)]
    return [*rows, (None, "a text that stands twice in here"), (None, "a text that stands twice in here"), (61, some(3000))]


@pytest.mark.parametrize(("seed", "crowd", "block"), [(1, 4096, 1 << 20), (2, 4096, 300), (3, 1, 300)])
def test_suffix_dedup_against_brute_force(spark, seed, crowd, block):
    rows = suffix_rows(seed)
    schema = "doc_id long, text string, first string, anchor int, bytes int"
    docs = spark.createDataFrame([(*r, "f", 1, 2) for r in rows], schema)
    options = {"length": 24, "gram": 8, "block": block, "crowd": crowd}
    got = sorted((tuple(r) for r in suffix_dedup.digest(docs, **options).collect()), key=str)
    assert got == expected_cut(rows, 24)
    cut = suffix_dedup.remove(docs, **options).collect()
    again = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in cut]
    assert sorted(again, key=str) == got


def test_suffix_query_long_texts_in_pieces_and_empty_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    rows = [(1, text), (2, text[5000:9000] + "é" + text[100:400]), (3, "z" * 5000), (4, "unlike all")]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in queries.op13_suffixes(spark, folder).collect()), key=str)
    assert got == expected_cut(rows, 200)
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_two_stage_sort_orders_all_suffixes():
    rng = random.Random(6)
    for _ in range(100):
        depth = rng.choice([3, 8, 9, 20])
        strings = [bytes(rng.choice(b"aab\xc3") for _ in range(rng.randint(depth, 50))) for _ in range(rng.randint(1, 6))]
        raw = b"\xff" + b"\xff".join(strings) + b"\xff" * (depth + 9)
        text = np.frombuffer(raw, np.uint8)
        words = words_at(text)
        order = suffixes(text, words, text != 0xFF, depth)
        keys = [raw[i : i + depth] for i in order]
        assert len(order) == (text != 0xFF).sum() and keys == sorted(keys)
        shared = common_prefixes(words, order, depth)
        for a, b, n in zip(keys, keys[1:], shared[1:], strict=False):
            assert n == next((k for k in range(depth) if a[k] != b[k]), depth)
    assert repeated_starts([], np.array([], int), np.array([], int), 5) == []
