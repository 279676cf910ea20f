import random

from pyspark.sql import functions as F

from conftest import rows
from evraklab.functions.fuzzy import contains_exactly, may_reach, partial_ratio, partial_scores
from evraklab.operators.doc_text import CHUNK_LINES, document_texts
from evraklab.operators.evidence import evidence_for
from evraklab.operators.proximity import nearest_numbers


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(a, b):
    """Best window of the longer string by its definition, all windows tried."""
    if not a or not b:
        return 100.0 if a == b else 0.0

    def one(short, long):
        m, best = len(short), 0.0
        for start in range(-m + 1, len(long)):
            window = long[max(start, 0) : start + m]
            if window:
                best = max(best, 200.0 * lcs(short, window) / (m + len(window)))
        return best

    if len(a) == len(b):
        return float(round(max(one(a, b), one(b, a))))
    return float(round(one(*sorted((a, b), key=len))))


def samples(n, seed=7):
    rnd = random.Random(seed)
    words = ["TOPLAM", "MASRAF", "2,25", "DEKONT NO", "ÜCRET", "250.0", "HAVALE"]
    out = []
    for _ in range(n):
        a = "".join(rnd.choice("ABC12 ,") for _ in range(rnd.randint(0, 12)))
        b = "".join(rnd.choice("ABC12 ,") for _ in range(rnd.randint(0, 30)))
        out.append((a, b))
        out.append((rnd.choice(words), rnd.choice(words) + " " + b))
    long = "".join(rnd.choice("ABCDEF ") for _ in range(150))
    noisy = "".join(c if rnd.random() > 0.1 else "Z" for c in long[20:110])
    out += [(noisy, long), (long[3:140], noisy), (long[:64], long), (long[:65] + "Q", long)]
    return out


def test_scores_match_brute_force():
    pairs = samples(150)
    got = partial_scores([a for a, _ in pairs], [b for _, b in pairs])
    assert [float(x) for x in got] == [brute(a, b) for a, b in pairs]


def test_prefilter_never_drops_a_pair(spark):
    pairs = samples(150, seed=11)
    df = spark.createDataFrame(pairs, "a string, b string")
    for score in (80, 85):
        kept = rows(df.select("a", "b", may_reach(F.col("a"), F.col("b"), score)))
        for a, b, ok in kept:
            assert ok or brute(a, b) <= score, (a, b)


def test_udf_and_exact(spark):
    df = spark.createDataFrame([("ABC", "xABCx"), ("ABD", "xABCx"), (None, "a"), ("", "a")], "a string, b string")
    got = rows(df.select(partial_ratio(F.col("a"), F.col("b")), contains_exactly(F.col("a"), F.col("b"))))
    assert got == [(100.0, True), (67.0, False), (None, None), (0.0, False)]


def lines_df(spark, docs):
    data = [(d, i, 1, t, 1.0, None, "raw") for d, ts in docs.items() for i, t in enumerate(ts, 1)]
    return spark.createDataFrame(
        data,
        "doc_id long, line_no int, page int, text string, confidence double, "
        "bbox array<array<double>>, method string",
    )


def best_line(target, texts):
    best, score = None, 80
    for t in texts:
        s = brute(target.upper(), t.upper())
        if s > score:
            best, score = t, s
    return best


def test_evidence_matches_brute_force_and_spans_runs(spark):
    big = [f"satir {i:05d}" for i in range(1, CHUNK_LINES * 2 + 50)]
    big[CHUNK_LINES + 7] = "Gonderen: Ahmet Yilmaz"
    big[CHUNK_LINES * 2 + 3] = "AHMET YILMAZ tekrar"
    docs = {
        1: ["Toplam Masraf: 2,25", "Alıcı: Ayşe Demir", "tutar 250.0 TL", "tutar 250.0"],
        2: big,
        3: ["kisa"],
    }
    wanted = {(1, 0): "Ayse Demir", (1, 1): "250.0", (1, 2): "hiç yok", (2, 0): "Ahmet Yilmaz",
              (2, 1): "Ahmet Yilmas", (3, 0): "bu satir kisa mi"}
    values = spark.createDataFrame([(d, s, v) for (d, s), v in wanted.items()], "doc_id long, slot int, value string")
    got = {(r["doc_id"], r["slot"]): r["evidence_text"] for r in evidence_for(lines_df(spark, docs), values).collect()}
    expected = {}
    for (d, s), v in wanted.items():
        hit = best_line(v, docs[d] if d != 2 else [t for t in big if "ahmet" in t.lower()])
        if hit is not None:
            expected[(d, s)] = hit
    assert got == expected


def test_text_of_a_document_in_several_runs(spark):
    n = CHUNK_LINES * 3 + 5
    docs = {1: [f"l{i}" for i in range(n)], 2: ["a", "", "b"]}
    got = {r["doc_id"]: r["raw_text"] for r in document_texts(lines_df(spark, docs).repartition(7)).collect()}
    assert got == {1: " ".join(docs[1]), 2: "a  b"}


def box(x0, y0, x1, y1):
    return [[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)]]


def test_proximity(spark):
    data = [
        (1, 1, "Toplam Masraf:", box(10, 100, 150, 120)),
        (1, 2, "2,25", box(160, 100, 220, 120)),
        (1, 3, "9,99", box(170, 100, 220, 120)),
        (2, 1, "Tutar", box(10, 10, 50, 30)),
        (2, 2, "7", box(20, 60, 40, 80)),
        (2, 3, "8", box(500, 10, 520, 30)),
        (3, 1, "Toplam Masrat", box(10, 100, 150, 120)),
        (3, 2, "3,50", box(160, 100, 220, 120)),
        (4, 1, "Toplam Masraf", box(10, 100, 150, 120)),
        (4, 2, "yok", box(160, 100, 220, 120)),
    ]
    lines = spark.createDataFrame(data, "doc_id long, line_no int, text string, bbox array<array<double>>")
    got = rows(nearest_numbers(lines, ["Toplam Masraf", "Tutar"]).select("doc_id", "keyword_no", "text", "distance", "side"), "doc_id")
    assert got == [(1, 0, "2,25", 10.0, "right"), (2, 1, "7", 30.0, "below"), (3, 0, "3,50", 10.0, "right")]
