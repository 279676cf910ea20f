import json
import random

from pyspark.sql import functions as F

from evraklab.functions.amounts import clean_amount, parse_amount
from evraklab.functions.json_text import canonical_json, cut_json
from evraklab.functions.lang import float_text
from evraklab.functions.patterns import (
    all_ibans,
    first_date,
    first_iban,
    has_digit,
    is_iban_format,
    reference_number,
)
from evraklab.functions.pii import mask, unmask

IBAN_A = "TR120001000200030004000500"
IBAN_B = "TR990001000200030004000511"


def test_amounts(values):
    cases = {
        None: ("", 0.0),
        "": ("", 0.0),
        "1.250": ("1.250", 1.25),
        "1.250,50": ("1.250,50", 1250.5),
        "1,250.50": ("1,250.50", 1250.5),
        "1.234.567": ("1.234.567", 0.0),
        "1,2,3": ("1,2,3", 0.0),
        "-250,00 TL": ("250,00", 250.0),
        "- 250,00 TL": ("250,00", 250.0),
        "1S0.B0": ("10.80", 10.8),
        "140,00": ("140,00", 140.0),
        "Ara Toplam: 220,50": ("401220,50", 401220.5),
        "E 12 , 50": ("12,50", 12.5),
        "5.": ("5.", 5.0),
        ".5": (".5", 0.5),
        ".": (".", 0.0),
        "TTLL9": ("19", 19.0),
        "7€": ("76", 76.0),
        "1.2.3,4": ("1.2.3,4", 0.0),
        "$~ 3": ("3", 3.0),
    }
    assert values(clean_amount, list(cases)) == [c for c, _ in cases.values()]
    assert values(parse_amount, list(cases)) == [a for _, a in cases.values()]


def test_float_text_is_shortest_form(values):
    numbers = [0.0, 250.0, 0.1, 1e7, 12345678.5, 123456789012345.0, 1e16, 1.5e17, 1e-4, 0.00025, 1e-5, 2.5e-7, -3.25, 99999999.01]
    assert values(float_text, numbers, "double") == [str(n) for n in numbers]


def test_iban_scans(values):
    texts = [
        f"x {IBAN_A} y {IBAN_B} z {IBAN_A}",
        f"{IBAN_A} 123456 tail",  # the greedy tail over-consumes and the number is lost
        "TR12 0001 0002 0003 0004 0005 00. rest",
        "no number here",
    ]
    assert values(lambda x: F.array_join(all_ibans(x), "|"), texts) == [
        f"{IBAN_A}|{IBAN_B}", "", IBAN_A, "",
    ]
    assert values(first_iban, texts) == [IBAN_A, None, IBAN_A, None]


def test_dates_and_references(values):
    texts = ["on 22.08.2018 and 01/02/2019", "1/2/2019", "05/11/2020"]
    assert values(first_date, texts) == ["2018-08-22", None, "2020-11-05"]
    texts = [
        "Ref No: 987654321",
        "ref: 123456 sonra",
        "dekont no 654321 işlem no: 111222333",
        "İŞLEM NO : : 1234567",
        "REF 12345",
        "fıs no 0000001",
    ]
    assert values(reference_number, texts) == [None, "123456", "111222333", "1234567", None, "0000001"]


def test_predicates(values):
    assert values(has_digit, ["a1", "abc", "٣"]) == [True, False, True]
    assert values(is_iban_format, [IBAN_A, "TR12 0001 0002 0003 0004 0005 00", "TR12"]) == [True, True, False]


def test_cut_json(values):
    texts = [
        'x ```json\n {"a": 1} \n``` y {"b": 2}',
        'Here: {"a": {"b": 1}} done',
        "} nothing {",
        "  plain  ",
        "```json ```",
        "{ open only",
    ]
    assert values(cut_json, texts) == ['{"a": 1}', '{"a": {"b": 1}}', "", "plain", "", "{ open only"]


def test_mask_and_unmask(spark):
    text = f"TC 12345678902, {IBAN_A} tel 0532 123 45 67 ve +90 532 123 45 67; yine 12345678902 ve 98765432100"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").withColumn("m", mask(F.col("t")))
    got = df.select("m.text", "m.entries", unmask(F.col("m.text"), F.col("m.entries")).alias("back")).collect()
    first = got[0]
    assert first["back"] == text
    names = [e["placeholder"] for e in first["entries"]]
    assert names == ["[TC_KIMLIK_0]", "[TC_KIMLIK_1]", "[IBAN_0]", "[PHONE_0]", "[PHONE_1]"]
    assert first["entries"][4]["original"] == " 532 123 45 67"
    assert "12345678902" not in first["text"] and IBAN_A not in first["text"]
    assert got[1]["text"] == "" and got[1]["entries"] == [] and got[2]["text"] == ""


def test_canonical_json_is_what_a_json_writer_makes(spark):
    """Random values of any depth, decoded and written with sorted keys and escapes."""
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.randrange(9 if depth < 3 else 6)
        if kind == 0:
            return rng.choice([None, True, False])
        if kind == 1:
            return rng.randint(-(10**12), 10**12)
        if kind == 2:
            return rng.choice([1.0, 0.1, -2.5, 1e20, 1e-7, 123456.789, -0.0, 1e16, 1.5e300])
        if kind <= 5:
            return "".join(rng.choice("ab<>&'\"\\/é😀\n\t\x01\x1f\x0b,:[]{} \x7fuA") for _ in range(rng.randint(0, 8)))
        if kind <= 7:
            return {"".join(rng.choice("abZé<_ ,") for _ in range(rng.randint(1, 3))): value(depth + 1) for _ in range(rng.randint(0, 4))}
        return [value(depth + 1) for _ in range(rng.randint(0, 4))]

    texts = [json.dumps(value(), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(300)]
    texts += ['{"a":1.}', '{"a":', '"x', "[1,2", "nul", "", '{"a":01}', '"' + "y" * 200_000 + '"', "1E5", "[1.10, 1e5]"]

    def expected(text):
        try:
            out = json.dumps(json.loads(text), sort_keys=True)
        except ValueError:
            return None
        for c in "<>&'":
            out = out.replace(c, f"\\u{ord(c):04x}")
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(canonical_json(F.col("t"))).collect()]
    assert got == [expected(t) for t in texts]
