"""Model replies as text and as VARIANT values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from evraklab.functions.amounts import parse_amount
from evraklab.functions.lang import float_text, strip

FENCED = r"(?s)```json\s*(.*?)\s*```"
# From the first opening brace to the last closing one; anchored, so the text is read once.
BRACES = r"(?s)^[^{]*+(\{.*\})?"
REPLY_PATH = "$.candidates[0].content.parts[0].text"


def reply_text(body: Column) -> Column:
    """Reply text inside a raw response body."""
    return F.get_json_object(body, REPLY_PATH)


def cut_json(text: Column) -> Column:
    """The JSON part of a reply: a fenced block, else first ``{`` to last ``}``, else all."""
    none = ~F.contains(text, F.lit("{")) | ~F.contains(text, F.lit("}"))
    return (
        F.when(F.rlike(text, F.lit(FENCED)), strip(F.regexp_extract(text, FENCED, 1)))
        .when(none, strip(text))
        .otherwise(F.regexp_extract(text, BRACES, 1))
    )


NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
FRACTIONS = NUMBERS[1:]


def kind(value: Column) -> Column:
    """Type word of a VARIANT: STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, OBJECT, ARRAY,
    VOID for a JSON null; MISSING for no value at all."""
    word = F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)
    return F.coalesce(word, F.lit("MISSING"))


def is_object(value: Column, path: str = "$") -> Column:
    """Whether a VARIANT has an object at a path; unlike ``kind`` this does not look into it."""
    return F.try_variant_get(value, path, "struct<>").isNotNull()


def parts_of(value: Column) -> dict[str, Column]:
    """``kind`` and ``raw``: a VARIANT's type word and its cast to string."""
    return {"kind": kind(value), "raw": F.try_variant_get(value, "$", "string")}


def typed(value: Column) -> Column:
    """struct(kind, raw) of ``parts_of``."""
    return F.struct(*[part.alias(name) for name, part in parts_of(value).items()])


# Below, ``t`` is a ``typed`` value, or a mapping of its two names to columns.
Typed = Column | Mapping[str, Column]


def text_of(t: Typed) -> Column:
    """Text of a ``typed`` value as lines are compared with it: ``250.0``, ``True``."""
    return (
        F.when(t["kind"].isin(*FRACTIONS), float_text(t["raw"].try_cast("double")))
        .when(t["kind"] == "BOOLEAN", F.when(t["raw"] == "true", "True").otherwise("False"))
        .otherwise(t["raw"])
    )


def is_truthy(t: Typed) -> Column:
    """False for a missing value, null, '', zero, false and an empty container."""
    k, raw = t["kind"], t["raw"]
    return (
        F.when(k.isin("MISSING", "VOID"), False)
        .when(k.isin(*NUMBERS), F.coalesce(raw.try_cast("double") != 0, F.lit(True)))
        .otherwise(~raw.isin("", "{}", "[]") | ((k == "STRING") & (raw != "")))
        & ~((k == "BOOLEAN") & F.coalesce(raw == "false", F.lit(False)))
    )


def described(t: Typed) -> Column:
    """struct(kind, raw, text, truthy) of a ``typed`` value."""
    return F.struct(
        t["kind"].alias("kind"),
        t["raw"].alias("raw"),
        text_of(t).alias("text"),
        is_truthy(t).alias("truthy"),
    )


def amount_of(t: Typed) -> Column:
    """Number of a ``typed`` value: numbers lose their sign, strings are parsed."""
    return (
        F.when(t["kind"].isin("MISSING", "VOID"), F.lit(0.0))
        .when(t["kind"].isin(*NUMBERS), F.abs(t["raw"].try_cast("double")))
        .when(t["kind"] == "BOOLEAN", F.when(t["raw"] == "true", 1.0).otherwise(0.0))
        .otherwise(parse_amount(t["raw"]))
    )


# A JSON text cut into strings, other scalars, punctuation and white space.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s\[\]{},:"]+|[\[\]{},:]|\s+|"'
FLOAT = r"^-?(?:0|[1-9]\d*)(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+)$"
# A noncharacter: marks a string that stands for a fraction, which VARIANT would normalise.
FRACTION = "\ufdd1"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _escaped(token: Column) -> Column:
    """A string token in ASCII, without the characters that mean something in markup."""

    def character(c: Column) -> Column:
        code = F.ascii(c)
        unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        above = code - 0x10000
        high, low = F.shiftright(above, 10) + 0xD800, above.bitwiseAND(0x3FF) + 0xDC00
        return (
            F.when(c.isin("<", ">", "&", "'") | ((code > 0x7E) & (code < 0x10000)), unit(code))
            .when(code >= 0x10000, F.concat(unit(high), unit(low)))
            .otherwise(c)
        )

    spelled = F.array_join(F.transform(F.split(token, ""), character), "")
    # The parser's own escapes of control characters have upper-case digits.
    lowered = F.when(F.contains(spelled, F.lit("\\u00")), _lower_controls(spelled)).otherwise(spelled)
    return F.when(F.rlike(token, F.lit(r"[^ -~]|[<>&']|\\u")), lowered).otherwise(token)


def _lower_controls(text: Column) -> Column:
    for digit in "ABCDEF":
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    return text


def canonical_json(text: Column) -> Column:
    """JSON text decoded and written anew; null where it is no JSON or repeats a key.

    Keys sorted at every depth, ``, `` and ``: `` between items, fractions in their
    shortest form, ASCII only, and ``< > & '`` as escapes.
    """
    marked = F.array_join(
        F.transform(
            _tokens(text),
            lambda t: F.when(F.rlike(t, F.lit(FLOAT)), F.concat(F.lit(f'"{FRACTION}'), t, F.lit('"'))).otherwise(t),
        ),
        "",
    )

    def written(t: Column) -> Column:
        number = float_text(F.regexp_replace(t, f'["{FRACTION}]', "").cast("double"))
        return (
            F.when(t == ",", ", ")
            .when(t == ":", ": ")
            .when(F.startswith(t, F.lit(f'"{FRACTION}')), number)
            .when(F.startswith(t, F.lit('"')), _escaped(t))
            .otherwise(t)
        )

    return F.array_join(F.transform(_tokens(F.to_json(F.try_parse_json(marked))), written), "")
