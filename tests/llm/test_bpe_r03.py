"""The merges of op7_bpe and of the last stage of the pipeline, after round 3."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evraklab.llm import bpe, core


@pytest.fixture(scope="module")
def codec(spark):
    core.prepare(spark)
    return bpe.Codec(spark, bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_plan_carries_no_table_of_ranks(spark, codec):
    """The driver holds and ships plans: the ranks travel as a broadcast, not as a literal of millions of characters."""
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    df = docs.select(codec.encoded(F.split("text", " ")).alias("ids"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 100_000


def test_words_of_all_lengths_side_by_side(spark, codec):
    """Words about ``SHORT`` and ``LONG``, tokens, and letters that came with Unicode 15."""
    expected = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choice("aabcdeé") for _ in range(n)) for n in (1, 2, 30, 63, 64, 65, 255, 256, 257, 900) for _ in range(3)]
    texts = words + [" ".join(words), "a\U00031350b c\U00031351", "the and", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for head in (bpe.HEAD, 0):
        rows = codec.encode(docs, head=head).collect()
        assert len(rows) == len(texts)
        for i, ids in rows:
            assert ids == expected.encode_ordinary(texts[i] or "")
    lists = spark.createDataFrame([(1, ["ab cd", ""]), (2, None), (3, [])], "i int, w array<string>")
    found = {i: ids for i, ids in lists.select("i", codec.encoded(F.col("w"))).collect()}
    assert found == {1: [expected.encode_ordinary("ab cd"), []], 2: None, 3: []}
