"""One test for each finding of round 3 on the text operators."""

import random

import pytest

from evraklab.llm import html_text, lm, simhash
from evraklab.session import configure


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_html_repeats_do_not_depend_on_chunks(spark):
    """A run that two kinds of stretches hold only together is found however they are dealt."""
    heads, tail = (words(1, 10), words(2, 10)), words(3, 12)
    rows = []
    for i in range(12):
        end = tail if i % 6 < 3 else words(100 + i, 12)
        block = f"{heads[i // 6]} {end}"
        rows.append((i, f"http://h.example/{i}", f"<article><p>{words(200 + i, 60)}</p><p>{block}</p></article>"))
    pages = configure(spark).createDataFrame(rows, "page_id bigint, url string, html string")
    found = []
    for chunk in (2000, 2, 1):
        found.append({r["page_id"]: r["text"].count("\n") for r in html_text.extract(pages, chunk).collect()})
    assert found[0] == {i: int(i % 6 >= 3) for i in range(12)}
    assert found[1] == found[0] and found[2] == found[0]


def test_one_copy_of_what_simhash_links(spark):
    """Repeats weigh in fingerprints, not in sets of shingles: a link below 0.8 drops a document too."""
    refrain = " ".join([words(7, 13)] * 60)
    rows = [(i, f"{refrain} {words(300 + i, 10)}") for i in range(4)] + [(9, words(400, 80))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert simhash.jaccard(rows[0][1].encode(), rows[1][1].encode()) < simhash.COPY_JACCARD
    linked = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert linked == {0, 9}
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == linked


def test_lm_scores_do_not_depend_on_head(spark, monkeypatch):
    """Words that not every task knows are scored alike by the join (F2)."""
    docs = spark.createDataFrame([(i, words(i % 9, 40) + f" common{i % 80} the of") for i in range(150)], "doc_id bigint, text string")
    whole = lm.vocabulary
    found = []
    for size in (lm.HEAD, 100):
        monkeypatch.setattr(lm, "vocabulary", lambda counted: whole(counted, size))
        found.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in lm.score(docs).collect()})
    assert len(found[0]) == 150
    for i, row in found[0].items():
        assert row == pytest.approx(found[1][i], rel=1e-9)
