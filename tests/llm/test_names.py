"""Columns of a user that carry names used inside the operators."""

import pytest

from reviewrec.llm import decontaminate, html, langid, lines, near, packing, substrings, toxicity

NAMES = ["_text", "_html", "doc", "at", "n", "row", "spans", "_spans", "_gone", "_doc", "id", "y", "_y", "stays", "left", "a.b", "part", "text_"]
WORDS = "the quick brown fox jumps over the lazy dog while the old cat sleeps near the warm fire tonight"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", *NAMES) for k, t in enumerate([WORDS, WORDS, None, "", "nasty words of a kind " * 30])]
    return spark.createDataFrame([*rows, (None, WORDS, "en", *NAMES)], ["doc_id", "text", "lang", *NAMES])


def kept(out, docs):
    got = [r.asDict() for r in out.collect()]
    assert len(got) == docs.count() and all(g[n] == n for g in got for n in NAMES)
    return got


def test_every_operator_keeps_them(spark, docs):
    kept(langid.identify(docs, docs), docs)
    labels = spark.createDataFrame([(0, 0, "q"), (4, 1, "q")], "doc_id long, toxic int, _y string")
    kept(toxicity.toxicity(docs, labels), docs)
    items = spark.createDataFrame([(7, WORDS, "z")], "item_id long, text string, _text string")
    got = kept(decontaminate.find(docs, items), docs)
    assert {g["doc_id"] for g in got if g["contaminated"]} == {0, 1, None}
    got = kept(substrings.suffix_dedup(docs), docs)
    assert {g["doc_id"]: g["n_removed"] for g in got}[1] == len(WORDS)
    kept(substrings.window_dedup(docs), docs)
    kept(lines.dedup_lines(docs), docs)
    pages = docs.withColumnRenamed("text", "html").withColumnRenamed("doc_id", "page_id")
    assert all(g["text"] in ("", WORDS) or "nasty" in g["text"] for g in kept(html.extract(pages), pages))
    assert near.near_duplicates(docs).count() == docs.count()
    assert packing.pack(docs).select("doc_id").distinct().count() == 6
