"""Large groups: what goes the other way beyond LARGE rows gives the same results."""

from reviewrec.llm import repeats, substrings
from tests.llm.test_substrings import SCHEMA, brute_bytes, brute_words, mixed


def test_large_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LARGE", 2)
    rows = mixed(11)
    monkeypatch.setattr(repeats.common, "shuffle_partitions", lambda spark: 24)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.cut), bytes(r.kept)) for r in substrings.suffix_dedup(df).collect()}
    assert got == brute_bytes(rows, 50)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.window_dedup(df).collect())
    assert got == brute_words(rows, 35)
