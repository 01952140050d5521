import random
import zlib
from collections import defaultdict

import numpy as np

from reviewrec.llm import packing

SCHEMA = "doc_id long, text string, start int"


def whole_ids(text):
    return packing.Encoder(None).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, got, encode):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids = np.array(encode(t), "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert set(by_doc) == {r[0] for r in rows}


def test_round_trip(spark):
    r = random.Random(5)
    tok = packing.Encoder(None).tokenizer
    words = ["the", "über", "naïve", "don't", "x1", "12345", "a,b", "日本語", "🙂", "%%%"]
    gaps = [" ", "  ", "\n", "\n\n", "\t", " \n ", "\xa0", "\x1c", "<|endoftext|>"]
    rows = []
    for i in range(80):
        rows.append((i, "".join(r.choice(words) + (" " if r.random() < 0.8 else r.choice(gaps)) for _ in range(r.choice([0, 1, 5, 60, 900, 4000]))), i))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "   ", 1), (1003, "word " * 9000, 1)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    check(rows, got, lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1])


def test_empty_and_null_key(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    got = packing.pack(spark.createDataFrame([(None, "a b", 1), (3, "c", 2), (3, "c", 2)], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.length) for r in got if r.doc_id is None) and sum(r.length for r in got if r.doc_id == 3) == 4


def test_query(spark, sf):
    tok = packing.Encoder(None).tokenizer
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, packing.op1_packing(spark, sf).collect(), lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1])
