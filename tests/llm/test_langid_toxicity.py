import zlib

import numpy as np

from reviewrec.llm import langid, toxicity

SCHEMA = "doc_id long, text string, lang string, score string"


def test_probabilities_sum_to_one():
    r = np.random.RandomState(1)
    texts = ["".join(r.choice(list("abcde é"), 200)) for _ in range(20)]
    gram, _, _ = langid.coded(texts)
    keys, n = np.unique(gram, return_counts=True)
    model = langid.build({"x": (keys, n)})
    for context in (gram[5] >> 6, gram[77] >> 6, 12345):
        every = ((np.uint32(context) << np.uint32(6)) | np.arange(64, dtype=np.uint32)).astype(np.uint32)
        assert abs(np.exp(model.log_probabilities(every).astype(float)).sum() - 1) < 1e-4


def test_kneser_ney_by_hand():
    """The highest order, written out for one context."""
    gram, _, _ = langid.coded(["abab abab abac"])
    keys, n = np.unique(gram, return_counts=True)
    p, p3, _ = langid.kneser_ney(keys, n.astype(float))
    k = int(keys[n.argmax()])
    context = keys >> 6 == k >> 6
    one, two = (n == 1).sum(), (n == 2).sum()
    d = one / (one + 2 * two)
    want = (n.max() - d) / n[context].sum() + d * context.sum() / n[context].sum() * p3[k & 0x3FFFF]
    assert abs(p[n.argmax()] - want) < 1e-12


def test_edge_cases(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en", "x"), (2, "der hund und die katze sind nicht da", "de", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "123 %%% 4", None, "x"), (6, "the dog and the cat " * 3000, None, "x"), (6, "the dog and the cat " * 3000, None, "x"), (None, "die katze und der hund", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in langid.identify(df, df).collect())
    assert [(i, x) for i, x, _ in got] == [(0, "de"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert all(0 <= s <= 1 for *_, s in got)
    assert langid.identify(df.limit(0), df).count() == 0
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}


def test_language_held_out(spark, sf):
    got = langid.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95


def test_toxicity_learns_and_edges(spark):
    r = np.random.RandomState(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 5 == 0)
        t = list(r.choice(words, 40))
        if toxic:
            t[7] = r.choice(["nasty", "vile"])
        rows.append((i, " ".join(t), "en", "x"))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (1000, None, None, None), (1001, "", None, None), (1001, "", None, None), (None, "vile", None, None)], SCHEMA)
    lab = spark.createDataFrame([*labels[:450], (None, 1), (2000, None), (0, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == 604 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.doc_id is not None and 450 <= x.doc_id < 600]
    assert np.mean([x.predicted == int(x.doc_id % 5 == 0) for x in held]) > 0.95
    assert {x.score for x in toxicity.toxicity(docs, lab.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0


def test_toxicity_query(spark):
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    hits = sum(x.predicted and x.toxic for x in held)
    assert hits / sum(x.toxic for x in held) > 0.85 and hits / sum(x.predicted for x in held) > 0.9
