import random

import numpy as np

from reviewrec.llm import decontaminate as D

SCHEMA = "doc_id long, text string, contaminated string"


def exhaustive(index, word, at):
    """Scores of all passages against all units, without bounds."""
    out = set()
    for d in range(len(at) - 1):
        own = word[at[d] : at[d + 1]].tolist()
        for k in range(max(1, -(-(len(own) - 2 * D.UNIT) // D.UNIT) + 1)):
            there = set(own[k * D.UNIT : k * D.UNIT + 2 * D.UNIT])
            for u, w in enumerate(index.weights):
                if sum(x for t, x in w.items() if t in there) >= D.THRESHOLD - 1e-9:
                    out.add((d, index.item_of[u]))
    return sorted(out)


def sample(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    pick = lambda n: " ".join(vocab[int(300 * r.random() ** 2)] for _ in range(n))
    items = [f"{pick(r.randint(4, 70))}. {pick(r.randint(1, 9))}." for _ in range(60)]
    docs = []
    for _ in range(80):
        t = pick(r.randint(0, 300))
        if r.random() < 0.5:
            item = r.choice(items)
            if r.random() < 0.4:
                w = item.split()
                w[r.randrange(len(w))] = "changed"
                item = " ".join(w)
            t += " " + item.upper() + "\n" + pick(r.randint(0, 200))
        docs.append(t)
    return items, docs


def test_wand_equals_exhaustive_scoring():
    for seed in range(3):
        items, docs = sample(seed)
        index = D.Index(list(range(len(items))), items)
        word, at = D.words(docs)
        got = index.retrieve(word, at)
        assert got == exhaustive(index, word, at) and len(got) > 20


def test_find(spark):
    items, docs = sample(9)
    planted = [(1000 + k, f"before it, {x} and after") for k, x in enumerate(items)]
    rows = [(i, t, "x") for i, t in [*enumerate(docs), *planted]] + [(5000, None, "x"), (5001, "", "x"), (None, planted[0][1], "x")]
    tests = spark.createDataFrame([*enumerate(items), (900, None), (901, "..."), (None, "a b")], "item_id long, text string")
    got = D.find(spark.createDataFrame(rows, SCHEMA), tests).collect()
    by = {r.doc_id: r for r in got}
    assert all(k in by[1000 + k].item_ids for k in range(len(items)))
    assert by[5000].item_ids == [] and not by[5001].contaminated and by[None].contaminated
    # those of the plain documents have most of an item in them
    for i, t in enumerate(docs):
        flat = " ".join(t.lower().replace(".", "").split())
        for k in by[i].item_ids:
            assert np.mean([w in flat.split() for w in items[k].replace(".", "").split()]) > 0.7
        assert {k for k, x in enumerate(items) if " ".join(x.lower().replace(".", "").split()) in flat} <= set(by[i].item_ids)
    assert D.find(spark.createDataFrame(rows, SCHEMA).limit(0), tests).count() == 0
    assert not any(r.contaminated for r in D.find(spark.createDataFrame(rows, SCHEMA), tests.limit(0)).collect())


def test_parts(spark, monkeypatch):
    items, _ = sample(4)
    docs = spark.createDataFrame([(k, x, "x") for k, x in enumerate(items)], SCHEMA)
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(D, "INDEX_ITEMS", 25)
    assert all(r.doc_id in r.item_ids for r in D.find(docs, tests).collect())


def test_some_passage_has_a_whole_unit():
    for n in range(1, 400):
        units = D.cut(np.arange(n, dtype=np.uint64))
        assert max(len(u) for u in units) <= D.UNIT + 1 and sum(len(u) for u in units) == n
    # units of 45 words lay across two passages
    index = D.Index([0], [" ".join(f"w{k}" for k in range(45))])
    assert max(len(w) for w in index.weights) <= D.UNIT + 1


def test_parts_find_what_one_index_finds(spark, monkeypatch):
    items, docs = sample(4)
    rows, tests = spark.createDataFrame([(k, x, "x") for k, x in enumerate(docs)], SCHEMA), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.n_retrieved, r.item_ids) for r in D.find(rows, tests).collect())
    one = found()
    monkeypatch.setattr(D, "INDEX_ITEMS", 7)
    assert found() == one
    whole = D.Frequencies()
    whole.add(items[:20])
    whole.add(items[20:])
    part = D.Index(list(range(20)), items[:20], whole).weights
    assert part == D.Index(list(range(60)), items).weights[: len(part)] != D.Index(list(range(20)), items[:20]).weights


def test_query(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {r.doc_id: r for r in D.op10_decontamination(spark, sf).collect()}
    whole = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for x in items:
            if x.text in r.text:
                whole += 1
                assert x.item_id in got[r.doc_id].item_ids
    assert whole > 0 and sum(r.contaminated for r in got.values()) < len(got) / 2
