import hashlib
import random

import pytest

from reviewrec.llm import repeats, substrings

SCHEMA = "doc_id long, text string, extra int"


def brute_bytes(rows, width):
    least = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - width + 1):
            if least[raw[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(raw, gone) if not g))
    return out


def brute_words(rows, width):
    seen = {}
    for _, t, *_ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def mixed(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(40)]
    passage = [" ".join(r.choice(vocab) for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 80)))]
        if r.random() < 0.6:
            parts.append(r.choice(passage)[r.randint(0, 40) :])
        if r.random() < 0.3 and rows:
            parts.append(r.choice(rows)[1] or "")
        rows.append((i * 3 + 1, " \n".join(parts), i))
    rows += [(900, None, 1), (901, "", 1), (902, "a" * 400, 1), (903, "a" * 70, 1), (904, "x y " * 90, 1), (905, rows[0][1], 2)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed):
    rows = mixed(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.cut), bytes(r.kept)) for r in substrings.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute_bytes(rows, 50)


@pytest.mark.parametrize("seed", [3, 4])
def test_words_against_brute_force(spark, seed):
    rows = mixed(seed)
    rows.append(rows[0])
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.window_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())
    assert got == brute_words(rows, 35)


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 97)
    rows = mixed(7, 20)
    import numpy as np

    for width, gram, tokens in ((50, 20, repeats.byte_tokens), (35, 10, repeats.word_tokens)):
        import pyarrow as pa

        batch = pa.record_batch({"id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])})
        starts = {}
        for runs, doc, at, _ in repeats.runs_of(iter([batch]), tokens, width, gram):
            for d, a, n in zip(doc.tolist(), at.tolist(), runs.n.tolist()):
                starts.setdefault(d, []).extend(range(a, a + n))
        for i, t, *_ in rows:
            size = len((t or "").encode()) if width == 50 else len((t or "").encode().split())
            assert sorted(starts.get(i, [])) == list(range(max(0, size - width + 1)))


def test_empty_null_key_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.suffix_dedup(empty).count() == 0 and substrings.window_dedup(empty).count() == 0
    text = " ".join(f"word{k}" for k in range(50))
    df = spark.createDataFrame([(None, text, 1), (1, text, 2), (2, text, 3)], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.suffix_dedup(df).collect()}
    assert got[None] == (0, text.encode()) and got[1] == (0, text.encode()) and got[2] == (len(text), b"")
    got = {r.doc_id: r.n_removed for r in substrings.window_dedup(df).collect()}
    assert got == {None: 0, 1: 50, 2: 50}


def test_queries(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_bytes(docs, 50)
    for r in substrings.op4_suffix_array(spark, sf).collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    words = {i: (n, gone, hashlib.sha256(k.encode()).hexdigest()) for i, n, gone, k in brute_words(docs, 35)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op9_substring(spark, sf).collect()} == words
