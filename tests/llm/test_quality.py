"""Quality rules against a plain count, and each rule of the table by a text of its own."""

import random
import re

from reviewrec.llm import quality as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    under = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(under)


def texts(seed):
    rng = random.Random(seed)
    small = ["a", "b", "the", "of", "é", "𝄞x", "#", "<b>", "...", "ß|", " "]
    gaps = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c"]
    made = ["".join(rng.choice(gaps) + rng.choice(small) * rng.randint(0, 2) for _ in range(n)) for n in [0, 1, 2, 3, 4, 8, 20, 60, 200] for _ in range(4)]
    return [None, "", " ", "\n", "a a a a", "a b c a b c", "x\nx\n x\nx", "\x00 a \x00 a", "  word\u0085", *made, "long " * 5000, "".join(chr(c) for c in range(1, 300))]


def test_counts(spark):
    rows = list(enumerate(texts(5)))
    got = {r.doc_id: tuple(r)[1:] for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {k: plain(t) for k, t in rows}


def test_rules(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    clean = " ".join(w + rng.choice([" the", "", "", ".\n"]) for w in words)
    broken = {
        "few_words": "only a few of the words",
        "repeated_words": " ".join(["one of the words"] * 30),
        "word_length": " ".join(w * 5 + " the" for w in words),
        "symbols": " ".join(w + rng.choice(["#", "", " the"]) for w in words),
        "stop_words": " ".join(words),
        "repeated_lines": "\n".join(["the same line"] * 150) + "\n" + "\n".join(f"the {w}" for w in words[:100]),
        "bullet_lines": "\n".join(f"- the {w}" for w in words),
        "ellipsis_lines": "\n".join(f"the {w} ..." for w in words),
    }
    df = spark.createDataFrame([("clean", clean), *broken.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in Q.quality(df).collect()}
    assert got["clean"].kept and not got["clean"].failed
    assert all(name in got[name].failed and not got[name].kept for name in broken)
    assert {n for n in broken if got[n].base_failed} >= {"few_words", "repeated_words"} and not got["symbols"].base_failed
    assert all(r.kept == (not r.failed) for r in got.values())


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x", 0), (1, "a b", "y", 0), (None, None, None, 0)], "doc_id long, text string, kept string, words int")
    got = Q.quality(df).collect()
    assert sorted((r.doc_id is None, r.n_words, r.kept) for r in got) == [(False, 2, False), (False, 2, False), (True, 0, False)]
    assert Q.quality(df.limit(0)).count() == 0
    loose = Q.quality(df, base=[], rules=[Q.Rule("two", "n_words", "one", 200, 200)]).collect()
    assert sorted(r.kept for r in loose) == [False, True, True]


def test_same_as_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = Q.op13_quality_rules(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(Q.OP13_SQL).fetchall())
