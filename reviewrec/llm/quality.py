"""Quality rules of a text as one threshold table, compiled into a single projection of DataFrame functions.

Counts are made once a text, in stages of columns; a rule compares two counts as whole numbers, so no ratio is rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as characters and as a class of a pattern.
BLANKS = " \t\n\x0b\f\r"
_APART = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A window of this many words that a text has twice is repeated.
WINDOW = 3
#: Low bits of a window's code, for its place in the text; a text has fewer words than 2**PLACE, as it has at most 2 GB.
PLACE = 30
#: Fixed lists: the commonest words of four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from", "have"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est", "pour", "par", "dans", "avec", "qui", "pas", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}


class Rule(NamedTuple):
    """Kept texts have least * whole <= 100 * part <= most * whole; None: no bound on that side."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: Texts that fail one of these have base_failed. A text without words fails the first.
BASE = [
    Rule("few_words", "n_words", "one", 50 * 100, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
]
#: Texts that fail one of these aren't kept.
RULES = [
    Rule("many_words", "n_words", "one", None, 100_000 * 100),
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words"]


def fails(rule: Rule, count: dict[str, Column]) -> Column:
    part, whole = 100 * count[rule.part], count[rule.whole]
    low = F.lit(False) if rule.least is None else part < rule.least * whole
    high = F.lit(False) if rule.most is None else part > rule.most * whole
    return low | high


def compiled(counts: DataFrame, base: list[Rule] = BASE, rules: list[Rule] = RULES) -> list[Column]:
    """The table as columns over the counts: base_failed, failed (names of all rules that a text fails), kept."""
    count = {c: F.col(c) for c in COUNTS} | {"one": F.lit(1)}
    either = lambda table: reduce(lambda a, b: a | b, (fails(r, count) for r in table), F.lit(False))
    names = F.array_compact(F.array(*(F.when(fails(r, count), r.name) for r in [*base, *rules])))
    return [either(base).alias("base_failed"), names.alias("failed"), (~either([*base, *rules])).alias("kept")]


def _codes(words: str) -> Column:
    """For every window of an array of words, ascending: PLACE bits of where it starts under the other bits of its hash."""
    windows = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    others = [lambda i, k=k: F.get(words, i + k) for k in range(1, WINDOW)]
    return F.sort_array(F.transform(windows, lambda w, i: F.shiftleft(F.xxhash64(w, *(o(i) for o in others)), PLACE).bitwiseOR(i.cast("long"))))


def _level(sorted_: str, of: Callable[[Column], Column]) -> Column:
    """The elements of a sorted array that have the value of a neighbour."""
    beside = lambda x, i: F.coalesce(of(x) == of(F.get(sorted_, i - 1)), F.lit(False)) | F.coalesce(of(x) == of(F.get(sorted_, i + 1)), F.lit(False))
    return F.filter(sorted_, beside)


def _covered(places: str) -> Column:
    """Words under windows that start at these ascending places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda s: s["n"])


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts): see COUNTS. Null text has no words and no lines.

    Repeated windows are sought by a hash, and those alike in it are compared as text, so no count rests on a hash.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = lambda of, pattern: F.when(of == "", F.array().cast("array<string>")).otherwise(F.split(of, pattern))
    stops = sorted({form for own in STOP_WORDS.values() for w in own for form in (w, w.capitalize())})
    step = docs.select(F.col(f"`{key}`").alias("key"), whole.alias("text"), F.trim(whole, F.lit(BLANKS)).alias("inner"))
    step = step.select("key", "text", some(F.col("inner"), _APART).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "").alias("lines"))
    step = step.select(
        "key", "words",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.size(F.split("text", f"[{SYMBOLS}]")) - 1).alias("n_symbols"),
        F.size(F.filter("words", lambda w: w.isin(stops))).alias("n_stop_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis_lines"),
        _codes("words").alias("codes"),
    )
    counts = COUNTS[:-1]
    step = step.select("key", *counts, "words", F.transform(_level("codes", lambda c: F.shiftright(c, PLACE)), lambda c: c.bitwiseAND((1 << PLACE) - 1).cast("int")).alias("alike"))
    texts = F.transform("alike", lambda p: F.struct(F.concat_ws(" ", *(F.get("words", p + k) for k in range(WINDOW))).alias("window"), p.alias("at")))
    step = step.select("key", *counts, F.sort_array(texts).alias("windows"))
    step = step.select("key", *counts, F.sort_array(F.transform(_level("windows", lambda w: w["window"]), lambda w: w["at"])).alias("places"))
    return step.select(F.col("key").alias(key), *(F.col(c).cast("long").alias(c) for c in counts), _covered("places").cast("long").alias("n_repeat_words"))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", base: list[Rule] = BASE, rules: list[Rule] = RULES) -> DataFrame:
    """(key, counts, base_failed, failed, kept) for every row of docs (key, text, ..): what each rule counts, the rules it fails, the verdict.

    Words are runs between white space; lines are what \\n separates, and count if they hold a word. Null and empty texts have no
    words: they fail few_words. Repeated rows each get a row, as does a null key. Other columns of docs are ignored.
    An empty table gives no rows. No shuffle; a row is a text, and its cost is that of sorting its words.
    """
    counts = counted(docs, key, text)
    return counts.select(key, *COUNTS, *compiled(counts, base, rules))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIST = ", ".join(f"'{w}'" for w in sorted({form for own in STOP_WORDS.values() for w in own for form in (w, w.capitalize())}))
OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT r, generate_subscripts(words, 1) AS place, unnest(words) AS a FROM d
), t AS (
  SELECT r, place, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS t FROM w WINDOW o AS (PARTITION BY r ORDER BY place)
), twice AS (
  SELECT r, place FROM t WHERE t IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, t) > 1
), n AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([place, place + 1, place + 2]) AS p FROM twice) GROUP BY r
), c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({_LIST}))) AS stops, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS ellipses
  FROM d LEFT JOIN n USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 100000 AND 100 * word_chars BETWEEN 300 * n_words AND 1000 * n_words
       AND 100 * n_symbols <= 10 * n_words AND 100 * stops >= 5 * n_words AND 100 * n_dup_lines <= 30 * n_lines
       AND 100 * bullets <= 90 * n_lines AND 100 * ellipses <= 30 * n_lines AS kept
FROM b
"""
