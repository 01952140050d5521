"""Column functions: cleaning, labels, calendar parts, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_price(c: Column | str) -> Column:
    """The first number in a free-text price; null if there is none."""
    return F.nullif(F.regexp_extract(_c(c), r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def time_of_day(ts: Column | str) -> Column:
    """early_morning 0-5, morning 6-11, midday 12-17, night 18-23; null stays null."""
    h = F.hour(_c(ts))
    return F.when(h < 6, "early_morning").when(h < 12, "morning").when(h < 18, "midday").when(h >= 18, "night")


def date_features(ts: Column | str) -> list[Column]:
    """year, month, day, dayofweek (Monday 0), is_weekend."""
    t = _c(ts)
    return [F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.weekday(t).alias("dayofweek"), F.weekday(t).isin(5, 6).alias("is_weekend")]


def clean_text(c: Column | str) -> Column:
    """Lower case, without links and anything but a-z and spaces; single spaces."""
    out = F.regexp_replace(F.lower(_c(c)), r"http\S+|www\S+", "")
    out = F.regexp_replace(out, r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def flat_map(c: Column | str) -> Column:
    """A map as "key value" words."""
    return F.array_join(F.transform(F.map_entries(_c(c)), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


def flat_list(c: Column | str) -> Column:
    return F.array_join(_c(c), " ")


def product_text(title: Column, description: Column | None = None, features: Column | None = None, details: Column | None = None, categories: Column | None = None) -> Column:
    """One text from a product's fields; absent ones leave nothing."""
    parts = [title, description, None if features is None else flat_list(features), None if details is None else flat_map(details), None if categories is None else flat_list(categories)]
    return F.trim(F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts if p is not None)))


def review_text(title: Column | str, text: Column | str) -> Column:
    return F.trim(F.concat_ws(" ", _c(title), _c(text)))


def sentiment_label(rating: Column | str) -> Column:
    """negative up to 2, neutral 3, positive above; null stays null."""
    r = _c(rating)
    return F.when(r <= 2, "negative").when(r == 3, "neutral").when(r.isNotNull(), "positive")


def sentiment_code(rating: Column | str) -> Column:
    r = _c(rating)
    return F.when(r <= 2, 0).when(r == 3, 1).when(r.isNotNull(), 2)


def confidence_bucket(c: Column | str) -> Column:
    """Right-closed buckets with edges 0, .3, .6, 1; others null."""
    x = _c(c)
    return F.when((x > 0) & (x <= 0.3), "low").when((x > 0.3) & (x <= 0.6), "medium").when((x > 0.6) & (x <= 1), "high")


def rating_unit(c: Column | str) -> Column:
    return (_c(c) - 1) / 4


def words(c: Column | str) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(F.lower(_c(c)), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(c), r"\s+"), lambda w: w != ""))


def repeat_text(c: Column | str, times: Column | str) -> Column:
    """A text, so many times, joined by spaces."""
    return F.array_join(F.array_repeat(_c(c), _c(times).cast("int")), " ")


def parse_list(c: Column | str) -> Column:
    """A list literal with single or double quotes."""
    return F.from_json(F.regexp_replace(_c(c), "'", '"'), "array<string>")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.date_diff(_c(later), _c(earlier))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column | str, by: Column | float) -> Column:
    return F.transform(_c(a), lambda x: x * by)


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def unit(a: Column | str) -> Column:
    """A vector over its length; a zero vector stays."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x / F.when(n > 0, n).otherwise(1.0))


def band(score: Column, lo: Column, hi: Column, n: int) -> Column:
    """Number of the score's band of n equal, half-open bands between lo and hi; the top one is closed."""
    width = (hi - lo) / n
    return F.when(width <= 0, 0).otherwise(F.least(F.floor((score - lo) / F.when(width > 0, width).otherwise(1.0)), F.lit(n - 1))).cast("int")
