"""Column expressions on single texts; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word in any script.
WORD = r"[\p{L}\p{N}_]+"


def once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it and wherever the plan moves it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean(text: Column) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters; longer texts end in three dots."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def head_and_tail(text: Column, most: int, head: int) -> Column:
    """At most ``most`` words: the first ``head`` and the last others."""
    words = F.split(clean(text), " ")
    return F.when(F.size(words) > most, F.array_join(F.concat(F.slice(words, 1, head), F.slice(words, -(most - head), most - head)), " ")).otherwise(text)


def pieces(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(clean(text)), " "), lambda w: w != ""))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits in order, repeated ones too."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of words: 1 if both are empty, 0 if one is."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def distinct_share(items: Column) -> Column:
    """Distinct items by all items, 0 of none."""
    return F.coalesce(F.try_divide(F.size(F.array_distinct(items)), F.size(items)), F.lit(0.0))


def bigrams(items: Column) -> Column:
    """Each two neighbouring words as one text."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def holds_any(text: Column, phrases: list[str]) -> Column:
    """True if the text holds one of the phrases as a substring."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct ASCII words of two letters or more that are not in the stop list."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)))
    return F.filter(F.array_except(found, F.array(*map(F.lit, stop))), lambda w: F.length(w) > 1)


def slug(text: Column) -> Column:
    """A safe file name: other characters as underscores, at most 120."""
    return F.left(F.regexp_replace(text, r"[^\w\-]+", "_"), F.lit(120))


def json_object(text: Column) -> Column:
    """The first JSON object in a noisy text as variant, or null."""
    inner = F.regexp_extract(F.regexp_replace(text, "```(json)?", ""), r"(?s)\{.*\}", 0)
    return F.try_parse_json(F.when(inner != "", inner))


def score_in(text: Column, otherwise: float = 3.0) -> Column:
    """The first single digit from 1 to 5 standing alone in a text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\b([1-5])\b", 1), F.lit("")).cast("double"), F.lit(otherwise))
