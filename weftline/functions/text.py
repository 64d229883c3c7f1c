"""Column functions over text and markup."""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.lexicon import FUNCTION_WORDS, GLUE_WORDS

TOKEN = "[a-z0-9']+"


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """HTML character references decoded, with the full table of names; null stays null."""
    return text.map(html_lib.unescape, na_action="ignore")


def stripped_markup(html: Column) -> Column:
    """Text of markup without comments, embedded programs and tags, not yet decoded."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(script|style|svg|noscript)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(out, r"<[^>]+>", " ")


def squeezed(text: Column, unicode: bool = False) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+" if unicode else r"\s+", " "))


def visible_text(html: Column, decode: bool = True) -> Column:
    """Text that a reader sees. Without decode, character references stay as they are and everything runs in the JVM."""
    out = stripped_markup(html)
    return squeezed(html_unescape(out), unicode=True) if decode else squeezed(out)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, trimmed; null where there is none."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.trim(F.regexp_extract(text, pattern, group)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def space_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n neighbouring words, joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def habit_grams(words: Column, n: int) -> Column:
    """N-grams that can be a habit: not of glue words alone, with one content word per three at most."""
    glue, function = (F.array(*[F.lit(w) for w in sorted(s)]) for s in (GLUE_WORDS, FUNCTION_WORDS))
    content = n // 3

    def fits(g: Column) -> Column:
        own = F.split(g, " ")
        return (F.size(F.filter(own, lambda w: ~F.array_contains(glue, w))) > 0) & (F.size(F.filter(own, lambda w: ~F.array_contains(function, w))) <= content)

    return F.filter(ngrams(words, n), fits)


def budget(rate: float, floor: int, words: Column) -> Column:
    """How often a pattern may occur in so many words: the floor, or a rate per thousand rounded half to even."""
    return F.greatest(F.lit(floor), F.bround(F.lit(float(rate)) * words / 1000, 0).cast("int"))


def longest_run(values: Column, test) -> Column:
    """Length of the longest run of neighbouring elements that pass a test."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(test(x), acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(values, start, step, lambda acc: acc["most"])


def staccato(text: Column, most_words: int = 5) -> Column:
    """Longest run of neighbouring sentences with few words."""
    return longest_run(sentences(text), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) <= most_words)


def sample(text: Column, size: int = 60) -> Column:
    """The first characters of a text, for reports."""
    return F.substring(text, 1, size)


def top_level_parts(text: Column) -> Column:
    """Parts between commas that stand outside parentheses, trimmed (parentheses nested once)."""
    return F.transform(F.split(text, r",(?![^(]*\))"), lambda s: F.trim(s))


def fence_free(text: Column) -> Column:
    """Markdown without fenced blocks."""
    return F.regexp_replace(text, r"(?ms)^```.*?^```[^\n]*$", "")
