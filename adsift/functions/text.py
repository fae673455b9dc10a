"""Text expressions: every function maps columns to a column.

Java's ``\\w``, ``\\s`` and ``\\d`` only know ASCII, so the classes below spell
out the Unicode meaning.  They read the same in Java and RE2.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
NOT_SPACE = rf"[^{SPACE}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
# Everything that cleaning turns into blanks: no word character, or a digit.
DROPPED = r"[^\p{L}\p{Nl}\p{No}_]"
# A run of it, unless the run is a lone blank, which can stay as it is.
DROPPED_RUN = rf"[^ \p{{L}}\p{{Nl}}\p{{No}}_]{DROPPED}*| {DROPPED}+"

# The same blanks as a plain list, for trimming.
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def text_of(col: Column) -> Column:
    """The column as text, where a missing value reads ``nan``."""
    return F.coalesce(col, F.lit(fixed.MISSING_TEXT))


def strip(col: Column) -> Column:
    """Trim Unicode white space (``trim`` alone only knows the blank)."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def contains_any(col: Column, phrases) -> Column:
    """True where the text holds one of the phrases as a substring.

    A chain of substring searches stays in generated code and stops at the
    first hit; it is much faster than one regex alternation on long texts.
    """
    hit = F.lit(False)
    for phrase in _shortest(phrases):
        hit = hit | col.contains(phrase)
    return hit


def _shortest(phrases) -> list[str]:
    """The phrases that hold no other one, which would be found with them."""
    phrases = list(dict.fromkeys(phrases))
    return [p for p in phrases if not any(q != p and q in p for q in phrases)]


def count_phrases(col: Column, phrases) -> Column:
    """Number of distinct phrases that occur as a substring."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + col.contains(phrase).cast("int")
    return total


def has_words(clean: Column, phrases) -> Column:
    """True where *cleaned* text holds a phrase between word bounds.

    Cleaned text is words parted by single blanks, so a word bound is a blank
    or an end: a plain search on the padded text needs no regex.  The bare
    phrases are looked for first; most texts hold none.
    """
    padded = F.concat(F.lit(" "), clean, F.lit(" "))
    bounded = contains_any(padded, [f" {phrase} " for phrase in phrases])
    return contains_any(clean, phrases) & bounded


def matches_word(col: Column, words) -> Column:
    """Word-bounded match on raw text; for short fields."""
    return col.rlike(rf"(^|{NOT_WORD})({'|'.join(words)})($|{NOT_WORD})")


def count_blank_separated(col: Column) -> Column:
    """Number of tokens between Unicode white space."""
    return F.regexp_count(col, F.lit(f"{NOT_SPACE}+")).cast("int")


def has_more_tokens(col: Column, count: int) -> Column:
    """Whether a text has more blank-separated tokens than ``count``; reads no
    further than it must."""
    blank = f"[{SPACE}]"
    return col.rlike(f"^{blank}*+(?:{NOT_SPACE}++{blank}++){{{max(count, 0)}}}+{NOT_SPACE}")


def count_words(col: Column) -> Column:
    """Number of runs of word characters; 0 for a missing text."""
    return F.coalesce(F.regexp_count(col, F.lit(f"{WORD}+")), F.lit(0)).cast("int")


def count_clean_words(clean: Column) -> Column:
    """As :func:`count_words`, on cleaned text, by counting its blanks."""
    blanks = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))
    return F.when(clean == "", 0).otherwise(blanks + 1).cast("int")


def add_clean_text(df: DataFrame, source: str, name: str) -> DataFrame:
    """Lowercase; drop links, mail addresses, digits and punctuation.

    One pass turns each run of digits, punctuation and white space into one
    blank.  The mail pattern is anchored at the start of a token and possessive,
    so a long token without ``@`` costs linear time, not quadratic.  Links and
    addresses are only looked for where a cheap search finds their marker.  Each
    step is a column, since the next one reads it more than once.
    """
    text = F.col(name)
    df = df.withColumn(name, F.lower(F.coalesce(F.col(source), F.lit(""))))
    linked = text.contains("http") | text.contains("www")
    unlinked = F.regexp_replace(text, f"(?:http|www){NOT_SPACE}+", " ")
    df = df.withColumn(name, F.when(linked, unlinked).otherwise(text))
    mail = rf"(?<!{NOT_SPACE}){NOT_SPACE}[^{SPACE}@]*+@{NOT_SPACE}+"
    unmailed = F.regexp_replace(text, mail, " ")
    df = df.withColumn(name, F.when(text.contains("@"), unmailed).otherwise(text))
    return df.withColumn(name, F.btrim(F.regexp_replace(text, DROPPED_RUN, " ")))


def _without_marks(char: str) -> str:
    return "".join(
        c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
    )


@cache
def accent_table() -> tuple[str, str, str]:
    """Letters whose plain form is one word character, those forms, and a regex
    class of the word characters that decompose in any other way."""
    plain_from, plain_to, several = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char)[0] not in "LN":
            continue
        bare = _without_marks(char)
        if bare == char:
            continue
        if len(bare) == 1 and unicodedata.category(bare)[0] in "LN":
            plain_from.append(char)
            plain_to.append(bare)
        elif several and several[-1][1] == code - 1:
            several[-1][1] = code
        else:
            several.append([code, code])
    spans = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in several)
    # The look-ahead spares ASCII characters the comparison with every span.
    return "".join(plain_from), "".join(plain_to), rf"(?=[^\x{{0}}-\x{{7f}}])[{spans}]"


def falls_apart(col: Column) -> Column:
    """Whether a text has a character whose plain form is several characters
    (ligatures, fractions, Hangul); few have."""
    is_ascii = F.octet_length(col) == F.length(col)
    return ~is_ascii & col.rlike(accent_table()[2])


def without_accents(col: Column) -> Column:
    """Letters of one character in their plain form; in the JVM."""
    one, bare, _ = accent_table()
    is_ascii = F.octet_length(col) == F.length(col)
    return F.when(is_ascii, col).otherwise(F.translate(col, one, bare))


def decomposed(col: Column) -> Column:
    """Compatibility decomposition without combining marks, by Arrow batch; for
    the texts that ``falls_apart`` finds."""

    # Nested, so that it travels to the workers by value.
    def bare(value):
        parts = unicodedata.normalize("NFKD", value)
        return "".join(c for c in parts if not unicodedata.combining(c))

    @F.pandas_udf("string")
    def decompose(texts: pd.Series) -> pd.Series:
        return texts.map(bare, na_action="ignore")

    return decompose(col)


def words(col: Column) -> Column:
    """Array of the runs of two or more word characters."""
    return F.regexp_extract_all(col, F.lit(f"{WORD}{{2,}}"), F.lit(0))


def words_of_clean(col: Column) -> Column:
    """As :func:`words`, on text that is words parted by single blanks."""
    return F.filter(F.split(col, " "), lambda word: F.length(word) >= 2)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a blank."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
