"""String expressions for names, addresses and free text.

Every function takes a Column (or a column name) and gives a Column; null in gives null out unless stated.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that keep a short ending from being stripped.
PREPOSITIONS = (
    "of in to for with on at by from about as into like through after over between out against during without "
    "before under around among and"
).split()
# Texts that count as missing.
SENTINELS = ("", "nan", "None")

_SPACED = "".join(c for c in string.punctuation if c not in ".,")
WORD = r"[\p{L}\p{N}_]{2,}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]+", " "))


def spell_ampersand(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("&"), F.lit(" AND "))


def drop_punctuation(c: Column | str) -> Column:
    """Full stops and commas vanish, any other ASCII punctuation becomes a space."""
    return F.translate(col(c), _SPACED + ".,", " " * len(_SPACED))


def clean_name(c: Column | str) -> Column:
    return squeeze(drop_punctuation(spell_ampersand(c)))


def normal_form(c: Column | str) -> Column:
    """Lower case; full stops and commas vanish; what is neither letter nor digit separates words."""
    bare = F.regexp_replace(F.lower(col(c)), "[.,]", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def words(c: Column | str) -> Column:
    """Space-separated words of an already squeezed text; the empty text has none."""
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(col(c), " "))


def last_words(c: Column | str, k: int) -> Column:
    """The last k words joined by a space; a shorter text gives all it has."""
    w = words(c)
    n = F.size(w)
    return F.array_join(F.slice(w, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), " ")


def without_last_words(c: Column | str, k: int) -> Column:
    """The text without its last k words; empty if it has no more than k."""
    w = words(c)
    n = F.size(w)
    return F.when(n > k, F.array_join(F.slice(w, F.lit(1), F.greatest(n - k, F.lit(0))), " ")).when(col(c).isNotNull(), "")


def words_after_preposition(c: Column | str, prepositions: Sequence[str] = PREPOSITIONS) -> Column:
    """How many words follow the last preposition; null without one."""
    is_prep = F.transform(words(c), lambda w: F.lower(w).isin(*prepositions))
    place = F.array_position(F.reverse(is_prep), True)
    return F.when(place > 0, place - 1)


def residual_length(c: Column | str, k: int) -> Column:
    return F.length(without_last_words(c, k))


def removed_text(old: Column | str, new: Column | str) -> Column:
    """What remains of old when every occurrence of new is taken out; null if nothing."""
    return F.nullif(F.trim(F.replace(col(old), col(new), F.lit("")), F.lit("()")), F.lit(""))


def nth_word_from_right(c: Column | str, n: int) -> Column:
    """1 is the last word; null where the text has fewer."""
    return F.try_element_at(F.split(F.nullif(F.trim(col(c)), F.lit("")), " +"), F.lit(-n))


def is_present(c: Column | str, sentinels: Sequence[str] = SENTINELS) -> Column:
    return col(c).isNotNull() & ~col(c).isin(*sentinels)


def first_character(c: Column | str) -> Column:
    return F.nullif(F.substring(col(c), 1, 1), F.lit(""))


def digit_runs(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(\p{Nd}+)"), 1)


def word_tokens(c: Column | str) -> Column:
    """Runs of two or more letters, digits or underscores, case kept."""
    return F.regexp_extract_all(col(c), F.lit(f"({WORD})"), 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def counted(tokens: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> of the different tokens, by a sort within the row; empty without a token."""
    empty = F.array().cast("array<struct<term:string,tf:bigint>>")

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        pair = lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(f, k + 1), n + 1) - i).cast("long").alias("tf")))
        return F.when(n > 0, let(starts, pair)).otherwise(empty)

    return let(F.sort_array(tokens), runs)


def ngrams(tokens: Column, low: int, high: int, joiner: str = " ") -> Column:
    """All runs of low to high neighbouring tokens."""

    def of(bound: Column, n: int) -> Column:
        count = F.size(bound) - n + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(bound, i, n), joiner))
        return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)]))


def word_ngrams(c: Column | str, low: int = 2, high: int = 3, stop_words: Sequence[str] = ()) -> Column:
    """Word n-grams after removal of stop words, which are compared case-sensitively."""
    tokens = word_tokens(c)
    if stop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(*stop_words))
    return ngrams(tokens, low, high)


def char_ngrams(c: Column | str, n: int = 2, lower: bool = True) -> Column:
    """Character n-grams of the text with runs of two or more white spaces made one."""
    text = F.regexp_replace(F.lower(col(c)) if lower else col(c), r"(?U)\s\s+", " ")

    def grams(t: Column) -> Column:
        count = F.length(t) - n + 1
        some = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(count >= 1, some).when(t.isNotNull(), F.array().cast("array<string>"))

    return let(text, grams)


def affix_trigrams(c: Column | str, affixes: Sequence[str], weight: int = 10, last: float = 0.5, first: float = 0.75) -> Column:
    """Character trigrams per word, words padded by their place, repeated by weight; common affixes weigh less at the ends."""

    def one(word: Column, i: Column, n: Column) -> Column:
        padded = F.when(i == 0, F.concat(word, F.lit(" "))).when(i == n - 1, F.concat(F.lit(" "), word)).otherwise(F.concat(F.lit(" "), word, F.lit(" ")))
        common = word.isin(*affixes) if affixes else F.lit(False)
        factor = F.when(common & (i == n - 1), last).otherwise(1.0) * F.when(common & (i == 0), first).otherwise(1.0)
        times = F.floor(factor * weight + 1e-9).cast("int")
        return F.flatten(F.transform(char_ngrams(padded, 3, lower=False), lambda g: F.array_repeat(g, times)))

    return let(words(squeeze(c)), lambda w: F.flatten(F.transform(w, lambda word, i: one(word, i, F.size(w)))))


def hover_text(node: Column | str, columns: Sequence[str]) -> Column:
    """Label of a plotted node: its number, then one line per column."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.concat_ws("<br>", F.concat(F.lit("Node: "), col(node).cast("string")), *lines)
