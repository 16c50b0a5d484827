"""Text functions as Column builders: everything stays inside whole-stage code generation or Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of letters, digits and underscores of any script; Java's own \w knows ASCII only.
WORD = "[\\p{L}\\p{N}_]+"
SPACES = "[ \\t\\r\\n]+"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator isn't merged into what follows, as a projection would be, where a
    lambda that uses the value would compute it again for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(text: Column, lower: bool = True) -> Column:
    """array<string> of the words of a text; null for a null text."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(WORD), F.lit(0))


def word_grams(w: Column, n: int, drop_last: bool = False, sep: str = " ") -> Column:
    """Joined windows of n words; drop_last leaves the final window out. Fewer words give an empty array."""
    last = F.size(w) - n + (0 if drop_last else 1)
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), sep))


def hash32(s: Column) -> Column:
    """The first 32 bits of md5 as a number: the same in every engine, unlike the built-in hash functions."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def strip_punctuation(s: Column) -> Column:
    """Without the 32 punctuation characters of ASCII."""
    return F.regexp_replace(s, "[!-/:-@\\[-`{-~]", "")


def squeeze(s: Column) -> Column:
    """Pairs of spaces become one, in a single pass."""
    return F.replace(s, F.lit("  "), F.lit(" "))


def collapse(s: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(s, SPACES, " ")


def strip(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(s, "^[ \\t\\r\\n\\f\\x0b]+|[ \\t\\r\\n\\f\\x0b]+$", "")


def occurrences(s: Column, part: Column | str) -> Column:
    """How often part occurs in s without overlap; 0 for an empty part."""
    p = F.lit(part) if isinstance(part, str) else part
    return F.when(F.length(p) > 0, (F.length(s) - F.length(F.replace(s, p, F.lit("")))) / F.length(p)).otherwise(0).cast("bigint")


def digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", "")).cast("bigint")


def separators(s: Column) -> Column:
    """How many of . / _ - a string has."""
    return F.length(F.regexp_replace(s, "[^./_-]", "")).cast("bigint")


def average_word_length(s: Column) -> Column:
    """Floor of the mean length of the space-separated pieces; empty pieces count, as a split gives them."""
    parts = F.split(s, " ", -1)
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return F.floor(total / F.size(parts)).cast("bigint")


#: Keys of the two keyboard layouts at the same place.
LATIN = "qwertyuiop[]asdfghjkl;'zxcvbnm,."
CYRILLIC = "йцукенгшщзхъфывапролджэячсмитьбю"


def other_layout(s: Column) -> Column:
    """What was meant when typed on the other keyboard layout; the direction follows the first letter."""
    return F.when(F.lower(s).rlike("^[^a-zа-яё]*[а-яё]"), F.translate(F.lower(s), CYRILLIC, LATIN)).otherwise(F.translate(F.lower(s), LATIN, CYRILLIC))


def sigmoid(x: Column, clip: float = 0.0) -> Column:
    y = 1 / (1 + F.exp(-x))
    return F.greatest(F.least(y, F.lit(1 - clip)), F.lit(clip)) if clip else y


def logistic_cost(p: Column, y: Column) -> Column:
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters that two strings have in common from the beginning; null if either is null."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.left(a, k) == F.left(b, k))))
    return F.when(a.isNotNull() & b.isNotNull(), same).cast("bigint")


def scaled(values: Column, by: float = 255.0) -> Column:
    """An array's numbers divided by a constant."""
    return F.transform(values, lambda x: x / F.lit(by))
