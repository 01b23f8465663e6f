"""Scalar text functions as JVM-side Column expressions (no Python per row).

Python's ``str.strip`` / ``\\w`` are Unicode aware, Spark's ``trim`` and Java's
plain ``\\w`` are not, so the classes are spelled out with ``(?U)`` and
Unicode properties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour):
# characters kept by normalisation are letters, numbers, underscore, whitespace
KEEP_CLASS = r"[^\p{L}\p{N}_\s\x1C-\x1F]"
# whitespace: Unicode's, and the four separators that text stripping counts too
SPACE = r"[\s\x1C-\x1F]"
# ASCII punctuation set of the unused `preprocess_text` helper
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# boolean text tokens
TRUE_TOKENS = ("true", "1", "yes", "y", "t")
FALSE_TOKENS = ("false", "0", "no", "n", "f")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.regexp_replace(_c(x), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize(x) -> Column:
    """Cast to text, strip, lower-case, drop every non-word, non-space char."""
    return F.regexp_replace(F.lower(strip(_c(x).cast("string"))), "(?U)" + KEEP_CLASS, "")


def strip_ascii_punct(x) -> Column:
    """Lower, strip, delete the ASCII punctuation set (underscore too)."""
    return F.translate(F.lower(strip(_c(x).cast("string"))), ASCII_PUNCTUATION, "")


def words(x) -> Column:
    """Whitespace split of the stripped text, no empty tokens."""
    s = strip(_c(x))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, rf"(?U){SPACE}+"))


def word_count(x) -> Column:
    return F.size(words(x))


def blank_to_null(x) -> Column:
    """A value that is empty or only whitespace becomes NULL."""
    c = _c(x)
    return F.when(strip(c) == "", F.lit(None).cast("string")).otherwise(c)


def is_numeric_text(x, signed: bool = False) -> Column:
    """Digits after removing one dot ('5.' and '.5' yes, '-5', '1e5', '.' no).
    ``signed=True`` (D9 option) also accepts a leading sign and an exponent."""
    if signed:
        return _c(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return _c(x).rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")


def fill_text(x) -> Column:
    """NULL to '' and everything as text."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def to_bool(x) -> Column:
    """Text to boolean; anything else raises at run time."""
    s = F.lower(strip(_c(x).cast("string")))
    return (F.when(s.isin(*TRUE_TOKENS), F.lit(True))
            .when(s.isin(*FALSE_TOKENS), F.lit(False))
            .otherwise(F.raise_error(F.concat(s, F.lit(" is not a boolean token"))).cast("boolean")))


def sorted_tokens(x) -> Column:
    """Word-sorted text (used by token_sort scorers)."""
    return F.array_join(F.array_sort(words(x)), " ")


def char_ngrams(x, n_min: int = 2, n_max: int = 4) -> Column:
    """All character n-grams of length n_min..n_max over the whole string."""
    s = _c(x)
    L = F.length(s)
    grams = F.transform(
        F.sequence(F.lit(n_min), F.lit(n_max)),
        lambda n: F.when(L >= n, F.transform(F.sequence(F.lit(1), L - n + 1),
                                             lambda i: F.substring(s, i, n)))
        .otherwise(F.array().cast("array<string>")),
    )
    return F.flatten(grams)
