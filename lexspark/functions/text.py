"""The text model: fold, tokenise, cut key words.

A token is a maximal run of letters or digits, lower-cased, without accents.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
# The same run in unfolded text: a combining mark inside a word belongs to it.
RAW_TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"
WORD = r"[\p{L}\p{N}_]+"
MARKS = r"\p{Mn}"


def _accent_pairs() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letters, by Unicode decomposition."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and base.isascii():
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_pairs()

# Spanish words of four or more letters, and some shorter, that
# carry no meaning in a title.
STOP_WORDS = (
    "para", "como", "esta", "este", "esto", "sobre", "entre", "hacia",
    "desde", "cuando", "donde", "porque", "segun", "ante", "bajo",
    "contra", "por", "con", "sin", "del", "las", "los", "una",
    "uno", "que", "sus", "ser", "son", "haya", "hay",
)
KEYWORD_MIN_LENGTH = 4
KEYWORD_LIMIT = 8


def fold(c: Column) -> Column:
    """Lower-case without accents, composed or combining."""
    return F.translate(F.regexp_replace(F.lower(c), MARKS, ""), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Folded tokens in order; NULL text has none."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def keywords(c: Column, limit: int | None = KEYWORD_LIMIT) -> Column:
    """Significant words of a title, accents and repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    kept = F.filter(
        words,
        lambda w: (F.length(w) >= KEYWORD_MIN_LENGTH) & ~w.isin(*STOP_WORDS),
    )
    return kept if limit is None else F.slice(kept, 1, limit)


def contains_folded(haystack: Column, needle: Column) -> Column:
    """Literal substring test that ignores case and accents on both sides."""
    return F.contains(fold(F.coalesce(haystack, F.lit(""))), fold(needle))
