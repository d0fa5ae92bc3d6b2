"""Line-first cleaning: rules drop lines, then documents that lose too much go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexspark.llm.common import BLANKS, kept_columns, with_columns

# The characters that count as symbols and as punctuation marks.
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Boilerplate phrases, lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use of cookies", "uses cookies", "enable javascript", "lorem ipsum",
    "click here", "sign up for", "subscribe to our", "skip to content", "powered by",
)
#: Words that a boilerplate line has at most; a phrase inside longer prose stays.
SHORT_LINE = 30
#: Words from which a line without any of .!?,;: is no prose.
LONG_LINE = 20
MIN_WORDS = 50

_boilerplate = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_stops = re.compile(rb"[.!?,;:]")


def line_fault(line: bytes, words: int) -> str | None:
    """The first rule that a line with words breaks: `navigation`, at least two bars and
    one for every four words; `punctuation`, more than five marks for every four
    words, or a long line without any stop; `boilerplate`, a known phrase in a short line."""
    bars = line.count(b"|")
    if bars >= 2 and 4 * bars >= words:
        return "navigation"
    marks = len(line) - len(line.translate(None, MARKS.encode()))
    if 4 * marks > 5 * words or (words >= LONG_LINE and not _stops.search(line)):
        return "punctuation"
    if words <= SHORT_LINE and _boilerplate.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    size = len(numbers)
    pair = ids[:-2] * size + ids[1:-1]
    if size > 1 << 20:  # keep the next product within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * size + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    inside = np.zeros(len(words), bool)
    for at in (order[:-1][same], order[1:][same]):
        for i in range(3):
            inside[at + i] = True
    return int(inside.sum())


MADE = ("text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, kept_words long, n_navigation long, n_punctuation long, n_boilerplate long, "
          "base_failed boolean, kept boolean")


def examine(text: str | None) -> tuple:
    """The columns of MADE for one text."""
    text = text or ""
    data = text.encode()
    lines = data.split(b"\n")
    # bytes.split() parts at [\x20\x09-\x0D].
    per_line = [line.split() for line in lines]
    words = [w for line in per_line for w in line]
    seen: set[bytes] = set()
    faults = {"navigation": 0, "punctuation": 0, "boilerplate": 0}
    good, left, repeats = [], 0, 0
    for line, own in zip(lines, per_line, strict=True):
        if own:
            repeats += line in seen
            seen.add(line)
            if fault := line_fault(line, len(own)):
                faults[fault] += 1
                continue
            left += len(own)
        good.append(line)
    n = len(words)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > 50 * n
    kept = not failed and 2 * left >= n
    blanks = len(data) - len(data.translate(None, BLANKS.encode()))
    symbols = len(data) - len(data.translate(None, SYMBOLS.encode()))
    return (b"\n".join(good).decode(), n, len(text) - blanks, symbols, repeats, repeated, left,
            *faults.values(), failed, kept)


def clean(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row of `docs` (with a column text) with its cleaned text, its counts and
    the verdict `kept`; of its other columns those in `keep`, all without it.

    Rules look at each line with a word; lines that break one are dropped, blank
    lines stay. A document is rejected if it fails the base rules (under 50 words, or
    over half of its words in repeated windows of three) or if less than half of its
    words are left. A null text counts as empty: no words, rejected. Texts are read
    whole, each by itself, so ties and repeated rows need no rule; an empty table
    gives no rows. Columns with the names of the new ones are replaced. Nothing is
    shuffled.
    """
    made = to_arrow_schema(StructType.fromDDL(MADE))
    names, ddl = kept_columns(docs, keep, made.names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield from with_columns(b, names, examine, made)

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, "text"])]).mapInArrow(run, f"{ddl}, {MADE}" if ddl else MADE)
