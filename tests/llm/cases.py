"""Small tables that hold the hard cases: nulls, empty and long texts, ties, repeated
rows, other columns with clashing names."""

import random

BLANKS = " \t\n\x0b\f\r"


def texts(seed=0, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "and", "été", "über", "naïve", "漢字", "x1", "foo's", "<|im_end|>", "<|endoftext|>", "a" * 90,
             "end.", "ok,", "###", "a|b", "|", "▁", "ﬁn", "😀", "é", "1234567890", "K"]
    gaps = [" ", " ", " ", " ", "  ", "\n", "\n", "\t", " \n", "\r\n", "\x0b", " ", "\x1c"]
    out = ["", " ", "\n", "\n\n", "one", "...", "12 34", "All rights reserved.\n  ALL RIGHTS RESERVED.  \nx"]
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 60))))
    out.append("long " * 30_000)
    out.append("y" * 50_000)
    out.append("line of many\n" * 3_000)
    out += out[8:20] * 2
    return out


def documents(spark, extra=True):
    """Rows (doc_id, text) with null ids, null texts, repeated rows and ids, and, if
    `extra`, other columns that bear the names of results."""
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, "no id here"), (None, None), (900, None), (901, None), (7, "another text for seven"), rows[10], rows[10]]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string"), rows
    full = [(i, t, "en", 1.5, 3, "s", 7) for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, score double, shard int, slot string, n_lines int"), rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def multiset(rows):
    return sorted(map(repr, rows))
