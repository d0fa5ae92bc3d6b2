"""Spelling variants: words that one edit turns into a more frequent word.

Each word's edits are generated as hashes and probed against Bloom filters of the
vocabulary, sharded by length and broadcast a bounded number of bytes at a time. Only
edits that a filter lets through are written out and shuffled, to an exact join with
the vocabulary that removes the false ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import LOWER, UPPER, partitions, stored

RUN = r"[A-Za-zÀ-ÿ]+"
#: One occurrence in NOISE (by a hash of document and word) loses a code point.
NOISE = 97
MIN_CHARS, MIN_COUNT = 5, 3
#: A form is at least so many times as frequent as its word.
TIMES = 2
#: Bits of a filter for each word. A block is eight numbers of 64 bits, in each of which
#: a word sets one bit; about six words in ten thousand pass by chance.
BITS = 16
#: Words of one filter at most, and bytes of the filters that are broadcast together:
#: further lengths (and parts of a length) take further rounds, whatever the vocabulary.
SHARD, ROUND = 1 << 20, 32 << 20
#: Edits that are hashed at a time.
CELLS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the runs of letters of `docs` (doc_id, text; other columns are not read)
    that have `min_chars` code points or more, with the number of their occurrences, of
    at least `min_count`.

    A-Z are lower-cased. If NOISE divides crc32("<doc_id>:<run>"), the run's code point
    crc32 % length is deleted first. A null text has no runs, a null doc_id is the empty
    string. Every row counts, also if rows are equal; an empty table has no words.
    """
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")
    found = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs)
    found = found.where(F.length("run") >= min_chars)
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    found = found.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % NOISE == 0, less).otherwise(F.col("run")).alias("word")
    counted = found.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Blocks:
    """A blocked Bloom filter: a hash names a block, and a bit in each of its numbers."""

    WORDS = 8

    def __init__(self, blocks: int, bits: np.ndarray | None = None):
        self.blocks = blocks
        self.bits = np.zeros(blocks * self.WORDS, np.uint64) if bits is None else bits

    @staticmethod
    def for_words(n: int) -> "Blocks":
        return Blocks(max(1, -(-n * BITS // (64 * Blocks.WORDS))))

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = (hashes >> np.uint64(40)) * np.uint64(self.blocks) >> np.uint64(24)
        return block.astype(np.int64) * self.WORDS, _mixed(hashes ^ np.uint64(_BASE))

    def add(self, hashes: np.ndarray) -> None:
        at, own = self._at(hashes)
        for i in range(self.WORDS):
            np.bitwise_or.at(self.bits, at + i, np.uint64(1) << (own >> np.uint64(6 * i) & np.uint64(63)))

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Places in `hashes` of what may have been added."""
        at, own = self._at(hashes)
        left = np.arange(len(hashes))
        for i in range(self.WORDS):
            bit = own[left] >> np.uint64(6 * i) & np.uint64(63)
            left = left[self.bits[at[left] + i] >> bit & np.uint64(1) == 1]
        return left


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of the filters of its length a hash belongs to; by other bits than its block."""
    return (hashes & np.uint64(0xFFFFFF)) * np.uint64(parts) >> np.uint64(24)


def _by_length(words: list[str]) -> Iterator[list[str]]:
    """Words of one length together, at most about CELLS code points at a time."""
    of: dict[int, list[str]] = {}
    for w in words:
        of.setdefault(len(w), []).append(w)
    for n, own in sorted(of.items()):
        step = max(1, CELLS // n)
        for at in range(0, len(own), step):
            yield own[at: at + step]


def _hashes(codes: np.ndarray) -> np.ndarray:
    return (codes * _powers(codes.shape[1])).sum(1, dtype=np.uint64)


def filters(words: DataFrame, parts: dict[int, int], chosen: list[tuple[int, int]]) -> dict[tuple[int, int], Blocks]:
    """The filters of the `chosen` shards (length, part), each built in one task from the
    words of its own; a shard's words are SHARD or about so many at most."""
    schema = pa.schema([("length", pa.int32()), ("part", pa.int32()), ("blocks", pa.int32()), ("bits", pa.binary())])
    wanted = set(chosen)

    def key(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for own in _by_length(batch.column("word").to_pylist()):
                h = _mixed(_hashes(_codes(own)))
                n, part = len(own[0]), _part(h, parts[len(own[0])]).astype(np.int32)
                take = np.array([(n, int(p)) in wanted for p in range(parts[n])])[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(take.sum(), n, np.int32)), pa.array(part[take]), pa.array(h[take].view(np.int64))],
                    names=["length", "part", "h"])

    def build(group: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("h").to_numpy(zero_copy_only=False).view(np.uint64) for b in rows]
        made = Blocks.for_words(sum(map(len, held)))
        for h in held:
            made.add(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array([group[0].as_py()], pa.int32()), pa.array([group[1].as_py()], pa.int32()),
             pa.array([made.blocks], pa.int32()), pa.array([made.bits.tobytes()])], schema=schema)

    made = words.select("word").mapInArrow(key, "length int, part int, h long").groupBy("length", "part").applyInArrow(
        build, "length int, part int, blocks int, bits binary")
    return {(r.length, r.part): Blocks(r.blocks, np.frombuffer(r.bits, np.uint64)) for r in made.collect()}


def edits(words: list[str], alphabet: np.ndarray, probe) -> Iterator[tuple[str, str]]:
    """(word, edit) of those edits of `words` that probe(length, hashes) lets through.

    Edits are deletions, and replacements by a later letter of `alphabet`: two words one
    edit apart are a deletion or a replacement of one another in one direction, so none
    is missed without the insertions.
    """
    for own in _by_length(words):
        codes = _codes(own)
        m, n = codes.shape
        powers = _powers(n)
        terms = codes * powers
        whole = terms.sum(1, dtype=np.uint64)
        # Without code point i, those behind it move down one power. Of equal neighbours one goes.
        before = np.cumsum(terms, 1, dtype=np.uint64) - terms
        behind = (whole[:, None] - before - terms) * np.uint64(_INVERSE)
        first = np.ones((m, n), bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(first)
        for k in probe(n - 1, _mixed((before + behind)[row, at])):
            w, i = own[row[k]], int(at[k])
            yield w, w[:i] + w[i + 1:]
        for letter in alphabet:
            row, at = np.nonzero(codes < letter)
            if len(row):
                h = whole[row] + (np.uint64(letter) - codes[row, at]) * powers[at]
                for k in probe(n, _mixed(h)):
                    w, i = own[row[k]], int(at[k])
                    yield w, w[:i] + chr(letter) + w[i + 1:]


_EDIT = pa.schema([("word", pa.string()), ("edit", pa.string())])


def proposed(words: DataFrame, alphabet: np.ndarray, found: dict, parts: dict[int, int]) -> DataFrame:
    """word, edit: the edits that the filters `found` let through."""
    told = words.sparkSession.sparkContext.broadcast(found)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = told.value

        def probe(length: int, hashes: np.ndarray) -> np.ndarray:
            own = [p for p in range(parts.get(length, 0)) if (length, p) in shards]
            if len(own) == parts.get(length, 0) == 1:
                return shards[length, 0].probe(hashes)
            of = _part(hashes, parts[length]) if own else None
            places = [np.flatnonzero(of == p) for p in own]
            return np.concatenate([x[shards[length, p].probe(hashes[x])] for p, x in zip(own, places)] or [np.zeros(0, np.int64)])

        for batch in rows:
            held, size = [], 0
            for w, e in edits(batch.column("word").to_pylist(), alphabet, probe):
                held.append((w, e))
                size += len(w) + len(e) + 32
                if size > 4 << 20:
                    yield _pairs(held)
                    held, size = [], 0
            if held:
                yield _pairs(held)

    return words.select("word").mapInArrow(run, "word string, edit string")


def _pairs(held: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=_EDIT)


def near(words: DataFrame) -> DataFrame:
    """a, b: the words (of `words`: word, n) that differ by one inserted, deleted or
    replaced code point, each pair in both directions."""
    spark = words.sparkSession
    lengths = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # The letters are those of RUN, a hundred at most.
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint64)
    parts = {length: -(-n // SHARD) for length, n in lengths.items()}
    shards = [(length, p) for length in sorted(lengths) for p in range(parts[length])]
    size = lambda s: lengths[s[0]] * BITS // 8 // parts[s[0]] + 1
    rounds: list[list[tuple[int, int]]] = []
    room = 0
    for s in shards:
        if size(s) > room:
            rounds.append([])
            room = ROUND
        rounds[-1].append(s)
        room -= size(s)
    spread = stored(words.select("word").repartition(partitions(spark), "word"), "words")
    pairs = spark.createDataFrame([], "a string, b string")
    for chosen in rounds:
        maybe = proposed(spread, alphabet, filters(spread, parts, chosen), parts).withColumnRenamed("word", "a")
        exact = stored(maybe.join(spread.withColumnRenamed("word", "edit"), "edit").select("a", F.col("edit").alias("b")), "near")
        pairs = pairs.unionByName(exact)
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every row of `forms` (word, form): where its chain of forms ends.

    Chains are halved in each round by jumping over what is known; a form is TIMES as
    frequent as its word, so a chain is no longer than the logarithm of a count.
    """
    step = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(step.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not after.where("moved").head(1):
            return step
        step = after.drop("moved")


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of `words` (word: distinct, n).

    A word's form is the near word of the largest n (ties: the smallest in code-point
    order), if that is TIMES the word's n or more, else null; root is where forms lead,
    the word itself without one. A table without words gives no rows.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    counted = near(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form")))
    about = counted.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(about, "word", "left")
    found = -F.col("best.less") >= TIMES * F.col("n")
    formed = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, F.col("best.form")).alias("form"),
        F.when(found, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
