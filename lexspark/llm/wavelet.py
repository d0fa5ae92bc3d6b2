"""Token shards as wavelet matrices: access, counting and occurrence lookup in place.

A shard is one Parquet file. Its rows are segments of whole documents in ascending
doc_id order; a segment's ids are a wavelet matrix: one bit-plane per bit of an id,
highest first, each with a directory of ones every 512 bits. Planes are compressed
by Parquet, and a lookup reads only the columns that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexspark.llm.common import batches, partitions, texts_of
from lexspark.llm.tokens import encoder

BLOCK = 512
#: Tokens of a segment, unless one document is longer.
SEGMENT = 1 << 20
FORMAT = ("part int, segment int, start long, n_tokens long, doc_ids array<long>, lengths array<int>, "
          "bits int, zeros array<long>, planes array<binary>, ones array<binary>")


class WaveletMatrix:
    """A sequence of ids below 2**bits with access, rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ones: list[bytes]):
        self.n, self.zeros, self.bits = n, zeros, len(planes)
        self._planes = [np.frombuffer(p, np.uint8) for p in planes]
        self._ones = [np.frombuffer(o, "<u4") for o in ones]

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> "WaveletMatrix":
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ones = [], [], []
        for level in range(bits - 1, -1, -1):
            set_ = (row & row.dtype.type(1 << level)) != 0
            packed = np.packbits(set_)
            counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8)))).reshape(-1, BLOCK // 8)
            ones.append(np.concatenate([[0], counts.sum(1, dtype=np.int64).cumsum()]).astype("<u4").tobytes())
            planes.append(packed.tobytes())
            low = row.compress(~set_)
            zeros.append(len(low))
            row = np.concatenate([low, row.compress(set_)])
        return WaveletMatrix(len(ids), zeros, planes, ones)

    def rows(self) -> tuple[list[bytes], list[bytes]]:
        return [p.tobytes() for p in self._planes], [o.tobytes() for o in self._ones]

    def _bit(self, level: int, at: int) -> int:
        return int(self._planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def _rank(self, level: int, at: int) -> int:
        """Ones before position `at` of a plane."""
        block, plane = at // BLOCK, self._planes[level]
        count = int(self._ones[level][block])
        count += int(np.bitwise_count(plane[block * BLOCK // 8: at >> 3]).sum())
        if at & 7:
            count += (int(plane[at >> 3]) >> (8 - (at & 7))).bit_count()
        return count

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit, one = self._bit(level, at), self._rank(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + one if bit else at - one
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token in [begin, end) lie below the last plane."""
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            b, e = self._rank(level, begin), self._rank(level, end)
            if token >> (self.bits - 1 - level) & 1:
                begin, end = self.zeros[level] + b, self.zeros[level] + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences in [begin, end)."""
        b, e = self._range(token, begin, self.n if end is None else end)
        return e - b

    rank = count

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        ones = self._ones[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        here = self._planes[level][block * BLOCK // 8: (block + 1) * BLOCK // 8]
        return block * BLOCK + int(np.flatnonzero(np.unpackbits(here) == bit)[k - before[block]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token."""
        begin, end = self._range(token, 0, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        at = begin + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, as unsigned 32-bit integers."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            set_ = np.unpackbits(self._planes[level], count=self.n).view(bool)
            above = np.empty_like(row)
            above[np.flatnonzero(~set_)] = row[: self.zeros[level]]
            above[np.flatnonzero(set_)] = row[self.zeros[level]:] | row.dtype.type(1 << (self.bits - 1 - level))
            row = above
        return row.astype("<u4")


def _segments(rows: Iterator[tuple[int | None, bytes]], bits: int, size: int) -> Iterator[tuple]:
    part, segment, start = TaskContext.get().partitionId(), 0, 0
    docs, held, n = [], [], 0

    def close():
        matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"), bits)
        planes, ones = matrix.rows()
        return (part, segment, start, n, [d for d, _ in docs], [k for _, k in docs], bits, matrix.zeros, planes, ones)

    for doc, ids in rows:
        if docs and n + len(ids) // 4 > size:
            yield close()
            segment, start = segment + 1, start + n
            docs, held, n = [], [], 0
        docs.append((doc, len(ids) // 4))
        held.append(ids)
        n += len(ids) // 4
    if docs:
        yield close()


def write_shards(docs: DataFrame, path: str, tokenizer: str, segment: int = SEGMENT, added: bool = False) -> None:
    """Encode `docs` (doc_id, text; other columns are not read) and write shards.

    Every text is encoded whole and closed by id 0; a null or empty text is that id
    alone; `added`: see tokens.Encoder. Documents are ordered by doc_id, a null one first; rows that share a
    doc_id stay apart, ordered by a hash of their text. Texts, not ids, are dealt
    to ranges, so that encoding runs once and after the only shuffle. An empty
    table gives a folder without segments.
    """
    spark = docs.sparkSession
    bits = max(1, (encoder(tokenizer).size - 1).bit_length())
    schema = to_arrow_schema(StructType.fromDDL(FORMAT))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer, added), bytes(4)
        rows = ((d, code.encode(t) + end) for b in parts for d, t in texts_of(b))
        yield from batches(_segments(rows, bits, segment), schema, lambda r: sum(map(len, r[8])))

    keys = [F.col("doc_id"), F.xxhash64("text")]
    (
        docs.select("doc_id", "text").repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
        .mapInArrow(write, FORMAT)
        .write.option("compression", "zstd").parquet(path)
    )


def _firsts(segments: DataFrame) -> DataFrame:
    """Ids before each shard; one row per shard."""
    return segments.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_first"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start` counted from the first id of the first shard."""
    segments = spark.read.schema(FORMAT).parquet(path)
    return segments.join(F.broadcast(_firsts(segments)), "part").withColumn(
        "start", F.col("start") + F.col("_first")).drop("_first")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for i in range(b.num_rows):
                    r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                    ids = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ones"]).decode()
                    at = 0
                    for doc, n in zip(r["doc_ids"], r["lengths"], strict=True):
                        yield doc, r["start"] + at, n, ids[at: at + n].tobytes()
                        at += n

        yield from batches(rows(), schema, lambda r: len(r[3]))

    return read_segments(spark, path).drop("part", "segment", "bits").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")


def occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, position (from the first id of all): every occurrence of the given ids,
    found by count and select on the planes; nothing is decoded."""
    schema = pa.schema([("token", pa.int64()), ("position", pa.int64())])

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for r in b.to_pylist():
                    m = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ones"])
                    for t in sorted(set(tokens)):
                        for k in range(m.count(t)):
                            yield t, r["start"] + m.select(t, k)

        yield from batches(rows(), schema, lambda r: 16)

    return read_segments(spark, path).select("start", "n_tokens", "zeros", "planes", "ones").mapInArrow(
        find, "token long, position long")


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """position, token for positions counted from the first id of all; one that no
    segment holds is left out. Only segments that hold a position are read."""
    schema = pa.schema([("position", pa.int64()), ("token", pa.int64())])
    wanted = sorted(set(positions))

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for r in b.to_pylist():
                    m = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ones"])
                    for p in wanted[np.searchsorted(wanted, r["start"]): np.searchsorted(wanted, r["start"] + m.n)]:
                        yield p, m.access(p - r["start"])

        yield from batches(rows(), schema, lambda r: 16)

    held = F.exists(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<long>"),
                    lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    return read_segments(spark, path).where(held).select("start", "n_tokens", "zeros", "planes", "ones").mapInArrow(
        look, "position long, token long")
