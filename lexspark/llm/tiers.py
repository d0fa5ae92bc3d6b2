"""Packing into windows of several context sizes, without padding.

Documents are routed by length to tiers (context sizes), each tier is packed, gaps
of long windows are filled from shorter tiers, and finished windows are dealt to
step groups of equal token counts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexspark.llm.common import ROW_BITS, batches, texts_of
from lexspark.llm.tokens import encoder

TIERS = (128, 256, 512, 1024)
#: Tokens of a training step.
STEP = 8192
#: Documents' tails held by a task before they are packed: a bound on memory, at
#: most POOL * the longest tier. What does not fill a window waits for the next ones.
POOL = 4096

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, window int, step_group long")

# A piece is (length, number, doc_id, start, ids, doc_tokens); the number keeps pieces apart.


def _cut(piece: tuple, length: int, number: int) -> tuple[tuple, tuple]:
    _, n, doc, start, ids, total = piece
    return ((length, n, doc, start, ids[: 4 * length], total),
            (piece[0] - length, number, doc, start + length, ids[4 * length:], total))


class Packer:
    """Packs the documents of one task in the order they come."""

    def __init__(self, tiers: tuple[int, ...], step: int, base: int, pool: int = POOL):
        self.tiers, self.step, self.base, self.limit = tuple(sorted(tiers)), step, base, pool
        if any(t & (t - 1) for t in self.tiers) or step % self.tiers[-1]:
            raise ValueError("tiers are powers of two, a step a multiple of the longest")
        self.pool: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.open: dict[int, list[list[tuple]]] = {t: [] for t in self.tiers}
        self.held = self.numbers = self.windows = self.groups = 0
        self.done: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        total, longest, start = len(ids) // 4, self.tiers[-1], 0
        while total - start >= longest:
            self._finish(longest, [self._piece(longest, doc, start, ids, total)])
            start += longest
        if start < total:
            self._route(self._piece(total - start, doc, start, ids, total))
        if self.held >= self.limit:
            self._pack()

    def _piece(self, length: int, doc, start: int, ids: bytes, total: int) -> tuple:
        self.numbers += 1
        return length, self.numbers, doc, start, ids[4 * start: 4 * (start + length)], total

    def _route(self, piece: tuple) -> None:
        """To the shortest tier that holds the piece; each tier is kept in order of length."""
        tier = self.tiers[bisect_left(self.tiers, piece[0])]
        insort(self.pool[tier], piece, key=lambda p: p[:2])
        self.held += 1

    def _take(self, tier: int, at: int) -> tuple:
        self.held -= 1
        return self.pool[tier].pop(at)

    def _fitting(self, gap: int, tier: int) -> tuple | None:
        """The longest waiting piece of this or a shorter tier that fits into the gap."""
        for t in reversed([t for t in self.tiers if t <= tier]):
            at = bisect_right(self.pool[t], gap, key=lambda p: p[0])
            if at:
                return self._take(t, at - 1)
        return None

    def _pack(self) -> None:
        """Fill windows tier by tier, the shortest first, until the pieces that wait do
        not fill another one of their tier. So gaps of a longer tier get what the shorter
        ones cannot fill windows with themselves; rests of cut pieces go back to theirs."""
        made = True
        while made:
            made = False
            for tier in self.tiers:
                below = [t for t in self.tiers if t <= tier]
                while self.pool[tier] and sum(p[0] for t in below for p in self.pool[t][:tier]) >= tier:
                    self._window(tier, below)
                    made = True

    def _window(self, tier: int, below: list[int]) -> None:
        window = [self._take(tier, len(self.pool[tier]) - 1)]
        gap = tier - window[0][0]
        while gap:
            piece = self._fitting(gap, tier)
            if piece is None:  # all are longer: cut the shortest, its rest goes to its own tier
                least = next(t for t in below if self.pool[t])
                self.numbers += 1
                piece, rest = _cut(self._take(least, 0), gap, self.numbers)
                self._route(rest)
            window.append(piece)
            gap -= piece[0]
        self._finish(tier, window)

    def close(self) -> None:
        """Pack all that waits; the last tokens become windows of powers of two."""
        self._pack()
        rest = [p for t in reversed(self.tiers) for p in self.pool[t]]
        left = sum(p[0] for p in rest)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                piece = rest.pop(0)
                if piece[0] > gap:
                    self.numbers += 1
                    piece, after = _cut(piece, gap, self.numbers)
                    rest.insert(0, after)
                window.append(piece)
                gap -= piece[0]
            self._finish(size, window)
            left -= size
        # Windows of incomplete groups of all sizes share groups, the longest first to the emptiest.
        last = sorted(((size, w) for size, ws in self.open.items() for w in ws), key=lambda x: -x[0])
        if last:
            loads = [0] * -(-sum(size for size, _ in last) // self.step)
            for size, window in last:
                g = loads.index(min(loads))
                loads[g] += size
                self._emit(size, window, self.groups + g)
            self.groups += len(loads)

    def _finish(self, size: int, window: list[tuple]) -> None:
        """A group of one size is complete with exactly one step's tokens."""
        waiting = self.open.setdefault(size, [])
        waiting.append(window)
        if len(waiting) * size == self.step:
            for w in waiting:
                self._emit(size, w, self.groups)
            self.groups += 1
            waiting.clear()

    def _emit(self, size: int, window: list[tuple], group: int) -> None:
        offset = 0
        for length, _, doc, start, ids, total in window:
            self.done.append((doc, start, length, ids, total, self.base + self.windows, offset, size, self.base + group))
            offset += length
        self.windows += 1

    def drain(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step: int = STEP, added: bool = False) -> DataFrame:
    """Pieces of all `docs` (doc_id, text; other columns are not read), each id in
    exactly one piece: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, window (the sequence's size), step_group.

    Texts are encoded whole, closed by id 0; a null or empty text is that id alone. `added`:
    see tokens.Encoder.
    A null doc_id is kept, rows that share a doc_id are documents of their own, an
    empty table gives no piece. Each task packs the rows of its partition, so
    nothing is shuffled; every sequence is full, only the last few of a task are
    shorter powers of two. Sequence and group numbers hold the task's number, so a
    repeated task gives the same numbers as long as its rows come in the same order:
    pass a table (or a stored one), not the output of a shuffle.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer, added), bytes(4)
        packer = Packer(tiers, step, TaskContext.get().partitionId() << ROW_BITS)

        def rows():
            for b in parts:
                for doc, text in texts_of(b):
                    packer.add(doc, code.encode(text) + end)
                    yield from packer.drain()
            packer.close()
            yield from packer.drain()

        yield from batches(rows(), schema, lambda r: len(r[3]))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
