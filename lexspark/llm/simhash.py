"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import components, partitions, spread_join, stored

WORDS = 4
DISTANCE = 4
BITS = 64
SEED = 42
#: Fingerprints against which all others are measured to estimate candidate counts.
REFERENCES = 128
#: Estimated seconds to make, deal out and sort one key, and to compare one pair.
KEY_COST, PAIR_COST = 2e-6, 5e-9
#: Groups up to this size are compared pair by pair; larger ones are divided first.
SMALL_GROUP = 4096


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower() changes nothing else, and bytes.split()
    parts at [\\x20\\x09-\\x0D]."""
    return (text or "").encode().lower().split()


def shingle_hashes(tokens: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of every shingle of `words` words (of all, if there are fewer), in
    arrays of a bounded size."""
    if not tokens:
        return
    digest, joined = xxhash.xxh64_intdigest, b" ".join(tokens)
    if len(tokens) <= words:
        yield np.array([digest(joined, SEED)], "<u8")
        return
    begins = np.cumsum([0, *[len(t) + 1 for t in tokens]])
    ends = (begins[words:] - 1).tolist()
    begins, n, step = begins.tolist(), len(tokens) - words + 1, 1 << 16
    for at in range(0, n, step):
        upto = min(n, at + step)
        yield np.array([digest(joined[b:e], SEED) for b, e in zip(begins[at:upto], ends[at:upto])], "<u8")


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The bits set in over half of the hashes; 0 without one."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 without a word."""
    return majority(shingle_hashes(words_of(text), words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), for every row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def _counts(distinct: DataFrame, count, size: int) -> np.ndarray:
    """count(array of fingerprints) -> `size` numbers, summed over all rows in Spark."""
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in parts:
            total += count(_fps(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], schema=schema)

    sums = np.zeros(size, np.int64)
    for i, n in distinct.select("fp").mapInArrow(run, "i int, n long").groupBy("i").sum("n").collect():
        sums[i] = n
    return sums


def _both_set(fps: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return (bits.T @ bits).astype(np.int64).ravel()


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of near equal width; each group grows by the bit
    that is most correlated with those it has."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - i)
        rest = sorted(free)
        group = [rest[int(np.argmax(related[np.ix_(rest, rest)].max(1)))]]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(related[np.ix_(rest, group)].sum(1)))])
        free -= set(group)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def close_shares(share: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Under independent bits, the chance that two fingerprints differ in at most
    e = 0..most bits of a group."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for b in group:
        p = 2 * share[b] * (1 - share[b])
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
        chance[-1] = 0  # more than `most`
    return np.cumsum(chance[:-1])


def allocate(groups: list[list[int]], shares: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds t (-1: group unused) of the least estimated cost.

    If t + 1 sums to distance + 1 over the groups, two fingerprints that differ in
    at most `distance` bits differ in at most t bits of some group. shares[i][e]:
    estimated share of pairs that differ in at most e bits of group i.
    """
    best = {0: (0.0, [])}
    for i, group in enumerate(groups):
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance + 1 - spent):
                if t > len(group):
                    break
                more = 0.0 if t < 0 else n * comb(len(group), t) * KEY_COST + n * n / 2 * shares[i][t] * PAIR_COST
                if spent + t + 1 not in after or cost + more < after[spent + t + 1][0]:
                    after[spent + t + 1] = (cost + more, [*chosen, t])
        best = after
    return best[distance + 1]


def plan(distinct: DataFrame, distance: int = DISTANCE) -> list[int]:
    """The masks under which two fingerprints within `distance` agree at least once.

    Correlated bits are grouped, for every number of groups up to distance + 1;
    all fingerprints are measured against a fixed number of references; thresholds
    come from dynamic programming. A threshold t of a group is probed by one mask for
    each way to leave t of its bits out. Estimates only choose among plans: any
    plan finds all pairs.
    """
    both = _counts(distinct, _both_set, BITS * BITS).reshape(BITS, BITS)
    n = int(distinct.count())
    share = np.diag(both) / max(n, 1)
    refs = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(REFERENCES).collect()], np.int64).view(np.uint64)
    divisions = [group_bits(both, n, m) for m in range(2, distance + 2)] if distance else [[list(range(BITS))]]
    masks = [mask_of(g) for groups in divisions for g in groups]

    def near(fps: np.ndarray) -> np.ndarray:
        out = np.zeros((len(masks), distance + 1), np.int64)
        for r in refs:
            differ = fps ^ r
            for i, m in enumerate(masks):
                out[i] += np.bincount(np.bitwise_count(differ & np.uint64(m)), minlength=BITS + 1)[: distance + 1]
        return out.ravel()

    found = _counts(distinct, near, len(masks) * (distance + 1)).reshape(len(masks), distance + 1).cumsum(1)
    # Without each reference's meeting with itself.
    measured = np.maximum(found - len(refs), 0) / max(1, len(refs) * (n - 1))
    choices, at = [], 0
    for groups in divisions:
        shares = np.maximum(measured[at: at + len(groups)], [close_shares(share, g, distance) for g in groups])
        choices.append((*allocate(groups, shares, n, distance), groups))
        at += len(groups)
    _, thresholds, groups = min(choices, key=lambda c: c[0])
    return [mask_of([b for b in g if b not in out])
            for g, t in zip(groups, thresholds, strict=True) if t >= 0 for out in combinations(g, t)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the links a-b connect: each one to the smallest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = ends[: len(a)], ends[len(a):]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[low], root[high])
        after = root.copy()
        np.minimum.at(after, root[low], least)
        np.minimum.at(after, root[high], least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


class _Links:
    """Links of one task; kept as a forest, so their number is bounded by the fingerprints'."""

    def __init__(self):
        self.a, self.b, self.size, self.least = [], [], 0, 1 << 18

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.size += len(a)
            if self.size > self.least:
                self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.size = [a], [b], len(a)
        self.least = max(1 << 18, 2 * self.size)
        return a, b


def compare_runs(rows: "_Rows", starts: np.ndarray, distance: int, free: int, links: _Links) -> None:
    """Link what is within `distance` inside each run of rows that begins at `starts`.

    Runs are compared with themselves shifted by 1, 2, ...; a run of more than
    SMALL_GROUP is first divided by the pigeonhole principle on those of its `free` bits
    that differ inside it, so that a crowded group costs far less than all its pairs,
    and loses none. Each part holds such a bit, so each division shrinks the run; a run
    that differs in `distance` bits at most is linked as it stands.
    """
    sizes = np.diff(np.append(starts, len(rows.fp)))
    large = sizes > SMALL_GROUP
    for at in np.flatnonzero(large):
        group = rows.take(slice(starts[at], starts[at] + sizes[at]))
        varied = int(np.bitwise_or.reduce(group.fp ^ group.fp[0])) & free
        bits_of = [b for b in range(BITS) if varied >> b & 1]
        if len(bits_of) <= distance:
            if rows.checks is None:
                links.add(np.full(len(group.node) - 1, group.node[0]), group.node[1:])
            else:
                large[at] = False
            continue
        for i in range(distance + 1):
            bits = bits_of[i::distance + 1]
            key = group.fp & np.uint64(mask_of(bits))
            order = np.argsort(key, kind="stable")
            inner = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            compare_runs(group.take(order), inner, distance, free & ~mask_of(bits), links)
    left = np.repeat(np.where(large, 0, sizes), sizes) - (np.arange(len(rows.fp)) - np.repeat(starts, sizes))
    row = np.flatnonzero(left > 1)
    shift = 1
    while len(row):
        near = row[np.bitwise_count(rows.fp[row] ^ rows.fp[row + shift]) <= distance]
        if rows.checks is not None and len(near):
            near = near[np.bitwise_count(rows.checks[near] ^ rows.checks[near + shift]).sum(1) <= rows.limit]
        links.add(rows.node[near], rows.node[near + shift])
        shift += 1
        row = row[left[row] > shift]


class _Rows:
    """Fingerprints with the nodes they stand for and, if given, further bits of which
    two linked ones differ in `limit` at most."""

    def __init__(self, fp: np.ndarray, node: np.ndarray, checks: np.ndarray | None, limit: int):
        self.fp, self.node, self.checks, self.limit = fp, node, checks, limit

    def take(self, which) -> "_Rows":
        return _Rows(self.fp[which], self.node[which], None if self.checks is None else self.checks[which], self.limit)


def links(distinct: DataFrame, distance: int = DISTANCE, checks: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """a, b: links that connect the rows of `distinct` (fp, node: long) whose fp are
    within `distance` and whose `checks` columns (long) differ in `limit` bits at most.

    Keys are made, dealt out and sorted by Spark; a task sees its keys one after the
    other, compares the rows of each, and hands on a forest. A key's rows are
    distinct and agree in a mask that the plan chose to be selective; they are a few
    numbers each.
    """
    spark = distinct.sparkSession
    masks = plan(distinct, distance)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    carried = list(dict.fromkeys(["fp", "node", *checks]))
    keys = distinct.select(*carried, F.posexplode(F.array(*map(F.lit, signed))).alias("slot", "mask")).select(
        "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), *carried)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = _Links(), None

        def check(columns: list[np.ndarray]) -> None:
            slot, value, fp, node, *more = columns
            rows = _Rows(fp.view(np.uint64), node, np.stack(more, 1).view(np.uint64) if more else None, limit)
            starts = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (value[1:] != value[:-1])))
            for first, upto in _by_slot(slot, starts):
                at = slice(starts[first], starts[upto] if upto < len(starts) else len(fp))
                free = ~masks[slot[starts[first]]] & (1 << BITS) - 1
                compare_runs(rows.take(at), starts[first:upto] - starts[first], distance, free, found)

        for b in parts:
            if not b.num_rows:
                continue
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "value", "fp", "node", *checks)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            # The last key may go on in the next batch.
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = len(last) - int(last.sum())
            held = [x[cut:] for x in columns]
            if cut:
                check([x[:cut] for x in columns])
        if held is not None:
            check(held)
        a, b = found.reduce()
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at: at + (1 << 16)]) for x in (a, b)], schema=schema)

    return keys.repartition(partitions(spark), "slot", "value").sortWithinPartitions("slot", "value").mapInArrow(
        run, "a long, b long")


def _by_slot(slot: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runs that share a slot."""
    of = slot[starts]
    edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(starts))
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs` (doc_id, text; other columns
    are not read). component_id is the smallest doc_id that links of at most
    `distance` differing bits reach.

    Null, empty and blank texts have fingerprint zero and are linked like others.
    Rows with a null doc_id have a component but give it no id (null if all are).
    Rows that share a doc_id are rows of their own. An empty table gives no rows.
    Equal fingerprints become one row before anything is compared, so large groups
    of copies cost nothing there.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    counted = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(counted, "distinct")
    member = components(links(firsts.withColumn("node", F.col("fp")), distance)).withColumnRenamed("node", "fp")
    roots = firsts.join(member, "fp").select("fp", "root", "first")
    lowest = roots.groupBy("root").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("n"))
    linked = spread_join(roots, lowest, "root", "fp").select("fp", "lowest")
    ids = firsts.join(linked, "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id"))
    return spread_join(marked, stored(ids, "ids"), "fp", "doc_id").select("doc_id", "fp", "component_id")
