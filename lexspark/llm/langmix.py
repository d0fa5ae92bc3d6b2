"""Languages of a document as a mixture: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexspark.llm.common import kept_columns, with_columns

#: Cells that character n-grams are hashed to, and the largest n.
CELLS, N = 1 << 14, 3
#: Added to each cell's count of each language.
SMOOTHING = 0.5
#: A further language must raise the log-likelihood by PENALTY * log(n-grams of the
#: document): far above the half of the Schwarz criterion, since n-grams of running
#: text overlap and are not independent.
PENALTY = 6.0
ROUNDS = 30
UNKNOWN = "und"
#: Languages that can be learned at most: their counts lie in one table of every task.
MOST_LANGUAGES = 512

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """True for each code point that is a letter; made once per Python worker."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x32000)] + [False])
    return _letters


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to N-grams of the text's words; None without a letter.

    Letters are lower-cased, all else between words is one blank.
    """
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letter_table()[np.minimum(points, 0x32000)]
    if not letter.any():
        return None
    kept = np.where(letter, points, 32)
    kept = kept[letter | np.append(True, letter[:-1])]
    line = np.concatenate([[32], kept, [32]] if letter[-1] else [[32], kept]).astype(np.uint32)
    counts = np.zeros(CELLS, np.int64)
    for n in range(1, N + 1):
        code = np.full(len(line) - n + 1, n, np.uint32)
        for i in range(n):
            code = (code ^ line[i: len(line) - n + 1 + i]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
        counts += np.bincount(code & np.uint32(CELLS - 1), minlength=CELLS)
    return counts


@dataclass
class Model:
    """languages, and the share of each cell in each one's n-grams (cell x language)."""

    languages: list[str]
    shares: np.ndarray

    def mixture(self, counts: np.ndarray) -> tuple[list[int], np.ndarray, float]:
        """(languages, their proportions, posterior of the best one alone).

        Starts with the single best language; adds the one that raises the
        likelihood of the mixture most, as long as that exceeds the penalty.
        """
        cells = np.flatnonzero(counts)
        c, p = counts[cells].astype(float), self.shares[cells]
        alone = c @ np.log(p)
        best = int(alone.argmax())
        certain = float(1 / np.exp(alone - alone[best]).sum())
        chosen, shares, likely = [best], np.ones(1), float(alone[best])
        least = PENALTY * np.log(c.sum() + 1)
        while len(chosen) < len(self.languages):
            tries = [(*_expect(c, p[:, [*chosen, k]]), k) for k in range(len(self.languages)) if k not in chosen]
            value, mixed, k = max(tries, key=lambda t: t[0])
            if value - likely <= least:
                break
            chosen, shares, likely = [*chosen, k], mixed, value
        return chosen, shares, certain


def _expect(c: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
    """The greatest log-likelihood of a mixture of the columns of p, and its proportions."""
    total, share = c.sum(), np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(ROUNDS):
        after = share * (p.T @ (c / (p @ share))) / total
        done = np.abs(after - share).max() < 1e-3
        share = after
        if done:
            break
    return float(c @ np.log(p @ share)), share


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by the checksum of its id; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Counts n-grams of all `docs` (text, lang) with a language; null languages and
    texts without a letter teach nothing, and an empty table teaches no language.
    The driver gets one row per language and cell; more than MOST_LANGUAGES distinct
    values of lang raise ValueError before anything is collected."""
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in parts:
            for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
                counts = grams(text.as_py())
                if counts is not None:
                    lang = lang.as_py()
                    sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, counts in sums.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells)), pa.array(cells.astype(np.int32)), pa.array(counts[cells])], schema=schema)

    known = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    values = docs.select("lang").where(F.col("lang").isNotNull()).distinct().limit(MOST_LANGUAGES + 1).count()
    if values > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    table = known.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names, of = np.unique(np.array(table.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    counts = np.full((CELLS, len(names)), SMOOTHING)
    counts[table.column("cell").to_numpy(), of] += table.column("n").to_numpy()
    return Model(names.tolist(), counts / counts.sum(0))


MADE = "lang_pred string, score double, languages array<string>, shares array<double>"


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The rows of `docs` (with a column text) with lang_pred, score, languages, shares;
    of its other columns those in `keep`, all without it.

    languages are the selected ones with their proportions, the largest first;
    lang_pred is the first of them, score its proportion times the posterior of the
    best language alone. A null text or one without a letter is `und` with score 0
    and no languages, and so is every text if nothing was learned. Texts are
    predicted whole, each by itself; an empty table gives no rows. Columns with the
    names of the new ones are replaced.
    """
    made = to_arrow_schema(StructType.fromDDL(MADE))
    names, ddl = kept_columns(docs, keep, made.names)

    def one(text: str | None) -> tuple:
        counts = grams(text) if model.languages else None
        if counts is None:
            return UNKNOWN, 0.0, [], []
        chosen, shares, certain = model.mixture(counts)
        order = np.argsort(-shares, kind="stable")
        found = [model.languages[chosen[i]] for i in order]
        return found[0], float(min(1.0, shares[order[0]] * certain)), found, shares[order].tolist()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield from with_columns(b, names, one, made)

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, "text"])]).mapInArrow(run, f"{ddl}, {MADE}" if ddl else MADE)
