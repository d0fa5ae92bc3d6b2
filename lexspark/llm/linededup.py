"""Lines that many documents share, dropped everywhere. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import key_of_line, stored

MIN_DOCS, MIN_CHARS = 10, 1


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`hash` (16 bytes) of the keys found in at least `min_docs` rows of `docs`.

    A document's keys are made distinct inside its row, so that one exchange of
    partial counts is all that is shuffled, and a line of every document is one
    row per task.
    """
    key = F.explode(F.array_distinct(F.transform(_lines("text"), key_of_line))).alias("key")
    hashes = docs.select(key).where(F.length("key") >= min_chars).select(F.unhex(F.md5("key")).alias("hash"))
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("hash")


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` (with a column text) with the other lines, joined by newlines, and
    `n_lines` (before dropping) and `n_dropped`.

    A line's key is the line without blanks at both ends and with A-Z lower-cased.
    Keys of at least `min_chars` code points that occur in at least `min_docs`
    documents lose all their lines. A null or empty text is one empty line; a
    document that loses all lines has an empty text. Every row is a document of its
    own, also if rows share an id or are equal in all columns; an empty table gives
    no rows. Columns named n_lines, n_dropped or beginning with _ are replaced.

    The frequent keys are stored first: Spark broadcasts them if they are small
    enough, and else joins by hash, where it splits the partition of a frequent
    line. Lines then meet once, by document.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped") and not c.startswith("_")]
    frequent = stored(frequent_lines(docs, min_docs, min_chars).withColumn("_drop", F.lit(True)), "lines")
    numbered = docs.select(
        "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"),
        F.monotonically_increasing_id().alias("_row"))
    lines = numbered.select(
        "_row", "_rest", F.posexplode(_lines("text")).alias("_at", "_line"),
    ).select("_row", "_at", "_line", F.when(F.col("_at") == 0, F.col("_rest")).alias("_rest"),
             F.unhex(F.md5(key_of_line(F.col("_line")))).alias("hash"))
    marked = lines.join(frequent, "hash", "left")
    kept = F.when(F.col("_drop").isNull(), F.struct("_at", "_line"))
    return marked.groupBy("_row").agg(
        F.first("_rest", ignorenulls=True).alias("_rest"), F.sort_array(F.collect_list(kept)).alias("_kept"),
        F.count(F.lit(1)).alias("n_lines"), F.count("_drop").alias("n_dropped"),
    ).select(
        *[F.col(f"_rest.`{c}`").alias(c) for c in rest],
        F.array_join(F.col("_kept._line"), "\n").alias("text"), "n_lines", "n_dropped")
