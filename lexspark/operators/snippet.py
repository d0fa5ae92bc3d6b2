"""Best fragment of a body, with the hits marked.

A window of fifteen tokens may begin at a hit (and is then centred on the hits
it holds) or at the sentence that a hit stands in, which earns a bonus. The
window with most distinct phrases, then most hits, wins; the earliest on a tie.
Only ranked results come here, so the work is bounded by the result, and each
step is a running window within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions.text import RAW_TOKEN
from lexspark.session import durable

# Fixed values.
WINDOW = 15
OPEN, CLOSE, ELLIPSIS = "«", "»", " … "
PER_PHRASE = 1000
FIRST_SENTENCE, SENTENCE = 120, 100

_DOC = ("query_id", "id_tesis")
_GAP = r"[^\p{L}\p{N}]"


def _pieces(texts: DataFrame) -> DataFrame:
    """Body cut into separators and raw tokens; a sentence begins after ". " or ": "."""
    pair = rf"({_GAP}*)({RAW_TOKEN})"
    body = F.coalesce("texto", F.lit(""))
    return texts.select(
        *_DOC,
        F.regexp_extract_all(body, F.lit(pair), F.lit(1)).alias("gaps"),
        F.regexp_extract_all(body, F.lit(pair), F.lit(2)).alias("words"),
        F.regexp_extract(body, rf"({_GAP}*)\z", 1).alias("tail"),
    ).withColumn("n", F.size("words"))


def snippets(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, id_tesis, fragmento) for `texts` (query_id, id_tesis, texto).

    `found` holds the hits of at least these documents.
    """
    # Read by several steps below, so cut once. The result's rows bound its size.
    pieces = durable(_pieces(texts))
    instances = found.filter("col = 'texto'").select(
        *_DOC, "plen", F.struct("concept", "phrase").alias("ph"), F.explode("starts").alias("pos")
    )
    return _assemble(pieces, _best_window(pieces, instances), _marked_ranges(instances))


def _best_window(pieces: DataFrame, instances: DataFrame) -> DataFrame:
    sentence = F.filter(
        F.transform(
            "gaps",
            lambda g, i: F.when((i == 0) | g.rlike(r"[.:][ \t\n\r]+\z"), i),
        ),
        lambda i: i.isNotNull(),
    )
    sentences = pieces.filter(F.col("n") > WINDOW).select(*_DOC, F.explode(sentence).alias("pos"))
    rows = instances.select(*_DOC, "pos", "ph", "plen").unionByName(
        sentences.select(
            *_DOC, "pos",
            F.lit(None).cast("struct<concept:int,phrase:int>").alias("ph"),
            F.lit(None).cast("int").alias("plen"),
        )
    )
    doc = W.partitionBy(*_DOC)
    ahead = doc.orderBy("pos").rangeBetween(0, WINDOW - 1)
    so_far = doc.orderBy("pos")
    hit = F.col("ph").isNotNull()
    distinct = F.size(F.collect_set("ph").over(ahead))
    score = F.count("ph").over(ahead) + (PER_PHRASE - 1) * distinct
    last = F.max(F.when(hit, F.struct("pos", "ph", "plen"))).over(ahead)
    bonus = F.when(F.col("pos") == 0, FIRST_SENTENCE).otherwise(SENTENCE)
    begun = F.max(F.when(~hit, F.struct("pos", (F.col("score") + bonus).alias("score")))).over(so_far)

    judged = (
        rows.withColumn("score", score)
        .withColumn("last", last)
        .withColumn("sentence", begun)
        .filter(hit)
        .join(pieces.select(*_DOC, "n"), list(_DOC))
    )
    # Half of the room left by the hits goes before them; integer division
    # truncates toward zero, and the window stays inside the body.
    room = WINDOW - (F.col("last.pos") + F.col("last.plen") - F.col("pos"))
    half = F.when(room >= 0, F.floor(room / 2)).otherwise(F.ceil(room / 2))
    centred = F.greatest(F.least(F.col("pos") - half, F.col("n") - WINDOW), F.lit(0))
    own = F.struct(
        F.col("score").alias("score"), (-F.col("pos")).alias("pos"),
        (-F.col("ph.concept")).alias("c"), (-F.col("ph.phrase")).alias("p"),
        F.lit(1).alias("own"), centred.cast("int").alias("start"),
    )
    in_sentence = F.when(
        F.col("sentence.pos") < F.col("pos"),
        F.struct(
            F.col("sentence.score").alias("score"), (-F.col("pos")).alias("pos"),
            (-F.col("ph.concept")).alias("c"), (-F.col("ph.phrase")).alias("p"),
            F.lit(0).alias("own"), F.col("sentence.pos").alias("start"),
        ),
    )
    return judged.groupBy(*_DOC).agg(
        F.greatest(F.max(own), F.max(in_sentence)).getField("start").alias("start")
    )


def _marked_ranges(instances: DataFrame) -> DataFrame:
    """Overlapping instances merged to ranges of tokens."""
    end = F.col("pos") + F.col("plen") - 1
    order = W.partitionBy(*_DOC).orderBy("pos", "ph")
    reached = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col("pos") > reached), 1).otherwise(0)
    return (
        instances.withColumn("fresh", fresh)
        .withColumn("range", F.sum("fresh").over(order))
        .groupBy(*_DOC, "range")
        .agg(F.min("pos").alias("first"), F.max(end).alias("last"))
        .drop("range")
    )


def _assemble(pieces: DataFrame, windows: DataFrame, ranges: DataFrame) -> DataFrame:
    # At most WINDOW ranges begin inside a window, so the collected list is short.
    marks = (
        ranges.join(windows, list(_DOC))
        .filter((F.col("first") >= F.col("start")) & (F.col("first") < F.col("start") + WINDOW))
        .groupBy(*_DOC)
        .agg(F.collect_list("first").alias("opens"),
             F.collect_list(F.least(F.col("last"), F.col("start") + WINDOW - 1)).alias("closes"))
    )
    shown = (
        pieces.join(windows, list(_DOC), "left")
        .join(marks, list(_DOC), "left")
        .withColumn("start", F.coalesce("start", F.lit(0)))
        .withColumn("stop", F.least(F.col("start") + WINDOW, F.col("n")))
        .withColumn("opens", F.coalesce("opens", F.array().cast("array<int>")))
        .withColumn("closes", F.coalesce("closes", F.array().cast("array<int>")))
    )

    def piece(i):
        gap = F.when((i > F.col("start")) | (i == 0), F.element_at("gaps", i + 1)).otherwise("")
        opened = F.when(F.array_contains("opens", i), OPEN).otherwise("")
        closed = F.when(F.array_contains("closes", i), CLOSE).otherwise("")
        return F.concat(gap, opened, F.element_at("words", i + 1), closed)

    inside = F.when(
        F.col("n") > 0, F.transform(F.sequence("start", F.col("stop") - 1), piece)
    ).otherwise(F.array().cast("array<string>"))
    ends = F.col("start") + WINDOW - 1 >= F.col("n") - 1
    return shown.select(
        *_DOC,
        F.concat(
            F.when(F.col("start") > 0, ELLIPSIS).otherwise(""),
            F.array_join(inside, ""),
            F.when(ends, F.col("tail")).otherwise(ELLIPSIS),
        ).alias("fragmento"),
    )
