"""Conversations as budgeted windows of marked turns with a loss mask. DataFrame functions only.

A turn reads `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and texts every `<` that
bars follow gets one bar more, so neither mark can come from a text, and taking one
bar away restores it; a newline in a role is written `<|n|>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import ROW_BITS, partitions, stored

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of new turns in a window, and of turns repeated before them.
FRESH, HISTORY = 768, 256
#: Turns repeated at most.
REPEATED = 4
#: Tokens that the marks of a turn count as.
MARKS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def tokens(role: Column, text: Column) -> Column:
    """Length of a turn: words and single marks, as a tokenizer's first step cuts them."""
    piece = F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]")
    return (F.regexp_count(role, piece) + F.regexp_count(text, piece) + MARKS).cast("long")


def render(role: Column, text: Column) -> Column:
    head = F.regexp_replace(escape(role), "\n", "<|n|>")
    return F.concat(F.lit(START), head, F.lit("\n"), escape(text), F.lit(f"{END}\n"))


def _turns(conversations: DataFrame) -> DataFrame:
    """All turns in order, cut into ranges: `_part`, `_at` (global order) and `before`,
    the tokens of the conversation's turns before this one.

    Ranges are cut by conversation, turn and content, so one conversation with a
    third of all rows lies in many of them. Sums run inside a range; what a
    conversation brings along from earlier ranges is one row per range at most.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    keys = ["conv_id", "turn", "role", "_tie"]
    rows = stored(
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(partitions(conversations.sparkSession), *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"tokens": tokens(F.col("role"), F.col("text")), "_part": F.shiftright("_at", ROW_BITS)}).drop("_tie"),
        "turns")
    sums = rows.groupBy("conv_id", "_part").agg(F.sum("tokens").alias("_sum"), F.min("_at").alias("_first"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carry", F.sum("_sum").over(before)).where(F.col("_carry").isNotNull())
    # A range goes on with one conversation at most, its first: a row per range.
    carried = F.broadcast(carried.select("_part", F.col("conv_id").alias("_on"), "_carry"))
    inside = Window.partitionBy("_part", "conv_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("conv_id").eqNullSafe(F.col("_on"))
    return (
        rows.withColumn("_sum", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(carried, "_part", "left")
        .withColumn("before", F.col("_sum") + F.when(own, F.coalesce("_carry", F.lit(0))).otherwise(0))
        .drop("_sum", "_on", "_carry")
    )


def _with_previous(turns: DataFrame, n: int) -> DataFrame:
    """`turns` with `_previous`, the n rows before each in the global order. A range
    gets the last n rows of those before it: n rows for each range, whatever the data."""
    row = F.struct("conv_id", "_at", "role", "text", "tokens", "before", "_span")
    last = Window.partitionBy("_part").orderBy(F.desc("_at"))
    ends = turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")
    held = ends.select("_part", "_at", F.collect_list(row).over(Window.orderBy("_at").rowsBetween(-n, -1)).alias("_held"))
    held = held.groupBy("_part").agg(F.min_by("_held", "_at").alias("_held"))
    halo = held.select(F.col("_part"), F.explode("_held").alias("r")).where(F.shiftright("r._at", ROW_BITS) < F.col("_part"))
    halo = halo.select("_part", "r.*").withColumn("_halo", F.lit(True))
    order = Window.partitionBy("_part").orderBy("_at").rowsBetween(-n, -1)
    return (
        turns.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
        .withColumn("_previous", F.collect_list(row).over(order)).where("not _halo").drop("_halo")
    )


def windows(conversations: DataFrame, fresh: int = FRESH, history: int = HISTORY, repeated: int = REPEATED) -> DataFrame:
    """conv_id, window, text, loss, n_repeated, n_turns, n_tokens for all turns of
    `conversations` (conv_id, turn, role, text; other columns are not read).

    Prefix sums of turn tokens cut a conversation: cell c of the sums is
    [c * fresh, (c + 1) * fresh); the turns inside a cell are one span, a turn across
    cells is a span of its own, so a span has at most `fresh` tokens or one turn, which
    is never cut. A window is a span, before it the turns that directly precede it (at
    most `repeated` turns of at most `history` tokens), and first the conversation's
    system turn (its first turn, if its role is system), whole. window counts spans in
    order (2c, or 2c + 1 for a turn across cells).

    loss: [begin, end) code points of each assistant text among the new turns; the
    n_repeated leading turns are masked, so each target counts once. Turns that tie in
    conv_id and turn are ordered by role and a hash of the text, a null turn comes
    first, rows with a null conv_id are one conversation, a null role or text is empty.
    Repeated rows are turns of their own. An empty table gives no rows.
    """
    cell, end = F.floor(F.col("before") / fresh), F.floor((F.col("before") + F.col("tokens") - 1) / fresh)
    turns = _turns(conversations).withColumn("_span", 2 * cell + (end > cell).cast("long"))
    seen = stored(_with_previous(turns, repeated).drop("turn"), "previous")
    last = F.element_at(F.col("_previous"), -1)
    same = lambda r: r.conv_id.eqNullSafe(F.col("conv_id"))
    opens = F.when(F.size("_previous") > 0, ~same(last) | (last["_span"] != F.col("_span"))).otherwise(True)
    system = (F.col("role") == "system") & (F.col("before") == 0)
    back = F.filter("_previous", lambda r: same(r) & (r.before >= F.col("before") - history)
                    & ~((r.before == 0) & (r.role == "system")))
    rows = seen.withColumn("_back", F.when(opens, back))
    turn = lambda r: F.struct(r["_at"].alias("at"), r["role"].alias("role"), r["text"].alias("text"), r["tokens"].alias("tokens"))
    spans = rows.groupBy("conv_id", "_span").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), "role", "text", "tokens"))).alias("_new"),
        F.first("_back", ignorenulls=True).alias("_back"), F.min("before").alias("_begin"))
    # A conversation has one such turn; its windows find it by an ordinary join, whose
    # large partitions Spark splits.
    heads = seen.where(system).select(
        F.col("conv_id").alias("_of"), F.array(F.struct(F.col("_at").alias("at"), "role", "text", "tokens")).alias("_head"))
    joined = spans.join(heads, F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("_begin") > 0), "left")
    none = F.slice("_new", 1, 0)
    lead = F.concat(F.coalesce("_head", none), F.coalesce(F.transform("_back", turn), none))
    # The turns as they are written, then their places from running lengths.
    parts = joined.select("conv_id", "_span", lead.alias("_lead"), "_new").select(
        "conv_id", "_span", F.size("_lead").alias("n_repeated"), F.size("_new").alias("n_turns"),
        F.concat("_lead", "_new").alias("_all")
    ).select(
        "*", F.transform("_all", lambda r: render(r.role, r.text)).alias("_written"),
        F.transform("_all", lambda r: F.length(escape(r.text))).alias("_sizes"))
    begins = F.aggregate(
        F.transform("_written", F.length), F.array(F.lit(0)),
        lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    tail = len(END) + 1
    span = lambda r, i: F.when(
        (i >= F.col("n_repeated")) & (r.role == "assistant"),
        F.struct((F.col("_begins")[i + 1] - tail - F.col("_sizes")[i]).alias("begin"), (F.col("_begins")[i + 1] - tail).alias("end")))
    return parts.withColumn("_begins", begins).select(
        "conv_id", F.col("_span").alias("window"), F.array_join("_written", "").alias("text"),
        F.filter(F.transform("_all", span), lambda s: s.isNotNull()).alias("loss"),
        "n_repeated", "n_turns", F.aggregate("_all", F.lit(0).cast("long"), lambda s, r: s + r.tokens).alias("n_tokens"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """The windows' new turns read back from their text: conv_id, window, `turns`
    (role, text) in order and `targets`, the unescaped texts under the loss mask."""
    parts = F.slice(F.split("text", r"<\|im_end\|>\n", -1), F.col("n_repeated") + 1, F.col("n_turns"))
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda b: unescape(F.regexp_replace(F.substring_index(b, "\n", 1), r"<\|n\|>", "\n"))
    text = lambda b: unescape(F.substr(b, F.instr(b, F.lit("\n")) + 1))
    target = lambda s: unescape(F.substr(F.col("text"), s.begin + 1, s.end - s.begin))
    return formatted.select(
        "conv_id", "window", F.length("text").alias("n_chars"),
        F.transform(F.transform(parts, body), lambda b: F.struct(role(b).alias("role"), text(b).alias("text"))).alias("turns"),
        F.transform("loss", target).alias("targets"))
