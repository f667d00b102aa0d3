"""Chat formatting by prefix-target expansion (native DataFrame code only).

Every turn becomes one formatted segment; the segments of a conversation, in
turn order, form its stream. Every assistant turn is exploded into its own
example: the stream up to that turn is its context and only that reply is
trainable. An example therefore is a prefix of the stream. ``examples`` gives
it by position (context and target ranges), so the result grows with the
number of turns and not with its square; ``render`` writes the full text of
chosen examples.

Template: ``### <role>: <text></turn>\\n``. Inside texts a backslash becomes
``\\b``, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l`` (inside roles also ``:``
becomes ``\\c``), so neither marker can occur inside a text, and the text can be
read back exactly.

Edge cases: a null text or role counts as empty; a null turn sorts first; ties
in ``turn`` are ordered by role, then text; repeated rows stay; a null
conversation id is one conversation; other columns are ignored. Positions are
prefix sums in two levels (blocks of turns, then turns in a block), so a
conversation with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

BLOCK_TURNS = 256
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"


ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]


def escape(text: Column, role: bool = False) -> Column:
    """Backslash first, so that every backslash written later opens an escape."""
    for plain, code in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, pos`` (0, 1, ... in the conversation),
    ``segment, start`` and ``end`` (code points in the stream), ``body_start``,
    ``trainable`` (assistant)."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MID))
    rows = rows.select(
        "conv_id", "turn", "role", "text", (F.col("role") == "assistant").alias("trainable"),
        F.length(head).cast("long").alias("head_chars"),
        F.concat(head, escape(F.col("text")), F.lit(CLOSE)).alias("segment"),
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block")).withColumn(
            "chars", F.length("segment").cast("long"))
    blocks = rows.groupBy("conv_id", "block").agg(
        F.sum("chars").alias("c"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("conv_id").alias("o_conv"), F.col("block").alias("o_block"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base_chars"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_turns"))
    order = Window.partitionBy("conv_id", "block").orderBy(
        F.asc_nulls_first("turn"), "role", "text")
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("in_chars", F.sum("chars").over(inside))
              .withColumn("in_turns", F.row_number().over(order)))
    start = F.col("base_chars") + F.col("in_chars") - F.col("chars")
    return (placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("o_conv"))
                        & F.col("block").eqNullSafe(F.col("o_block")))
            .select("conv_id", "turn",
                    (F.col("base_turns") + F.col("in_turns") - 1).alias("pos"),
                    "segment", start.alias("start"), (start + F.col("chars")).alias("end"),
                    (start + F.col("head_chars")).alias("body_start"), "trainable"))


def examples(formatted: DataFrame) -> DataFrame:
    """One example per assistant turn: ``conv_id, pos, context_end`` (the
    context is the stream before it), ``loss_start, loss_end`` (the escaped
    reply, the only part under the loss) and ``example_end``."""
    return formatted.filter("trainable").select(
        "conv_id", "pos", F.col("start").alias("context_end"),
        F.col("body_start").alias("loss_start"),
        (F.col("end") - len(CLOSE)).alias("loss_end"), F.col("end").alias("example_end"))


def render(formatted: DataFrame, chosen: DataFrame) -> DataFrame:
    """Full text of the chosen examples (rows of ``examples``). The size of
    the result is the sum of the prefixes asked for, by nature; choose a part
    of the examples of a very long conversation at a time."""
    parts = chosen.select(F.col("conv_id").alias("e_conv"), F.col("pos").alias("e_pos"),
                          "loss_start", "loss_end").join(
        formatted, F.col("e_conv").eqNullSafe(F.col("conv_id")) & (F.col("pos") <= F.col("e_pos")))
    return parts.groupBy("conv_id", "e_pos", "loss_start", "loss_end").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment"))),
                                 lambda s: s["segment"]), "").alias("text")
    ).withColumnRenamed("e_pos", "pos")


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``role`` and ``text`` as parsed from the formatted segments, and
    ``loss_text``, the unescaped text under the loss mask (null outside it)."""
    body = F.expr(f"substring(segment, body_start - start + 1, "
                  f"end - body_start - {len(CLOSE)})")
    head = F.expr(f"substring(segment, {len(OPEN) + 1}, "
                  f"body_start - start - {len(OPEN) + len(MID)})")
    spans = examples(formatted).select(
        F.col("conv_id").alias("x_conv"), F.col("pos").alias("x_pos"), "loss_start", "loss_end")
    masked = F.expr("substring(segment, loss_start - start + 1, loss_end - loss_start)")
    return (formatted.join(spans, F.col("conv_id").eqNullSafe(F.col("x_conv"))
                           & (F.col("pos") == F.col("x_pos")), "left")
            .withColumn("role", unescape(head)).withColumn("text", unescape(body))
            .withColumn("loss_text", F.when(F.col("loss_start").isNotNull(), unescape(masked)))
            .drop("x_conv", "x_pos", "loss_start", "loss_end"))


def digest(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read back from the formatted segments."""
    parsed = read_back(formatted)
    line = F.concat(F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n"))
    # a digest is a function of the whole conversation in order, so its lines
    # meet in one row; only there
    return parsed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), "loss_text"))).alias("t"),
        F.sum(F.length("loss_text")).alias("loss_chars"),
        F.sum(F.length("segment")).cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.transform("t", lambda x: x["line"]), ""), 256).alias("turns_sha256"),
        F.coalesce(F.col("loss_chars"), F.lit(0)).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(F.transform("t", lambda x: x["loss_text"]), ""), 256)
        .alias("loss_sha256"),
        "formatted_chars")


def format_table(turns: DataFrame) -> DataFrame:
    """The formatted segments of a whole table, written once."""
    return written(format_turns(turns), "chat")
