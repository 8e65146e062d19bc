"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every turn becomes one segment of its conversation's formatted stream:

    <|role|>\\n  escaped text  <|end|>\\n

In texts, a backslash becomes ``\\b`` and ``<`` becomes ``\\l``, so no marker can appear inside a text and
two replacements in the other order undo it; roles also get ``|`` as ``\\p``.

Every assistant turn is exploded into its own example: the prompt is the stream up to that reply, the
reply is the only trainable span. An example is a row of its own that refers to its context by the stream's
offsets, as all examples of a conversation share prefixes: the output is linear in the input also where
one conversation holds a third of all rows, and :func:`expand` writes the literal prompts and replies
of whichever examples a trainer asks for. What is reported of losses is read back from the example rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.runtime import materialize

#: turns whose numbers share this quotient get their offsets in one task
BLOCK_TURNS = 1024
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def segments(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, turn, place, segment, seg_start, seg_end, is_target, loss_start, loss_end.

    ``place`` (from 0) orders a conversation's turns by turn number (null first), then role, then text;
    offsets count code points of the conversation's stream. A target's loss span is exactly its text.
    Null texts and roles count as empty; null conversation ids form one conversation; repeated rows are
    turns of their own; an empty table gives an empty table. Other columns are not read.
    Offsets are summed in blocks of turn numbers, then over blocks, so that no task numbers an
    unbounded conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit("<|"), _escape_role(F.col("role")), F.lit("|>\n"))
    body = escape(F.col("text"))
    rows = rows.withColumns({
        "segment": F.concat(head, body, F.lit(END)),
        "head_chars": F.length(head).cast("long"), "body_chars": F.length(body).cast("long"),
        "is_target": F.col("role") == target_role, "block": F.floor(F.col("turn") / BLOCK_TURNS),
    }).withColumn("chars", F.col("head_chars") + F.col("body_chars") + len(END))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("chars").alias("b_chars"), F.count("*").alias("b_rows"))
    past = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("b_chars").over(past), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("b_rows").over(past), F.lit(0)).alias("rows_before"),
    )
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    own = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"own_end": F.sum("chars").over(own), "own_place": F.row_number().over(inside) - 1})
    on = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    start = F.col("chars_before") + F.col("own_end") - F.col("chars")
    loss = start + F.col("head_chars")
    return rows.join(blocks, on).select(
        "conv_id", "turn", (F.col("rows_before") + F.col("own_place")).alias("place"), "segment",
        start.alias("seg_start"), (start + F.col("chars")).alias("seg_end"), "is_target",
        F.when(F.col("is_target"), loss).alias("loss_start"),
        F.when(F.col("is_target"), loss + F.col("body_chars")).alias("loss_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, place, context_turns, context_chars, loss_start, loss_end, example_chars.

    The example is the stream's first ``example_chars`` code points: all ``context_turns`` preceding turns, then
    the reply's segment, of which [loss_start, loss_end) alone is trainable.
    """
    return formatted.where("is_target").select(
        "conv_id", "place", F.col("place").alias("context_turns"), F.col("seg_start").alias("context_chars"), "loss_start", "loss_end",
        F.col("seg_end").alias("example_chars"),
    )


def read_examples(formatted: DataFrame, made: DataFrame) -> DataFrame:
    """Examples read back from the stream: conv_id, place, loss_text (unescaped), example_chars, whole.

    An example's last segment is cut by the example's own offsets. ``whole`` is true where the prompt ends with
    the reply's head and the example with the end of a turn.
    """
    at = formatted.select(F.col("conv_id").alias("s_conv"), F.col("place").alias("s_place"), "segment")
    on = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("context_turns") == F.col("s_place"))
    head, size = (F.col("loss_start") - F.col("context_chars")).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")
    rest = F.substring(F.col("segment"), head + size + 1, (F.col("example_chars") - F.col("loss_end")).cast("int"))
    return made.join(at, on).select(
        "conv_id", "place", unescape(F.substring(F.col("segment"), head + 1, size)).alias("loss_text"), "example_chars",
        (F.substring(F.col("segment"), head - 2, F.lit(3)).eqNullSafe(F.lit("|>\n")) & (rest == END)).alias("whole"),
    )


def expand(formatted: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Literal ``(conv_id, place, prompt, reply)`` of the wanted examples (all, if none are named).

    The output of all examples grows with the square of a conversation's turns; name those that a
    trainer reads next where conversations are long.
    """
    wanted = (examples(formatted) if wanted is None else wanted).select(
        F.col("conv_id").alias("e_conv"), F.col("place").alias("e_place"), F.col("loss_start").alias("e_start"), F.col("loss_end").alias("e_end")
    )
    on = F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("place") <= F.col("e_place"))
    parts = formatted.join(wanted, on).groupBy("e_conv", "e_place", "e_start", "e_end").agg(
        F.sort_array(F.collect_list(F.struct("place", "segment"))).alias("parts")
    )
    stream = F.array_join(F.col("parts.segment"), "")
    return parts.select(
        F.col("e_conv").alias("conv_id"), F.col("e_place").alias("place"),
        F.substring(stream, F.lit(1), F.col("e_start").cast("int")).alias("prompt"),
        F.substring(stream, (F.col("e_start") + 1).cast("int"), (F.col("e_end") - F.col("e_start")).cast("int")).alias("reply"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Turns read back from the segments: conv_id, place, role, text, chars."""
    at = F.instr("segment", "|>\n")
    size = F.length("segment")
    return formatted.select(
        "conv_id", "place", size.cast("long").alias("chars"),
        _unescape_role(F.substring(F.col("segment"), F.lit(3), at - 3)).alias("role"),
        unescape(F.substring(F.col("segment"), at + 3, size - at - 2 - len(END))).alias("text"),
    )


def digests(formatted: DataFrame, made: DataFrame) -> DataFrame:
    """Digests per conversation: turns read back from the stream, losses from the examples ``made`` of it.

    A SHA-256 of a whole conversation needs its turns in order in one place: this report, and only it,
    gathers a conversation into one row.
    """
    turns = parse(formatted).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"), F.sum("chars").alias("formatted_chars")
    )
    losses = read_examples(formatted, made).groupBy(F.col("conv_id").alias("l_conv")).agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("loss_text").alias("text")))).alias("loss"), F.count("*").alias("n"),
        F.sum("example_chars").alias("chars"), F.count_if("whole").alias("n_whole"),
    )
    rows = turns.join(losses, F.col("conv_id").eqNullSafe(F.col("l_conv")), "left")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss_text = F.coalesce(F.array_join(F.col("loss.text"), ""), F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"),
        "formatted_chars", count("n").alias("n_examples"), count("chars").alias("expanded_chars"), count("n_whole").alias("n_whole"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(control).alias("text"),
    )
    formatted = materialize(segments(turns.unionByName(extra)), "chat-stream")
    return digests(formatted, materialize(examples(formatted), "chat-examples"))


_ESCAPED = r"replace(replace(text, '\', '\b'), '<', '\l')"
ORACLE = rf"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), f AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '|', '\p')) + length({_ESCAPED}) + 13 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t
), g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS seg_end FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples, n_examples AS n_whole,
       CAST(coalesce(sum(seg_end) FILTER (role = 'assistant'), 0) AS BIGINT) AS expanded_chars
FROM g GROUP BY conv_id
"""
