"""Conversations as training texts, with Spark expressions only.

A conversation becomes

    <|im_start|>role
    text<|im_next|>text<|im_end|>

for each run of turns of one role. In texts and roles a backslash stands before each
backslash and inside each `<|`, and in roles before each line break, so that no control
string can occur in them and all can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
# Up to the first line break that no backslash stands before.
ROLE = r"^((?:[^\\\n]|\\[\s\S])*+)\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _pattern(control: str) -> str:
    return control.replace("|", r"\|")


def format_conversations(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, segments, formatted), one row per conversation.

    `segments` are pieces of the text in order, each with the flag `loss`: the texts of
    the assistant count for the loss, roles, control strings and other texts do not.
    `formatted` is all pieces put together. Turns are sorted by turn, a null first, then
    role and text; null roles and texts are empty; rows with a null id are one
    conversation; repeated rows are repeated turns. An empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    talks = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    role_at = lambda i: F.get("turns", i)["role"]

    def pieces(turn: Column, i: Column) -> Column:
        opens = (i == 0) | (role_at(i - 1) != turn["role"])
        closes = (i == F.size("turns") - 1) | (role_at(i + 1) != turn["role"])
        role = F.replace(escape(turn["role"]), F.lit("\n"), F.lit("\\\n"))
        before = F.when(opens, F.concat(F.lit(START), role, F.lit("\n"))).otherwise(F.lit(NEXT))
        after = F.when(closes, F.lit(END)).otherwise(F.lit(""))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(before, F.lit(False)),
            piece(escape(turn["text"]), turn["role"] == LOSS_ROLE),
            piece(after, F.lit(False)),
        )

    segments = F.flatten(F.transform("turns", pieces))
    return talks.select("conv_id", segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.col("segments")["text"], "")
    )


def read_turns(formatted: Column) -> Column:
    """The turns, (role, text) each, of a formatted conversation."""
    parts = F.split(formatted, _pattern(START))
    blocks = F.slice(parts, 2, F.size(parts))

    def turns(block: Column) -> Column:
        role = F.regexp_extract(block, ROLE, 1)
        first = F.length(role) + 2
        body = F.substring(block, first, F.length(block) - len(END) - first + 1)
        return F.transform(
            F.split(body, _pattern(NEXT)),
            lambda text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text that counts for the loss, unescaped."""
    counted = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(counted, lambda s: unescape(s["text"])), "")
