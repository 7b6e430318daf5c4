"""Prefix-target expansion of conversations into training examples.

A conversation is rendered once, turn after turn, by a template whose renderings are prefixes of each other. Every
assistant turn then becomes one example: the rendering up to the end of that turn, of which only the reply is
trainable. Turns after the last reply (or a conversation without replies) are kept in one closing example without a
trainable part, so that no turn is lost.

Template: `<s>`, then `[INST] role\\ntext [/INST]` for a turn of any role but assistant, `text</s>` for an assistant's.
Control strings inside a text get a backslash behind their first bracket (and one more if they have some already),
which `unescape` takes out again. Roles are written URL-encoded, so that they hold neither newline nor bracket.

A conversation is a row of one task, and each reply's example repeats what comes before it, as the method has it: a
conversation must fit into an executor's memory (some hundreds of MB), and n replies of like length cost n * n / 2 of them.

Edge cases: a null text or role is the empty string; turns with the same number are ordered by role, then text;
repeated rows are separate turns; a null turn comes first; rows with a null conv_id make one conversation; an empty
table gives no example; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
_CONTROL = r"(</?|\[/?)(\\*)(s>|INST\])"
_ESCAPED = r"(</?|\[/?)\\(\\*)(s>|INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    return F.when(role == "assistant", F.concat(escape(text), F.lit(EOS))).otherwise(F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"), escape(text), F.lit(CLOSE)))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), is_last, text, loss_start, loss_end: code points of text, end exclusive, one row per reply and closing part."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rendered = ordered.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t.role == "assistant").alias("reply"), render_turn(t.role, t.text).alias("text"))).alias("parts"),
    )
    start = F.struct(F.lit(len(BOS)).alias("at"), F.array().cast("array<struct<loss_start:int,loss_end:int,stop:int>>").alias("ends"))

    def step(acc: Column, part: Column) -> Column:
        stop = acc.at + F.char_length(part.text)
        end = F.struct(acc.at.alias("loss_start"), (stop - len(EOS)).alias("loss_end"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(part.reply, F.concat(acc.ends, F.array(end))).otherwise(acc.ends).alias("ends"))

    placed = rendered.select(
        "conv_id",
        F.concat(F.lit(BOS), F.array_join(F.transform("parts", lambda p: p.text), "")).alias("whole"),
        F.aggregate("parts", start, step).alias("placed"),
    )
    closing = F.array(F.struct(F.col("placed.at").alias("loss_start"), F.col("placed.at").alias("loss_end"), F.col("placed.at").alias("stop")))
    last_stop = F.coalesce(F.try_element_at("placed.ends", F.lit(-1))["stop"], F.lit(0))
    ends = F.when(last_stop < F.col("placed.at"), F.concat("placed.ends", closing)).otherwise(F.col("placed.ends"))
    exploded = placed.select("conv_id", "whole", F.size(ends).alias("n"), F.posexplode(ends).alias("example", "end"))
    return exploded.select(
        "conv_id",
        "example",
        (F.col("example") == F.col("n") - 1).alias("is_last"),
        F.substring("whole", F.lit(1), F.col("end.stop")).alias("text"),
        F.col("end.loss_start").alias("loss_start"),
        F.col("end.loss_end").alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """Reads an example back: the array of (role, text) of its turns."""
    body = F.substring(text, F.lit(len(BOS) + 1), F.char_length(text))
    parts = F.filter(F.split(body, r"(?<=</s>)|(?<= \[/INST\])"), lambda p: p != "")

    def read(p: Column) -> Column:
        reply = p.endswith(EOS)
        head = F.instr(p, "\n")
        role = F.when(reply, F.lit("assistant")).otherwise(F.url_decode(F.substring(p, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)))
        raw = F.when(reply, F.substring(p, F.lit(1), F.char_length(p) - len(EOS))).otherwise(F.substring(p, head + 1, F.char_length(p) - head - len(CLOSE)))
        return F.struct(role.alias("role"), unescape(raw).alias("text"))

    return F.transform(parts, read)


def loss_text(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """The trainable text of an example, as it stood in the conversation."""
    return unescape(F.substring(text, loss_start + 1, loss_end - loss_start))


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, from nothing but its examples."""
    turns = F.when(F.col("is_last"), parse_turns(F.col("text")))
    rows = examples.select(
        "conv_id",
        "example",
        F.char_length("text").cast("long").alias("chars"),
        loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        turns.alias("turns"),
    ).select(
        "conv_id",
        "example",
        "chars",
        "loss",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "")
    per = rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
