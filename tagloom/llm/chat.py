"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Each assistant turn becomes an example of its own: all preceding turns are its context, and only that reply is
trainable. Turns that no assistant turn follows are kept in one further example without a target, so that no turn of a
conversation is lost. A turn is written as ``<s>[role]`` newline text ``</s>`` newline. Inside roles and texts the
backslash and the opening brackets of control strings are escaped (``\\e``, ``\\l`` for <, ``\\k`` for [, ``\\j`` for
]), which no template can undo by accident: an escaped text holds no bracket at all, so markers are found by splitting.

Defined cases: null text and null role are empty strings; rows of a conversation are ordered by turn (null first), role
and text, so ties and repeated rows are kept in a fixed order; rows without conv_id form one conversation of their own;
other columns are ignored. A conversation's turns are held together, which its own length bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the template writes around a turn, and its escapes in the order of escaping.
BEGIN, CLOSE, END = "<s>[", "]\n", "</s>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\k"), ("]", "\\j"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, example, context, target): one row per assistant turn, and one with a null target for the rest.

    example counts from 1 within a conversation. The formatted text is context followed by target; the loss mask covers
    the reply inside the target, that is the target without its markers.
    """
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        F.struct(
            turns["turn"].cast("long").alias("turn"),
            F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    written = F.transform("t", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(CLOSE)).alias("head"), F.concat(escape(t["text"]), F.lit(END)).alias("body")))
    convs = convs.select("conv_id", written.alias("w"))
    replies = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("w", i)["reply"])
    convs = convs.select("conv_id", "w", replies.alias("at"))
    # what no reply follows: a last cut, at the end of the conversation, without a target
    rest = F.when(F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0)) < F.size("w"), F.array(F.size("w"))).otherwise(F.array().cast("array<int>"))
    convs = convs.select("conv_id", "w", F.size("at").alias("n"), F.posexplode(F.concat("at", rest)).alias("k", "cut"))
    is_target = F.col("k") < F.col("n")
    text = lambda part: F.array_join(F.transform(part, lambda t: F.concat(t["head"], t["body"])), "")
    last = F.element_at("w", F.col("cut"))
    return convs.select(
        "conv_id",
        (F.col("k") + 1).alias("example"),
        F.when(is_target, F.concat(text(F.slice("w", F.lit(1), F.col("cut") - 1)), last["head"])).otherwise(text("w")).alias("context"),
        F.when(is_target, last["body"]).alias("target"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), losses array of text, formatted_chars), parsed from formatted examples."""
    full = F.concat("context", F.coalesce("target", F.lit("")))
    reply = F.expr(f"left(target, length(target) - {len(END)})")
    per = examples.groupBy("conv_id").agg(
        F.max_by(full, "example").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", unescape(reply).alias("text"))))).alias("losses"),
        F.sum(F.length("context") + F.coalesce(F.length("target"), F.lit(0))).cast("long").alias("formatted_chars"),
    )
    parts = F.split("longest", "</s>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    head = lambda p: F.substring_index(p, CLOSE, 1)
    turn = lambda p: F.struct(unescape(F.substr(head(p), F.lit(len(BEGIN) + 1))).alias("role"), unescape(F.substr(p, F.length(head(p)) + F.lit(len(CLOSE) + 1))).alias("text"))
    return per.select("conv_id", F.transform(parts, turn).alias("turns"), F.transform("losses", lambda x: x["text"]).alias("losses"), "formatted_chars")


def chat_digest(turns: DataFrame) -> DataFrame:
    """The digest columns of every conversation, derived from what read_back finds in the formatted examples."""
    back = read_back(format_chat(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
