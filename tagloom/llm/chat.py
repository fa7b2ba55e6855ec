"""Chat formatting: every assistant turn becomes a training example of its own.

An example holds all turns before an assistant turn as context and that reply as
the only trainable part. Turns are marked by control strings; control strings
inside roles and texts are escaped, and the escape is undone on reading. All of
it is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Where a control string of a common chat template starts; a backslash breaks it after the first character.
_CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>|/?SYS>)"


def escape(text: Column) -> Column:
    """No control string is left in the result; `unescape` gives the text back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """One row per example: id_col, example (from 0), n_turns, formatted,
    loss_start, loss_chars (code points of `formatted`, start from 0).

    Turns are in order of turn, then role and text, nulls first. A null role or
    text is an empty one. Turns after the last reply, or a conversation without
    any, are an example with nothing to train on, so that every turn is written
    once at least. Repeated rows are turns each. Rows with a null id are one
    conversation. No row gives no example.
    """
    turns = conversations.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    marked = turns.select(
        "id", "turn", "role", "text", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == assistant).alias("reply")
    )
    whole = marked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body", "reply"))).alias("turns"))
    n = F.size("turns")
    last = F.element_at("turns", -1)["reply"]
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at("turns", k)["reply"])
    ends = F.when(last, ends).otherwise(F.concat(ends, F.array(n)))
    each = whole.select("id", "turns", F.posexplode(ends).alias("example", "stop"))
    stop = F.element_at("turns", F.col("stop"))
    context = F.array_join(F.transform(F.slice("turns", 1, F.col("stop") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    prompt = F.concat(context, stop["head"])
    made = each.select("id", "example", F.col("stop").alias("n_turns"), prompt.alias("prompt"), stop["body"].alias("body"), stop["reply"].alias("reply"))
    return made.select(
        F.col("id").alias(id_col),
        "example",
        "n_turns",
        F.concat("prompt", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("prompt").cast("long").alias("loss_start"),
        F.when(F.col("reply"), F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted example."""
    parts = F.split(formatted, r"<\|im_end\|>")
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1))
    return F.transform(inner, lambda p: F.struct(unescape(F.substring_index(p, MIDDLE, 1)).alias("role"), unescape(F.substring_index(p, MIDDLE, -1)).alias("text")))


def read_trained() -> Column:
    """The text under an example's loss mask as it was before escaping."""
    return unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """`examples` with `turns` and `trained` read from `formatted`."""
    return examples.withColumns({"turns": read_turns(F.col("formatted")), "trained": read_trained()})


def digests(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, all read back from the examples: turns and their
    digest from the longest example, trained text and its digest from all."""
    back = examples.select(id_col, "example", "formatted", read_trained().alias("trained"), F.length("formatted").cast("long").alias("chars"))
    per = back.groupBy(id_col).agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"]), "").alias("trained"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    ).withColumn("turns", read_turns(F.col("longest")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
