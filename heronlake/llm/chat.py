"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the context,
and only that reply is trainable.  A conversation that doesn't end with an assistant turn
also gives one example without a trainable span, so that the output holds every turn.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  Inside roles and
texts a backslash doubles and ``<|`` becomes ``<\\|`` (in roles, a newline is preceded by a
backslash), so no text can hold a mark; :func:`unescape` is the exact inverse.

Null texts and roles are empty; null turns come first; rows with equal turns are ordered
by role and text, repeated rows are turns of their own; a null conversation is one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(END + "\n"))


def examples(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """*key*, ``example`` (position of its last turn), ``formatted``, ``loss_start`` and
    ``loss_length`` (code points of the one trainable span; length 0 and start at the end if none)."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = conversations.select(F.col(key), row.alias("t")).groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    pieces = grouped.select(key, "turns", F.transform("turns", rendered).alias("pieces"))
    last = F.size("turns") - 1
    one = pieces.select(key, F.posexplode("turns").alias("example", "t"), "pieces", last.alias("last"))
    one = one.where((F.col("t.role") == "assistant") | (F.col("example") == F.col("last")))
    trains = F.col("t.role") == "assistant"
    before = F.concat_ws("", F.slice("pieces", F.lit(1), F.col("example")))
    whole = F.concat(before, F.element_at("pieces", F.col("example") + 1))
    head = F.length(before) + len(START) + len("assistant\n")
    return one.select(
        key, "example", whole.alias("formatted"),
        F.when(trains, head).otherwise(F.length(whole)).cast("long").alias("loss_start"),
        F.when(trains, F.length(escape(F.col("t.text")))).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of structs of role and text."""
    parts = F.split(formatted, r"<\|im_start\|>")
    role = lambda p: F.regexp_extract(p, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
    body = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 2 - len(END))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def digest(expanded: DataFrame, key: str = "conv_id") -> DataFrame:
    """The contract's columns, read back from :func:`examples`'s output."""
    span = F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))
    per = expanded.select(key, "example", "formatted", unescape(span).alias("reply")).groupBy(key).agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns, learnt = read_back(F.col("longest")), F.concat_ws("", F.col("replies.reply"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return per.select(key, turns.alias("turns"), learnt.alias("learnt"), "formatted_chars", "n_examples").select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_examples",
    )
