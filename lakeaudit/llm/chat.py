"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it as
context, its own text alone trainable. A turn reads

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside roles and texts get a backslash after their first
character, backslashes are doubled, and a line break in a role gets one too, so
that every marker in the output is a real one and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>\n"
TARGET_ROLE = "assistant"

# Control strings of common chat templates, as first character and rest.
CONTROL = (
    ("<", "|"),
    ("<", "s>"),
    ("<", "/s>"),
    ("<", "<SYS>>"),
    ("<", "</SYS>>"),
    ("[", "INST]"),
    ("[", "/INST]"),
)
_FOUND = "|".join(rf"{'\\[' if a == '[' else a}(?=\Q{b}\E)" for a, b in CONTROL)


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_FOUND})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _piece(turn: Column) -> Column:
    role = F.regexp_replace(escaped(F.coalesce(turn["role"], F.lit(""))), "\n", "\\\\\n")
    return F.concat(F.lit(START), role, F.lit("\n"), escaped(F.coalesce(turn["text"], F.lit(""))), F.lit(END))


def examples(turns: DataFrame) -> DataFrame:
    """One row per example of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, example (from 0), text, loss_start, loss_end: the code points
    [loss_start, loss_end) of ``text`` are trainable. Turns behind the last assistant
    turn (or of a conversation without one) come as one more example with an empty
    span, so no turn is lost.

    Rows are ordered by turn, then role, then text; repeated rows and ties stay. A
    null text or role is empty, a null turn comes first, rows of null conv_id are one
    conversation. Further columns are not read. An empty table gives no rows. The
    rows of a conversation form one record, as its last example does; the output
    itself grows with the square of a conversation's turns.
    """
    t = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    talks = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.select(
        "conv_id",
        F.transform("turns", _piece).alias("pieces"),
        F.transform("turns", lambda x: F.coalesce(x["role"], F.lit("")) == TARGET_ROLE).alias("targets"),
        F.transform("turns", lambda x: F.length(escaped(F.coalesce(x["text"], F.lit(""))))).alias("sizes"),
    )
    size = F.size("targets")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("targets", i) | (i == size))
    rows = talks.select("*", F.posexplode(ends).alias("example", "upto"))
    rows = rows.select(
        "conv_id",
        F.col("example").cast("long"),
        F.array_join(F.slice("pieces", 1, F.col("upto")), "").alias("text"),
        F.when(F.element_at("targets", F.col("upto")), F.element_at("sizes", F.col("upto"))).otherwise(0).alias("trained"),
    )
    stop = F.length("text") - len(END)
    return rows.select("conv_id", "example", "text", (stop - F.col("trained")).alias("loss_start"), stop.alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: its turns and its trained text again, from the examples alone."""
    target = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = formatted.select("conv_id", "example", "text", unescaped(target).alias("target"))
    talks = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.sort_array(F.collect_list(F.struct("example", "target"))).alias("targets"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    parts = F.array_remove(F.split("text", rf"\Q{START}\E"), "")
    bodies = F.transform(parts, lambda p: F.substring(p, F.lit(1), F.length(p) - len(END)))
    head = r"(?s)^((?:\\.|[^\\\n])*)\n(.*)$"
    turns = F.transform(
        bodies,
        lambda b: F.struct(
            unescaped(F.regexp_extract(b, head, 1)).alias("role"),
            unescaped(F.regexp_extract(b, head, 2)).alias("text"),
        ),
    )
    trained = F.array_join(F.transform("targets", lambda x: x["target"]), "")
    return talks.select("conv_id", turns.alias("turns"), trained.alias("trained"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from what ``read_back`` reads."""
    talk = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(talk, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
