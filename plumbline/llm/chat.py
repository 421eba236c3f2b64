"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, its reply as the only trainable text, given by a span of code points.
Turns behind the last reply are context of no reply; they follow as one more
example without trainable text (target null), so that a conversation can be read
back whole from its examples.

The template writes a turn between two marks by its role. Marks that occur in a
text are escaped with one more backslash behind their first character, however
many are there already, which unescaping takes away again.

A conversation is gathered as one array of turns, because each of its examples
holds the turns before; its examples are made one by one, so a task holds the
conversation and one example, whose sizes add up to the square of the number
of turns in the output alone.

Defined cases: rows with equal turn numbers are ordered by role, then text, and
repeated rows are turns of their own; a null turn comes first; a null role is
written as an empty one, a null text as an empty text; a role without marks of
its own is written as text and read back; rows of a null conversation id are
one conversation; a conversation without replies has one example without
trainable text; very long texts are formatted whole; an empty table gives an
empty result; other columns of the input are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINABLE = "assistant"

# The marks of the template by role, and those of any other role.
MARKS = {
    "system": ("[SYS] ", " [/SYS]"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
ROLE_OPEN, ROLE_CLOSE, ROLE_END = "[ROLE] ", " [/ROLE]", " [/TURN]"
CONTROL = ["[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"]
CLOSING = [close.strip() for _, close in MARKS.values()] + [ROLE_END.strip()]

# A control string, with any number of backslashes behind its first character.
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
PLAIN = rf"([\[<])(\\*)({_TAILS})"
ESCAPED = rf"([\[<])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    """No mark of the template is left in the text; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _by_role(role: Column, side: int, other: Column) -> Column:
    marks = F
    for name, pair in MARKS.items():
        marks = marks.when(role == name, F.lit(pair[side]))
    return marks.otherwise(other)


def segments(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id and parts, its formatted turns in order."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))

    def part(t: Column) -> Column:
        opened = _by_role(t["role"], 0, F.concat(F.lit(ROLE_OPEN), escape(t["role"]), F.lit(ROLE_CLOSE)))
        return F.struct(
            (t["role"] == TRAINABLE).alias("trainable"),
            t["turn"].alias("turn"),
            opened.alias("opened"),
            escape(t["text"]).alias("body"),
            _by_role(t["role"], 1, F.lit(ROLE_END)).alias("closed"),
        )

    return gathered.select("conv_id", F.transform("said", part).alias("parts"))


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 1), target (turn or null), last, text, loss_start, loss_end.

    The span counts code points from 0, its end is exclusive.
    """
    written = segments(turns, conv_id, turn, role, text).select(
        "conv_id",
        "parts",
        F.transform("parts", lambda p: F.concat(p["opened"], p["body"], p["closed"])).alias("lines"),
        F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: _target(i)).alias("ends"),
    )
    exploded = written.select("conv_id", "parts", "lines", F.size("ends").alias("n"), F.posexplode("ends").alias("nth", "end"))
    goal = F.get("parts", F.col("end") - 1)
    built = exploded.select(
        "conv_id",
        (F.col("nth") + 1).alias("example"),
        F.when(goal["trainable"], goal["turn"]).alias("target"),
        (F.col("nth") + 1 == F.col("n")).alias("last"),
        F.array_join(F.slice("lines", F.lit(1), F.col("end")), "").alias("text"),
        goal.alias("goal"),
    )
    # The reply stands before its closing mark; without a reply the span is empty, at the end.
    stop = F.length("text") - F.when(F.col("goal.trainable"), F.length("goal.closed")).otherwise(0)
    start = stop - F.when(F.col("goal.trainable"), F.length("goal.body")).otherwise(0)
    return built.select("conv_id", "example", "target", "last", "text", start.alias("loss_start"), stop.alias("loss_end"))


def _target(i: Column) -> Column:
    """Whether an example ends with the i-th turn: with every reply, and with the last turn of all."""
    return F.get("parts", i - 1)["trainable"] | (i == F.size("parts"))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(text, start + 1, end - start))


def read_turns(text: Column) -> Column:
    """role and text of every turn of a formatted text."""
    behind = "|".join(re.escape(c) for c in CLOSING)
    lines = F.filter(F.split(text, f"(?<={behind})"), lambda s: s != "")

    def turn(line: Column) -> Column:
        # A role of its own ends at the first unescaped mark behind it.
        role_end = F.instr(line, ROLE_CLOSE)
        role = F.substring(line, F.lit(len(ROLE_OPEN) + 1), role_end - 1 - len(ROLE_OPEN))
        first = role_end + len(ROLE_CLOSE)
        body = F.substring(line, first, F.length(line) - first + 1 - len(ROLE_END))
        read = F
        for name, (opened, closed) in MARKS.items():
            inner = F.substring(line, F.lit(len(opened) + 1), F.length(line) - len(opened) - len(closed))
            read = read.when(F.startswith(line, F.lit(opened)), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text")))
        return read.otherwise(F.struct(unescape(role).alias("role"), unescape(body).alias("text")))

    return F.transform(lines, turn)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say when read back.

    Turns come from the last example, which holds them all; trainable texts from
    the span of each. Only those and the sizes are gathered, never the examples.
    """
    turns = read_turns(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        F.when(F.col("last"), F.struct(F.size(turns).cast("bigint").alias("n"), F.sha2(said.cast("binary"), 256).alias("sha"))).alias("whole"),
        F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")).alias("learnt"),
        F.length("text").cast("bigint").alias("chars"),
    )
    gathered = read.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.array_sort(F.collect_list("learnt")).alias("learnt"), F.sum("chars").alias("chars")
    )
    loss = F.array_join(F.transform("learnt", lambda x: x["loss"]), "")
    return gathered.select(
        "conv_id",
        F.col("whole.n").alias("n_turns"),
        F.col("whole.sha").alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
