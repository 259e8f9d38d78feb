"""Chat formatting with Spark expressions only.

A conversation's turns (sorted structs of turn, role, text) become one text. Adjacent turns of one role share a block,
``<|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n``. Inside roles and texts ``~`` becomes ``~0``, ``<|`` becomes ``~1`` and,
in roles, a line feed ``~2``, so control marks occur only where the template puts them and :func:`read` gives the turns back
exactly. Texts of ``assistant`` blocks are under the loss mask; marks and separators are not.

Defined results: null roles and texts are empty. Turns with equal numbers are ordered by role, then text; null turn numbers
come first. Rows with a null conv_id are one conversation. Every row is a turn, repeated rows included. One conversation is
one row of the result, so its whole text must fit in a row (2 GB); conversations spread over executors, and their lists
are built from partial lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _pattern(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` from ``conv_id, turn, role, text``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        name = F.replace(escape(t["role"]), F.lit("\n"), F.lit("~2"))
        head = F.when(before.eqNullSafe(t["role"]), F.lit(SEP)).otherwise(F.concat(F.lit(START), name, F.lit("\n")))
        return F.concat(head, escape(t["text"]), F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END)))

    return listed.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"))


def read(chats: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns`` (array of role, text, loss) from ``conv_id, formatted``."""

    def turns_of(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        name = unescape(F.replace(F.substring_index(body, "\n", 1), F.lit("~2"), F.lit("\n")))
        said = F.split(F.substring(body, F.instr(body, "\n") + 1, F.length(body)), _pattern(SEP), -1)
        return F.transform(said, lambda t: F.struct(name.alias("role"), unescape(t).alias("text"), (name == LOSS_ROLE).alias("loss")))

    blocks = F.filter(F.split("formatted", _pattern(END), -1), lambda b: b != "")
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """What :func:`read` finds in the formatted texts, as counts and digests."""
    back = read(chats)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), spoken.alias("spoken"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id", "n_turns", F.sha2("spoken", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
