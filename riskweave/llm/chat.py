"""Operator 5: chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one
role are merged by an array aggregation, and the messages are concatenated.  The
result carries the loss mask as spans (start, length in code points) of the text that
a model is trained on.

Template: a message is ``<|@role|>text<|end|>``; texts that were merged are parted by
``<|sep|>``.  In texts and roles a backslash is doubled, and one is put inside whatever
could begin or end a control string of this or another common template (``<|``,
``|>``, ``</``, ``<s``, ``<<``, ``[I``, ``[/``), so no control string survives in a
text and ``unescape`` gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, ROLE_END, SEP, END = "<|@", "|>", "<|sep|>", "<|end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=[|/s<])|\|(?=>)|\[(?=[I/])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _merged(turns: Column) -> Column:
    """Messages (role, texts) from sorted turns; adjacent turns of one role share one."""
    empty = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")

    def add(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        more = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        return (F.when(F.size(done) == 0, F.array(new))
                .when(last["role"] == turn["role"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more)))
                .otherwise(F.concat(done, F.array(new))))

    return F.aggregate(turns, empty, add)


def _message(m: Column) -> Column:
    return F.concat(F.lit(ROLE), m["role"], F.lit(ROLE_END), F.array_join(m["texts"], SEP), F.lit(END))


def _spans(messages: Column, loss_role: str) -> Column:
    """Spans of the texts of ``loss_role`` in the concatenated messages."""
    start = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>))")

    def text_span(state: Column, text: Column) -> Column:
        span = F.struct(state["at"].alias("start"), F.length(text).cast("long").alias("length"))
        return F.struct((state["at"] + F.length(text) + len(SEP)).cast("long").alias("at"),
                        F.concat(state["spans"], F.array(span)).alias("spans"))

    def add(state: Column, m: Column) -> Column:
        first = (state["at"] + len(ROLE) + F.length(m["role"]) + len(ROLE_END)).cast("long")
        inside = F.aggregate(m["texts"], F.struct(first.alias("at"), state["spans"].alias("spans")), text_span)
        return F.struct((state["at"] + F.length(_message(m))).cast("long").alias("at"),
                        F.when(m["role"] == loss_role, inside["spans"]).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(messages, start, add)["spans"]


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans.

    Turns are ordered by turn, null first, ties by role and then text.  A null text or
    role counts as empty, a null conv_id is a conversation of its own; rows that repeat
    are turns each.  A text of any length is kept whole.  Other columns are not read, an
    empty table gives no rows."""
    by_role, by_text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    one = F.struct(F.col(turn).alias("turn"), by_role.alias("by_role"), by_text.alias("by_text"),
                   escape(by_role).alias("role"), escape(by_text).alias("text"))
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    chats = chats.select("conv_id", _merged(F.col("turns")).alias("messages"))
    return chats.select(
        "conv_id", F.array_join(F.transform("messages", _message), "").alias("formatted"),
        _spans(F.col("messages"), loss_role).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    parts = F.split(formatted, r"<\|end\|>")
    messages = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turns(message: Column) -> Column:
        role = F.substring_index(F.substring(message, len(ROLE) + 1, 2147483647), ROLE_END, 1)
        body = F.substr(message, F.length(role) + len(ROLE) + len(ROLE_END) + 1)
        return F.transform(F.split(body, r"<\|sep\|>"),
                           lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all
    read back from the formatted text and its mask."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
