"""Preference formatting: the longest common turn prefix once as prompt, then a masked completion for either side.

A pair is two lists of turns (role, text). The prompt is the rendering of the turns that both begin with; a completion
is the rendering of the rest of its side. Its mask lists the spans, in characters of the completion, that a loss may
count: text and end mark of the assistant's turns, never headers or other roles. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn: before the role, between role and text, after the text.
MARKS = ("<|start|>", "\n", "<|end|>\n")
ASSISTANT = "assistant"


def conversations_of(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (key, turns): a conversation's turns in order, ties by role, then text; repeated turns count once.

    Null roles and texts are empty, null positions come first; rows without a key belong to no conversation.
    """
    one = F.struct(F.col(order).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set(one)).alias("all"))
    return rows.select("key", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def pairs_of(conversations: DataFrame) -> DataFrame:
    """Rows (key, chosen, rejected) from unrated conversations (key: long, turns).

    Chosen is the conversation up to its last assistant turn. Rejected is the same with one reply, the k-th of m by
    k = key modulo m, replaced by one to another question: the last reply of the conversation whose key differs in the
    lowest bit, or, where there is none, the conversation's own first reply; where that is the only one, the empty reply.
    So sides part at any reply and may go on for several turns, or never part. Conversations without an assistant turn
    make no pair. The join is on unique keys.
    """
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == ASSISTANT)
    rows = conversations.where(F.exists("turns", lambda t: t["role"] == ASSISTANT)).withColumn("places", places)
    rows = rows.select(
        "key", F.slice("turns", F.lit(1), F.element_at("places", -1)).alias("chosen"), F.element_at("places", (F.pmod("key", F.size("places")) + 1).cast("int")).alias("swapped"),
        F.when(F.size("places") > 1, F.element_at("turns", F.element_at("places", 1))["text"]).alias("own"),
    )
    reply = rows.select(F.col("key").bitwiseXOR(F.lit(1)).alias("key"), F.element_at("chosen", -1)["text"].alias("other"))
    rows = rows.join(reply, "key", "left")
    other = F.struct(F.lit(ASSISTANT).alias("role"), F.coalesce("other", "own", F.lit("")).alias("text"))
    rejected = F.transform("chosen", lambda t, i: F.when(i + 1 == F.col("swapped"), other).otherwise(t))
    return rows.select("key", "chosen", rejected.alias("rejected"))


def _rendered(turn: Column, marks) -> Column:
    return F.concat(F.lit(marks[0]), turn["role"], F.lit(marks[1]), turn["text"], F.lit(marks[2]))


def _joined(turns: Column, marks) -> Column:
    return F.array_join(F.transform(turns, lambda t: _rendered(t, marks)), "")


def _spans(turns: Column, marks) -> Column:
    """The mask of a completion: an array of (start, end)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, turn):
        head = state["at"] + F.lit(len(marks[0] + marks[1])) + F.char_length(turn["role"])
        end = head + F.char_length(turn["text"]) + F.lit(len(marks[2]))
        span = F.array(F.struct(head.cast("int").alias("start"), end.cast("int").alias("end")))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def formatted(pairs: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Rows (key, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of pairs (key, chosen, rejected).

    A row per row of ``pairs``; extra columns are not read. A null side counts as no turns, null turns, roles and texts as
    empty. Sides that agree throughout give two empty completions; sides that differ at once give an empty prompt. Turns
    are compared and rendered whole, however long. Empty tables give no rows.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    whole = lambda side: F.transform(
        F.coalesce(side, none), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    )
    rows = pairs.select("key", whole(F.col("chosen")).alias("a"), whole(F.col("rejected")).alias("b"))
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(differs > 0, differs - 1).otherwise(F.greatest(F.size("a"), F.size("b"))).cast("int")
    rows = rows.withColumn("n_common", common)
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    return rows.select(
        "key", "n_common", _joined(F.slice("a", F.lit(1), F.col("n_common")), marks).alias("prompt"),
        _joined(rest("a"), marks).alias("chosen"), _joined(rest("b"), marks).alias("rejected"),
        _spans(rest("a"), marks).alias("chosen_mask"), _spans(rest("b"), marks).alias("rejected_mask"),
    )


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
