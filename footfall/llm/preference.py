"""Preference formatting: the longest common turn prefix as prompt, and paired completions with loss masks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import running_sums, stored

TRAINED = "assistant"
TURN = "struct<role: string, text: string>"


def conversations(turns: DataFrame, key: str) -> DataFrame:
    """Turns (key, turn, role, text) to one row per key with the turns in order.

    A conversation is one record of the output, so its own turns come together. Null roles count as ``user``, null texts as
    empty; equal turn numbers go by role and text, null ones first; repeated turns stay.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(row))
    return turns.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False).cast("int")
    return F.when(first == 0, n).otherwise(first - 1)


def _heading(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_heading(t), t["text"], F.lit("<|end|>\n"))), "")


def mask(turns: Column) -> Column:
    """start:end of the characters to learn (texts of trained turns with their end marks), comma-joined."""
    lengths = F.transform(turns, lambda t: F.length(_heading(t)) + F.length(t["text"]) + F.lit(len("<|end|>\n")))
    placed = F.zip_with(turns, running_sums(lengths), lambda t, at: F.when(t["role"] == TRAINED, F.concat_ws(
        ":", (at + F.length(_heading(t))).cast("string"), (at + F.length(_heading(t)) + F.length(t["text"]) + F.lit(len("<|end|>"))).cast("string"))))
    return F.array_join(placed, ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(..., chosen, rejected: arrays of turns) to the other columns with prompt, shared_turns, completions and their masks.

    The prompt is the common prefix, rendered once. Where one conversation continues the other, the shorter completion is
    empty; equal conversations have two empty completions. A null conversation counts as one without turns.
    """
    empty = F.expr(f"cast(array() as array<{TURN}>)")
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    rows = pairs.select(*kept, F.coalesce("chosen", empty).alias("_c"), F.coalesce("rejected", empty).alias("_r"))
    rows = rows.withColumn("shared_turns", common_turns(F.col("_c"), F.col("_r")))
    out = [render(F.slice("_c", F.lit(1), F.col("shared_turns"))).alias("prompt")]
    for name in ("c", "r"):
        rest = F.slice(f"_{name}", F.col("shared_turns") + 1, F.size(f"_{name}"))
        full = {"c": "chosen", "r": "rejected"}[name]
        out += [render(rest).alias(full), mask(rest).alias(f"{full}_mask")]
    return rows.select(*kept, "shared_turns", *out)


def following(keys: DataFrame, key: str) -> DataFrame:
    """Each of the distinct keys with ``next``, the one that follows it in order; the first one follows the last.

    Keys are sorted in ranges. What a range passes on is its first key, so only one row a range comes together.
    """
    ranges = stored(keys.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = ranges.withColumn("next", F.lead(key).over(Window.partitionBy("_range").orderBy(key)))
    heads = ranges.groupBy("_range").agg(F.min(key).alias("_head"))
    every = Window.orderBy("_range")
    whole = Window.partitionBy()
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(every), F.min("_head").over(whole)).alias("_after"))
    return inside.join(heads, "_range").select(key, F.coalesce("next", "_after").alias("next"))


def parted(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs from plain conversations: each is chosen whole; rejected leaves it at one of its replies for the course of another.

    A conversation with m replies is left at reply j = 1 + key mod m; from there on, rejected goes on with the turns of the
    conversation that follows in the order of ids (the first one follows the last), from its reply j, or its last if it has
    fewer. Every conversation with an id and a reply makes one pair and keeps all its turns; those without cannot make one. A single
    conversation is its own partner, and a partner may take the same course: such pairs have equal sides and empty completions.
    """
    whole = conversations(turns.filter(F.col(key).isNotNull()), key)
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1)), lambda i: i.isNotNull())
    whole = stored(whole.withColumn("replies", replies).filter(F.size("replies") > 0), "conversations")
    pairs = following(whole.select(key), key)
    other = whole.select(F.col(key).alias("next"), F.col("turns").alias("_turns"), F.col("replies").alias("_replies"))
    j = (F.pmod(F.col(key), F.size("replies")) + 1).cast("int")
    both = whole.join(pairs, key).join(other, "next").withColumn("_j", j)
    left_at = F.element_at("replies", F.col("_j"))
    taken_up = F.element_at("_replies", F.least("_j", F.size("_replies")))
    rejected = F.concat(F.slice("turns", F.lit(1), left_at - 1), F.slice("_turns", taken_up, F.size("_turns")))
    return both.select(key, F.col("turns").alias("chosen"), rejected.alias("rejected"))
