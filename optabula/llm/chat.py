"""Chat formatting: snapshots of growing conversations collapse to the longest, then are rendered.

A log holds a conversation once per saved state, each state a prefix of the next. Every turn gets
the hash of all turns up to it, rolled on by exclusive or of position-bound turn hashes, twice with
64 bits. A conversation whose last hash is another one's inner hash is its prefix: one anti-join
against the distinct inner hashes keeps the maximal ones. Turn texts move once, for rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def logged_turns(conversations: DataFrame) -> DataFrame:
    """conv_key, conv_id, turn, role, text, c1, c2: the turns as logged, with content hashes."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    own = F.concat(F.lit("row "), F.monotonically_increasing_id())
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), own).alias("conv_key"), "*",
        _hash(1, "role", "text").alias("c1"), _hash(2, "role", "text").alias("c2"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_key, conv_id, pos from 1, and the 128-bit hash p1, p2 of the turns up to pos.

    A row that repeats its conversation's turn number, role and text counts once.
    """
    in_turn = Window.partitionBy("conv_key").orderBy("turn", "c1", "c2")
    here = F.struct("turn", "c1", "c2")
    once = (turns.select("conv_key", "conv_id", "turn", "c1", "c2")
            .withColumn("repeats", here.eqNullSafe(F.lag(here).over(in_turn)))
            .where(~F.col("repeats")).drop("repeats")
            .withColumn("pos", F.row_number().over(in_turn)))
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return once.select(
        "conv_key", "conv_id", "pos",
        F.bit_xor(_hash(3, "pos", "c1", "c2")).over(so_far).alias("p1"),
        F.bit_xor(_hash(4, "pos", "c1", "c2")).over(so_far).alias("p2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_key, conv_id, n_turns, n_copies: one of each conversation that prefixes no longer one."""
    hashes = prefix_hashes(turns)
    ends = hashes.groupBy("conv_key", "conv_id").agg(
        F.max(F.struct("pos", "p1", "p2")).alias("end"))
    inner = (hashes.join(ends.select("conv_key", F.col("end.pos").alias("n")), "conv_key")
             .where("pos < n").select("p1", "p2", "pos").distinct())
    # Equal conversations are one before the join, so that it sees each hash once on either side.
    whole = ends.groupBy("end.p1", "end.p2", "end.pos").agg(
        F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "conv_key")).alias("first"),
        F.count(F.lit(1)).alias("n_copies"))
    return whole.join(inner, ["p1", "p2", "pos"], "left_anti").select(
        "first.conv_key", "first.conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>",
                 ) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, text.

    Turns are ordered by turn number (nulls first), then content. Equal conversations are kept
    once, under the least conv_id, and counted in `n_copies`. A rendered turn is `start`, role, line
    end, text, `end`, line end; null roles and texts are empty. Every row without conv_id is a
    conversation of its own. Repeated rows count once; an empty table gives no rows; other columns
    are ignored. A conversation is one training example and must fit in a row.
    """
    turns = logged_turns(conversations)
    kept = maximal_conversations(turns)
    rendered = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(f"{end}\n"))
    # Rows without conv_id are rendered from their own row: their key is not stable across scans.
    with_id = (turns.where("conv_id IS NOT NULL")
               .join(kept.where("conv_id IS NOT NULL").drop("conv_id"), "conv_key")
               .groupBy("conv_id").agg(
                   F.sort_array(F.collect_set(F.struct("turn", "c1", "c2", rendered.alias("r")))).alias("t"),
                   F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"))
               .select("conv_id", "n_turns", "n_copies", F.array_join("t.r", "").alias("text")))
    alone = (turns.where("conv_id IS NULL").groupBy("role", "text").agg(
        F.count(F.lit(1)).alias("n_copies"))
        .withColumns({"pos": F.lit(1), "c1": _hash(1, "role", "text"), "c2": _hash(2, "role", "text")})
        .withColumns({"p1": _hash(3, "pos", "c1", "c2"), "p2": _hash(4, "pos", "c1", "c2")}))
    identified = prefix_hashes(turns.where("conv_id IS NOT NULL"))
    without_id = alone.join(
        identified.where("pos = 1").select("p1", "p2").distinct(), ["p1", "p2"], "left_anti").select(
        F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.lit(1).cast("long").alias("n_turns"), "n_copies", rendered.alias("text"))
    return with_id.unionByName(without_id)
