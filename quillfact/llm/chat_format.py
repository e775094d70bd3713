"""Chat logs: cumulative snapshots collapse into their longest conversation, then turns are rendered.

A conversation logged after every turn leaves snapshots that are prefixes of each other. Each turn gets two 64-bit
hashes of (ordinal, role, text); their running XOR over a conversation is a rolling hash of each turn-prefix.
A conversation whose whole hash is a proper prefix hash of another one is dropped by an anti-join; of equal
conversations the smallest conv_id stays. Ordinals and running hashes are made in blocks of turns with block offsets
added afterwards, so a very long conversation is spread over tasks, and rendering gives one row a turn: nothing
collects a conversation into one row.

Defined results: turns are ordered by turn, role, text (nulls first); repeated rows count as turns of their own; a
null role or text is rendered as empty (and hashed so); rows without conv_id form one conversation whose id is null;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfact.llm.common import settle

BLOCK = 256
NO_ID = -(2**63)


def numbered(turns: DataFrame) -> DataFrame:
    """key, ord (from 1), role, text, p1, p2: every turn with the hash of the prefix that ends in it."""
    base = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(NO_ID)).cast("long").alias("block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    sizes = base.groupBy("key", "block").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    turns = base.join(sizes.select("key", "block", "offset"), ["key", "block"]).withColumn("ord", F.col("offset") + F.row_number().over(in_block))
    turns = turns.withColumn("t1", F.xxhash64("ord", "role", "text")).withColumn("t2", F.xxhash64(F.lit(11), "ord", "role", "text"))
    turns = settle(turns.select("key", "block", "ord", "role", "text", *[F.bit_xor(t).over(in_block.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)).alias(t) for t in ("t1", "t2")]))
    whole = turns.groupBy("key", "block").agg(*[F.max_by(t, "ord").alias(t) for t in ("t1", "t2")])
    whole = whole.select("key", "block", *[F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(f"b{t}") for t in ("t1", "t2")])
    return turns.join(whole, ["key", "block"]).select("key", "ord", "role", "text", F.col("t1").bitwiseXOR(F.col("bt1")).alias("p1"), F.col("t2").bitwiseXOR(F.col("bt2")).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """key, n_turns of the conversations that prefix no longer one, one of each set of equal ones."""
    ends = turns.groupBy("key").agg(F.max("ord").alias("n_turns"))
    marked = turns.join(ends, "key").select("key", "ord", "n_turns", "p1", "p2")
    prefixes = marked.where("ord < n_turns").select(F.col("ord").alias("n_turns"), "p1", "p2").distinct()
    whole = marked.where("ord = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("key").alias("key"))
    return whole.join(prefixes, ["n_turns", "p1", "p2"], "left_anti").select("key", "n_turns")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_index, n_turns, role, rendered: the turns of maximal conversations in ChatML."""
    turns = settle(numbered(conversations))
    kept = turns.join(maximal(turns), "key")
    return kept.select(
        F.nullif("key", F.lit(NO_ID)).alias("conv_id"), F.col("ord").cast("long").alias("turn_index"), F.col("n_turns").cast("long").alias("n_turns"), "role",
        F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("rendered"),
    )
