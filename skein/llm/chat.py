"""Chat formatting without Python on the executors: logged snapshots of a growing conversation collapse to the longest one, then turns render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.shared import settle

#: Turns whose numbers fall into one block are ordered together; a conversation of any length is dealt over its blocks.
BLOCK = 256
#: The block of turns without a number, before all others.
_FIRST = -(1 << 62)


def _flagged(c: str) -> list[Column]:
    """A value and whether it is null: null and empty differ."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()]


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, n, h1, h2): for each turn, its place from 1 on, the conversation's number of turns, and 128 bits that are the same for
    two conversations where their first `at` turns have the same roles and texts. The hash rolls: it is the exclusive or of place-salted
    turn hashes. Turns of one number are in order of role and text, as they are rendered."""
    hashed = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce(F.floor(F.col("turn") / block), F.lit(_FIRST)).alias("block"),
        F.xxhash64(F.lit(1), *_flagged("role"), *_flagged("text")).alias("t1"),
        F.xxhash64(F.lit(2), *_flagged("text"), *_flagged("role")).alias("t2"),
        "role", "text",
    ).dropDuplicates(["conv_id", "block", "turn", "t1", "t2"])
    by_block = Window.partitionBy("conv_id", "block").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    local = hashed.withColumn("place", F.row_number().over(by_block)).drop("role", "text")
    sizes = local.groupBy("conv_id", "block").agg(F.count("*").alias("m"))
    order = Window.partitionBy("conv_id").orderBy("block")
    offsets = sizes.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        (F.sum("m").over(order) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("n"),
    )
    placed = local.join(offsets, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b"))).select(
        "conv_id", "block", "place", "n", (F.col("place") + F.col("before")).alias("at"), "t1", "t2"
    ).withColumns({"s1": F.xxhash64("at", "t1", "t2"), "s2": F.xxhash64("t2", "at", "t1")})
    rolling = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = placed.withColumns({"l1": F.bit_xor("s1").over(rolling), "l2": F.bit_xor("s2").over(rolling)})
    totals = placed.groupBy("conv_id", "block").agg(F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("c2"),
    )
    return rolled.join(carried, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b"))).select(
        "conv_id", "at", "n", F.col("l1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("l2").bitwiseXOR(F.col("c2")).alias("h2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another; of equal ones the smallest conv_id stays
    and n_copies counts them."""
    hashes = settle(prefix_hashes(turns), "op2-prefixes")
    whole = hashes.where("at = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = hashes.where("at < n").select(F.col("at").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """kept with the column rendered: its turns in order, each start + role + newline + text + end + newline; null roles and texts are empty.
    Order: turn (nulls first), role, text; a row repeated in all of these counts once."""
    turn = F.struct("turn", F.col("role"), F.col("text"))
    lists = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    ordered = F.sort_array("turns")
    said = F.transform(ordered, lambda x: F.concat(F.lit(start), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(end + "\n")))
    return kept.join(lists.select("conv_id", F.concat_ws("", said).alias("rendered")), "conv_id")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations.

    Rows with a null conv_id belong to no conversation. Turns are ordered by turn, nulls first; rows repeated in conv_id, turn, role and
    text count once; null and empty texts differ when prefixes are compared and render alike. Other columns are ignored. Empty in, empty out.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    return render(turns, maximal(turns))
