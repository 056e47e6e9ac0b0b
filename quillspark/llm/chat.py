"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after each turn. A rolling hash over the turns identifies every prefix of every
conversation; a conversation whose whole-hash is a proper prefix hash of another is dropped by an anti-join, and of equal
conversations the one with the smallest id stays. What is left is rendered with a chat template, in segments of a bounded
number of turns, so that no conversation has to fit into one row.

No conversation has to fit into one task either: turns are dealt by ranges of (conversation, turn, role, text), numbered
where they lie, and hashed in blocks of places; what a task sees of a whole conversation is one row per range or block.
Texts move when they are dealt and when they are rendered, the hashes go without them.

Turns are taken in the order of their numbers; rows that repeat a turn number of a conversation are ordered by role and
text. Null roles and texts are empty; rows without a conversation id are one conversation of their own and null turns
come first. Only the named columns are read, so others may have any names. Texts of any length are taken whole. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

SEGMENT_TURNS = 64
#: Places of a conversation that one task hashes at a time.
BLOCK_TURNS = 4096


def render_turn(role: Column, text: Column) -> Column:
    """One turn under the template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def dealt(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, role, text, id) with ids that grow in their order, and (conv, part, shift, n_turns) of each range
    of each conversation: a turn's place from 1 is its id less the ``shift`` of its range."""
    order = ["conv_id", "turn", "role", "text"]
    turns = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    turns = cut(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).drop("turn"))
    held = turns.groupBy(F.col("conv_id").alias("conv"), _part().alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("conv").orderBy("part")
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy("conv")).cast("int")
    return turns, cut(held.select("conv", "part", (F.col("first") - before - 1).alias("shift"), whole.alias("n_turns")))


def _part() -> Column:
    """The range that an id was given in."""
    return F.shiftright("id", 33)


def _placed(turns: DataFrame, ranges: DataFrame) -> DataFrame:
    """``turns`` of the conversations in ``ranges`` with their ``place`` and ``n_turns``."""
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (_part() == F.col("part"))
    return turns.join(ranges, same).withColumn("place", (F.col("id") - F.col("shift")).cast("int")).drop("conv", "part", "shift", "id")


def rolling(hashed: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rows (conv_id, place, n_turns, t1, t2) with a 128-bit hash (h1, h2) of the conversation up to each turn.

    The hash of a prefix is the exclusive or of hashes of (place, turn), which fixes the order through the place; blocks
    of places are folded on their own and joined with the fold of the blocks before them.
    """
    own = hashed.withColumns({f"t{k}": F.xxhash64(F.lit(10 + k), "place", f"t{k}") for k in (1, 2)})
    own = own.withColumn("block", F.floor((F.col("place") - 1) / block_turns).cast("int"))
    totals = own.groupBy(F.col("conv_id").alias("conv"), F.col("block").alias("of")).agg(*[F.bit_xor(f"t{k}").alias(f"s{k}") for k in (1, 2)])
    ahead = Window.partitionBy("conv").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "of", *[F.coalesce(F.bit_xor(f"s{k}").over(ahead), F.lit(0)).alias(f"s{k}") for k in (1, 2)])
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    folded = own.withColumns({f"h{k}": F.bit_xor(f"t{k}").over(so_far) for k in (1, 2)})
    joined = folded.join(totals, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("of")))
    return joined.select("conv_id", "place", "n_turns", *[F.col(f"h{k}").bitwiseXOR(F.col(f"s{k}")).alias(f"h{k}") for k in (1, 2)])


def _maximal(turns: DataFrame, ranges: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no snapshot of another."""
    brief = turns.select("conv_id", "id", *[F.xxhash64(F.lit(k), "role", F.lit("\0"), "text").alias(f"t{k}") for k in (1, 2)])
    hashes = cut(rolling(_placed(brief, ranges), block_turns))
    whole = hashes.where("place = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("place < n_turns").select("h1", "h2", F.col("place").alias("n_turns")).distinct()  # beginnings that many share are met once
    return whole.join(inner, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns")


def collapse(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, n_turns) of the maximal conversations."""
    return _maximal(*dealt(df, conv_id, turn, role, text), block_turns)


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_turns: int = SEGMENT_TURNS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, segment, n_turns, rendered): maximal conversations in segments of at most ``segment_turns`` turns."""
    turns, ranges = dealt(df, conv_id, turn, role, text)
    kept = _maximal(turns, ranges, block_turns).select("conv_id")
    placed = _placed(turns, ranges.join(kept, F.col("conv").eqNullSafe(F.col("conv_id")), "left_semi"))
    placed = placed.withColumn("segment", F.floor((F.col("place") - 1) / segment_turns).cast("int"))
    row = F.struct("place", render_turn(F.col("role"), F.col("text")).alias("t"))
    parts = placed.groupBy("conv_id", "segment", "n_turns").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return parts.select("conv_id", "segment", "n_turns", F.array_join(F.transform("rows", lambda r: r["t"]), "").alias("rendered"))
