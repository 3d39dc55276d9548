"""Chat formatting with collapse of cumulative snapshots.

A logged conversation that is a prefix of a longer one is a snapshot of it. Rolling prefix hashes find these: the hash of
the first k turns is the XOR of the hashes of (role, text, place) of each, a window aggregate that runs along the turns and
holds no list. Two such hashes of 64 bits with different seeds stand for a prefix. Distinct proper prefixes (combined before
the shuffle, so a very common first turn is one row a task) are anti-joined with the whole conversations.

Places and hashes are computed once, under one sort of the turns, and written; the search reads only the hashes.

Defined results: turns are ordered by turn, role and text; rows with a null conv_id are left out; a null role or text is
empty; of equal conversations the smallest conv_id stays; repeated rows are repeated turns; ids may be of any type that has an
order; markers of the format inside a role or text are spaced out (``<| im_end |>``), so they can't forge a turn; an empty
table gives an empty one; columns of other names are ignored, clashing ones too. Rendering gives chunks of at most
``max_turns`` turns, so that a conversation of any length stays in bounded rows; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ORDER = ("turn", "role", "text")
MARKER = r"<\|(im_start|im_end)\|>"


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns (conv_id, role, text) with their place from 1, the number of turns, and the hashes p1, p2 of the prefix up to
    each, in one sort by conversation."""
    c = conversations.where(F.col(key).isNotNull()).select(F.col(key).alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    of = Window.partitionBy("conv_id")
    so_far = of.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = c.withColumns({"place": F.row_number().over(of.orderBy(*ORDER)), "n_turns": F.count("*").over(of)})
    p1 = F.bit_xor(F.xxhash64("role", "text", "place")).over(so_far)
    p2 = F.bit_xor(F.xxhash64(F.lit(1), "place", "text", "role")).over(so_far)
    return placed.withColumns({"p1": p1, "p2": p2}).drop("turn")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that no longer one begins with, one of equal ones."""
    whole = turns.where("place = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    proper = turns.where("place < n_turns").select(F.col("place").cast("long").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id")


def harmless(c: Column) -> Column:
    return F.regexp_replace(c, MARKER, "<| $1 |>")


def render(turns: DataFrame, kept: DataFrame, max_turns: int = 256) -> DataFrame:
    """(conv_id, chunk, n_turns, first_turn, chunk_turns, text) of the kept conversations."""
    piece = F.concat(F.lit("<|im_start|>"), harmless(F.col("role")), F.lit("\n"), harmless(F.col("text")), F.lit("<|im_end|>\n"))
    t = turns.join(kept, "conv_id", "left_semi").select("conv_id", "n_turns", "place", F.floor((F.col("place") - 1) / max_turns).cast("long").alias("chunk"), piece.alias("piece"))
    g = t.groupBy("conv_id", "chunk", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("s"))
    return g.select("conv_id", "chunk", "n_turns", F.col("s")[0]["place"].cast("long").alias("first_turn"), F.size("s").cast("long").alias("chunk_turns"), F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("text"))


def format_conversations(conversations: DataFrame, max_turns: int = 256) -> DataFrame:
    t = written(turns_of(conversations))
    return render(t, maximal(t), max_turns)
