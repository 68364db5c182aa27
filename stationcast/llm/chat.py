"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

Loggers that write a conversation again after every turn leave many snapshots, each a
prefix of the next. A rolling hash over the turns names every prefix of every
conversation; a conversation whose whole hash is the hash of a longer one's prefix is a
snapshot and goes by an anti-join. What remains is rendered, role marks around each turn.

The rolling hash is the exclusive or of two 64-bit hashes of (position, role, text), so
its value after any turn is a running aggregate. Turns are dealt out by ranges of
(conversation, turn), so a conversation of any length spreads over many tasks; a running
value is the one inside the range plus that of the ranges before, of which there is one
row each. A rendered conversation is one row for every ``turns_per_part`` turns.

Turns are ordered by their number, then role and text. Rows equal in conversation, turn,
role and text are one turn. A null conversation id is a conversation of its own. Null
roles and texts count as empty. Of conversations with equal turns the one with the
smallest id stays (null first). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationcast.session import durable

TURNS_PER_PART = 1000
START, END = "<|im_start|>", "<|im_end|>"


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns by range (part, conv, n, role, text), ``n`` counting a conversation's turns inside a range; written once."""
    empty = F.lit("")
    narrow = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"),
    ).distinct()
    ranged = narrow.repartitionByRange("conv", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", "conv").orderBy("turn", "role", "text")
    return durable(ranged.select("part", "conv", F.row_number().over(inside).alias("n"), "role", "text"), "turns")


def offsets(found: DataFrame) -> DataFrame:
    """For each range of a conversation, the turns before it (``before``)."""
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("part", "conv").agg(F.count("*").alias("size"))
    return sizes.select("part", "conv", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))


def prefixes(found: DataFrame, before: DataFrame) -> DataFrame:
    """For each turn its position (from 1) and the rolling hash (``h1``, ``h2``) of the conversation up to it."""
    hashed = found.select("part", "conv", "n", *[F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)])
    placed = hashed.alias("t").join(before.alias("b"), _same("t", "b")).select(
        "t.*", (F.col("b.before") + F.col("t.n")).alias("position")
    )
    running = Window.partitionBy("part", "conv").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = [F.bit_xor(F.xxhash64("position", f"t{i}")).over(running).alias(f"h{i}") for i in (1, 2)]
    local = durable(placed.select("part", "conv", "position", *mixed), "hashes")
    ends = local.groupBy("part", "conv").agg(F.max_by(F.struct("h1", "h2"), "position").alias("e"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", "conv", *[F.coalesce(F.bit_xor(f"e.h{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    whole = [F.col(f"t.h{i}").bitwiseXOR(F.col(f"b.c{i}")).alias(f"h{i}") for i in (1, 2)]
    return durable(local.alias("t").join(carried.alias("b"), _same("t", "b")).select("t.conv", "t.position", *whole), "prefixes")


def _same(a: str, b: str):
    """The same range and conversation, null or not."""
    return (F.col(f"{a}.part") == F.col(f"{b}.part")) & F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))


def maximal(rolled: DataFrame) -> DataFrame:
    """The conversations (conv, n_turns, n_copies) that are no prefix of another one."""
    sizes = rolled.groupBy("conv").agg(F.max_by(F.struct("position", "h1", "h2"), "position").alias("e"))
    whole = sizes.groupBy("e").agg(F.min(F.struct(F.col("conv").isNotNull().alias("named"), "conv")).alias("k"), F.count("*").alias("n_copies"))
    whole = whole.select(F.col("k.conv").alias("conv"), F.col("e.position").alias("n_turns"), "e.h1", "e.h2", "n_copies")
    last = sizes.select(F.col("conv").alias("c"), F.col("e.position").alias("last"))
    inner = (
        rolled.alias("r").join(last.alias("l"), F.col("r.conv").eqNullSafe(F.col("l.c")) & (F.col("r.position") < F.col("l.last")))
        .groupBy(F.col("r.position").alias("position"), F.col("r.h1").alias("p1"), F.col("r.h2").alias("p2")).agg(F.count("*"))
    )
    same = (F.col("n_turns") == F.col("position")) & (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2"))
    return whole.join(inner, same, "left_anti").select("conv", "n_turns", "n_copies")


def render(
    turns: DataFrame, turns_per_part: int = TURNS_PER_PART,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """The maximal conversations as text: conv_id, part (from 0), n_turns, n_copies, text.

    A conversation's text is that of its parts in order; all but the last part hold
    ``turns_per_part`` turns. ``n_copies`` counts the conversations with the same turns.
    """
    found = ordered(turns, conv, turn, role, text)
    before = offsets(found)
    kept = maximal(prefixes(found, before))
    kept = before.alias("s").join(kept.alias("k"), F.col("s.conv").eqNullSafe(F.col("k.conv"))).select("s.*", "n_turns", "n_copies")
    own = found.alias("t").join(kept.alias("b"), _same("t", "b")).withColumn("position", F.col("before") + F.col("n"))
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    rows = own.select(
        F.col("t.conv").alias("conv"), ((F.col("position") - 1) / turns_per_part).cast("long").alias("section"),
        "n_turns", "n_copies", F.struct("position", piece.alias("piece")).alias("p"),
    )
    joined = rows.groupBy("conv", "section", "n_turns", "n_copies").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return joined.select(
        F.col("conv").alias(conv), F.col("section").alias("part"), "n_turns", "n_copies", F.array_join("p.piece", "").alias("text")
    )
