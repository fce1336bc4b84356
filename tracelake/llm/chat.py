"""Cumulative-snapshot collapse of logged conversations, then rendering, with DataFrame functions alone.

A log often holds a conversation again each time a turn was added. Every prefix of a conversation (all turns up to some
number) gets a rolling hash, the exclusive or of the hashes of its turns with their places; two hashes make 128 bits.
Conversations whose whole hash is that of a shorter prefix of another are dropped by an anti-join. Of equal ones the
smallest id stays. What is left is rendered.

A text of any length is one row of a part. The exclusive or is free of order, so a turn's place is hashed with it. A null turn counts as turn -1, a null role or text as empty, a null conversation id as an id of its own. Repeated rows
count once; several rows with one turn number all belong to that turn, in order of role and text. Empty tables give
empty results. Turns are put together in blocks, so a conversation with very many is no single group, neither for the
hashes nor for the rendered parts. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored

#: Turn numbers in one block, hence in one rendered part.
BLOCK = 1024
NO_ID = -(1 << 63)


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls and repeated rows."""
    clean = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return clean.distinct()


def prefixes(clean: DataFrame) -> DataFrame:
    """(conv_id, turn, n, h1, h2, is_last): size and hashes of each conversation up to and with each turn number."""
    each = clean.groupBy("conv_id", "turn").agg(
        F.count("*").alias("k"),
        F.bit_xor(F.xxhash64(F.lit(1), "turn", "role", "text")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(2), "text", "turn", "role")).alias("x2"),
    )
    each = each.withColumn("block", F.floor(F.col("turn") / BLOCK))
    # running values over blocks first, then within each block
    block = each.groupBy("conv_id", "block").agg(F.sum("k").alias("k"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.max("turn").alias("top"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"),
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("y1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("y2"),
        F.max("top").over(Window.partitionBy("conv_id")).alias("top"),
    )
    within = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = each.join(block, ["conv_id", "block"])
    return rolled.select(
        "conv_id",
        "turn",
        (F.col("k0") + F.sum("k").over(within)).alias("n"),
        F.col("y1").bitwiseXOR(F.bit_xor("x1").over(within)).alias("h1"),
        F.col("y2").bitwiseXOR(F.bit_xor("x2").over(within)).alias("h2"),
        (F.col("turn") == F.col("top")).alias("is_last"),
    )


def maximal(clean: DataFrame) -> DataFrame:
    """(conv_id, n_turns): conversations that are no prefix of a longer one; of equal ones the smallest id."""
    rolled = stored(prefixes(clean), "prefixes")
    key = ["n", "h1", "h2"]
    whole = rolled.where("is_last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    shorter = rolled.where("not is_last").select(*key).distinct()
    return whole.join(shorter, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(clean: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, text): each kept conversation in a chat format, ``block`` turn numbers to a part.

    Tags inside a text are broken up, so a text cannot open or close a turn.
    """
    said = F.replace(F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    line = F.concat(F.lit("<|"), F.replace("role", F.lit("|"), F.lit("")), F.lit("|>\n"), said, F.lit("\n<|end|>\n"))
    pieces = clean.join(kept.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.floor(F.col("turn") / block).alias("part"), F.struct("turn", "role", "text", line.alias("line")).alias("piece"))
    parts = pieces.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return parts.select("conv_id", "part", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.col("pieces.line"), "").alias("text"))


def collapse(rows: DataFrame) -> DataFrame:
    """Rendered maximal conversations; a null id is null again."""
    clean = turns(rows)
    done = render(clean, maximal(clean))
    return done.withColumn("conv_id", F.when(F.col("conv_id") != NO_ID, F.col("conv_id")))
