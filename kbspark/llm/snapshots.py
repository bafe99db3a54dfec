"""Chat formatting: collapse cumulative conversation snapshots, then render the maximal ones.

Loggers often store a conversation again after each turn, so one log is a prefix of a longer
one. Each turn is hashed together with its position; the exclusive-or of the first ``k`` of
these 128-bit hashes is the *rolling prefix hash* of the first ``k`` turns. A conversation is a
cumulative snapshot if its whole-log hash is also the proper-prefix hash of another one. An
anti-join on (length, hash) keeps the maximal conversations; equal logs keep the smallest id.

Scale: DataFrame functions only. Turns are shuffled by conversation without their texts to hash
them; identical logs collapse through partial aggregates and proper prefixes through a distinct,
so a first turn shared by a third of all conversations costs one row per task. The texts of the
maximal conversations are shuffled once, to be rendered.

Defined cases: turns are ordered by (turn, role, text hash) with nulls first, so ties and
repeated rows have a fixed place; a null role renders as ``unknown`` and a null text as empty,
but both hash differently from those values; rows with a null ``conv_id`` form one conversation
with a null id; ``<|`` inside a text is written ``< |``, so that content cannot forge a turn;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>", "<|end|>"


def _turn_hashes(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, pos (from 1), last (no later turn), p1, p2 (prefix hash up to here)."""
    t = conversations.select(
        "conv_id", "turn", "role",
        # hash() skips nulls, so nullness is hashed as a value of its own.
        F.xxhash64(F.col("text").isNull(), "text").alias("th"),
        F.xxhash64(F.lit(1), F.col("text").isNull(), "text").alias("th2"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "th", "th2")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("pos", F.row_number().over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    who = [F.col("pos"), F.col("role").isNull(), F.col("role")]
    t = t.withColumn("g1", F.xxhash64(*who, "th")).withColumn("g2", F.xxhash64(F.lit(2), *who, "th2"))
    return t.select("conv_id", "pos", "last", F.bit_xor("g1").over(running).alias("p1"),
                    F.bit_xor("g2").over(running).alias("p2"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another;
    ``n_copies`` counts the equal logs, of which the smallest id stands for all."""
    hashed = _turn_hashes(conversations)
    whole = (hashed.filter("last").groupBy("pos", "p1", "p2")
             .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    proper = hashed.filter(~F.col("last")).select("pos", "p1", "p2").distinct()
    return (whole.join(proper, ["pos", "p1", "p2"], "left_anti")
            .select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Render each maximal conversation as one training text.

    Columns: conv_id, n_turns, n_copies, rendered (``<|role|>\\ntext<|end|>\\n`` per turn).
    """
    keep = maximal_conversations(conversations).withColumnRenamed("conv_id", "keep_id")
    turns = conversations.select("conv_id", "turn", "role", "text")
    t = turns.join(keep, F.col("conv_id").eqNullSafe(F.col("keep_id")), "inner").drop("keep_id")
    w = Window.partitionBy("conv_id").orderBy(
        "turn", "role", F.xxhash64(F.col("text").isNull(), "text"), F.xxhash64(F.lit(1), F.col("text").isNull(), "text"))
    piece = F.concat(F.lit(ROLE_OPEN), F.coalesce("role", F.lit("unknown")), F.lit(ROLE_CLOSE + "\n"),
                     F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(TURN_END + "\n"))
    t = t.select("conv_id", "n_turns", "n_copies", F.struct(F.row_number().over(w).alias("pos"), piece.alias("s")).alias("p"))
    return (t.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"),
                                     F.array_sort(F.collect_list("p")).alias("ps"))
            .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("ps.s"), "").alias("rendered")))


ORACLE = """
WITH t AS (SELECT conv_id, role, text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
h AS (SELECT *, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS m FROM t),
p AS (SELECT conv_id, pos, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
             count(*) OVER (PARTITION BY conv_id) AS n FROM h),
whole AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY prefix, n),
keep AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT k.conv_id, k.n AS n_turns, k.n_copies,
       string_agg('<|' || t.role || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM keep k JOIN t ON t.conv_id = k.conv_id GROUP BY k.conv_id, k.n, k.n_copies
"""
