"""Counts under mutations in order: what is put in, taken out, set and deleted, one after another.

A stream of mutations is (idx, key, op, count), in the order of ``idx``:

* ``insert`` adds to the key's count, ``remove`` takes off it, down to nothing;
* ``set`` makes it so many, ``delete`` makes it none.

A count or weight of 0, or none, makes an insert, a removal and a set do nothing. Since a removal
stops at nothing, sums alone don't tell a count; but every mutation, and any row of them, turns a
count x into the larger of x + b and a for some b and a, or into a constant. A key's mutations are dealt by
blocks of places, each block's b and a come from running sums and their running minimum, and
what a block begins with from the blocks before it. So a key with a third of all rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.operators.reports import BLOCK_ROWS
from keytide.operators.tables import written


def _within_blocks(ops: DataFrame, block_rows: int) -> DataFrame:
    """``ops`` with _key, _at, and per row its segment since the last set or delete, and that segment's start, sum and least sum."""
    op, count = F.col("op"), F.coalesce(F.col("count"), F.lit(0)).cast("long")
    resets = (op == "delete") | ((op == "set") & (count > 0))
    change = F.when(op == "insert", count).when(op == "remove", -count).otherwise(0)
    dealt = ops.select("*", F.struct("key").alias("_key"), F.floor(F.col("idx") / block_rows).alias("_at"))  # a struct equals itself with a null inside
    rows = dealt.withColumns({"_resets": F.coalesce(resets, F.lit(False)).cast("int"), "_change": F.coalesce(change, F.lit(0)), "_to": F.when(op == "delete", 0).otherwise(count)})
    order = ("idx", "op", "count")
    so_far = lambda *by: W.partitionBy("_key", "_at", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_part", F.sum("_resets").over(so_far()))
    rows = rows.withColumns({"_sum": F.sum("_change").over(so_far("_part")), "_start": F.first(F.when(F.col("_resets") == 1, F.col("_to"))).over(so_far("_part"))})
    return rows.withColumn("_low", F.min("_sum").over(so_far("_part"))).drop("_resets", "_change", "_to")


def _begins(rows: DataFrame) -> DataFrame:
    """(_key, _at, _before, _after): each key's count before and after each block of its rows."""
    last = rows.groupBy("_key", "_at").agg(F.max_by(F.struct("_part", "_start", "_sum", "_low"), F.struct("idx", "op", "count")).alias("l"))
    const = F.col("l._part") > 0
    floor = F.col("l._sum") - F.col("l._low")
    blocks = last.select("_key", "_at", const.cast("int").alias("_const"), F.when(const, 0).otherwise(F.col("l._sum")).alias("_b"), F.when(const, F.greatest(F.col("l._start") + F.col("l._sum"), floor)).otherwise(floor).alias("_a"))
    so_far = lambda *by: W.partitionBy("_key", *by).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("_era", F.sum("_const").over(so_far()))
    blocks = blocks.withColumn("_p", F.sum("_b").over(so_far("_era"))).withColumn("_m", F.max(F.col("_a") - F.col("_p")).over(so_far("_era")))
    blocks = blocks.withColumn("_after", F.col("_p") + F.greatest(F.lit(0), "_m"))
    return blocks.select("_key", "_at", F.coalesce(F.lag("_after").over(W.partitionBy("_key").orderBy("_at")), F.lit(0)).alias("_before"), "_after")


def apply_in_order(ops: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``ops`` with ``now``, the key's count after each mutation, and ``applied``, by how much it has changed.

    Mutations at one place are applied in the order of op and count. Null keys are one key; unknown
    ops do nothing. The rows are written once, with what their block tells, before blocks are joined.
    """
    rows = written(_within_blocks(ops, block_rows))
    joined = rows.join(_begins(rows), ["_key", "_at"])
    start = F.coalesce("_start", "_before")
    now = F.greatest(start + F.col("_sum"), F.col("_sum") - F.col("_low"))
    earlier = F.lag("now").over(W.partitionBy("_key", "_at").orderBy("idx", "op", "count"))
    return joined.withColumn("now", now).withColumn("applied", F.col("now") - F.coalesce(earlier, "_before")).select(*ops.columns, "now", "applied")


def counts_after(ops: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, count) once all mutations are applied; keys without any left are gone.

    Only a row for each key and block is brought together.
    """
    last = _begins(_within_blocks(ops, block_rows)).groupBy("_key").agg(F.max_by("_after", "_at").alias("count"))
    return last.where("count > 0").select("_key.key", "count")
