"""Heavy hitters of which only candidates are shuffled.

Where the threshold is a share of the stream, most keys can be told to be too rare before anything
is shuffled: each partition keeps a Misra-Gries summary, a bounded number of keys with counts that
are low by a known error at most. Sums of the summaries' counts and the sum of their errors bound every
key's total, the keys that may reach the threshold are candidates, and a second scan counts these
exactly, added up in each partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.operators import counting
from keytide.operators.tables import written

#: Most keys of a summary; thresholds that would need more are counted key by key.
MOST_KEYS = 1 << 18


def shrunk(counts: pa.Table, most: int) -> tuple[pa.Table, int]:
    """(at most ``most`` of the keys, by how much their counts went down): the next count is taken off all, and what is left stays."""
    if counts.num_rows <= most:
        return counts, 0
    n = counts["n"].to_numpy()
    off = int(np.partition(n, len(n) - most - 1)[len(n) - most - 1])
    return pa.table({"key": counts["key"].filter(pa.array(n > off)), "n": pa.array(n[n > off] - off)}), off


def summaries(df: DataFrame, key: str, most: int, weight: str | None = None) -> DataFrame:
    """(key, n, error): a summary of at most ``most`` keys of each partition, and in a row of its own its error.

    A key's total in the partition is from its n to n plus the error, where a missing key's n is 0.
    Null keys are left out, as are weights of 0 or less.
    """
    kind = dict(df.select(F.col(key)).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error, names = None, 0, None
        for batch in batches:
            now = pa.table({"key": batch.column(0), "n": batch.column(1)}).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])
            names = names or now.schema
            both = now if held is None else pa.concat_tables([held, now]).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])
            held, off = shrunk(both.combine_chunks(), most)
            error += off
        if held is not None:
            held = held.cast(names)
            for part in held.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.nulls(part.num_rows, pa.int64())], ["key", "n", "error"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, names.field("key").type), pa.array([0]), pa.array([error])], ["key", "n", "error"])

    w = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(F.col(key).alias("key"), w.cast("long").alias("n")).where("key IS NOT NULL AND n > 0")
    return rows.mapInArrow(run, f"key {kind}, n long, error long")


def heavy_hitters(df: DataFrame, key: str, threshold: int, weight: str | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """The rows of ``counting.heavy_hitters``, of positive weights, with only candidates shuffled.

    A summary has twice as many keys as can reach the threshold. If that is over ``most_keys``, the
    threshold is too low to tell keys apart early, and every key is counted. Two scans for the
    candidates, of which there are at most as many as a summary has keys, and one to count them.
    """
    total = df.agg(F.coalesce(F.count("*") if weight is None else F.sum(weight), F.lit(0))).first()[0]
    most = 2 * -(-int(total) // max(threshold, 1)) + 1
    if most > most_keys or threshold < 1:
        return counting.heavy_hitters(df, key, threshold, weight)
    # bounded: different keys' counts add up to the stream's, and each is half the threshold at least
    known = F.broadcast(candidates(df, key, threshold, most, weight).select(F.col("key").alias("_key")))
    rows = df.join(known, F.col(key) == F.col("_key"), "left_semi").unionByName(df.where(F.col(key).isNull()))
    return counting.heavy_hitters(rows, key, threshold, weight)


def candidates(df: DataFrame, key: str, threshold: int, most: int, weight: str | None = None) -> DataFrame:
    """(key, n): the keys that may reach the threshold, with lower bounds of their totals, from summaries of ``most`` keys."""
    told = written(summaries(df, key, most, weight))
    error = told.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    return told.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= threshold - error)
