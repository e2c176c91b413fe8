"""Count tables kept in buckets of their keys, which merge bucket by bucket.

A snapshot is a Parquet table bucketed and sorted by its keys, one file a bucket. Two snapshots with equally
many buckets are merged by a join of their buckets where they lie: nothing of them is shuffled. New counts
are shuffled once, into a snapshot of their own. Keys must not be null, which ends the writing.

A union would merge any number at once, but Spark 4.1 takes a union of bucketed scans for bucketed
without bringing equal buckets together, and counts come out split; so merges go two by two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("key", "value")


def save(counts: DataFrame, table: str, path: str, buckets: int, keys: tuple[str, ...] = KEYS, dealt: bool = False) -> DataFrame:
    """Writes ``counts`` (keys.., count) to ``path`` as the snapshot ``table``; ``dealt`` says that its partitions are its buckets."""
    if not dealt:
        there = lambda k: F.coalesce(k, F.raise_error(F.lit(f"{k} is null")).cast(counts.schema[k].dataType)).alias(k)
        counts = counts.select(*(there(k) for k in keys), "count").repartition(buckets, *keys)
    counts.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return counts.sparkSession.table(table)


def merged(spark: SparkSession, one: str, two: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Counts of equal keys in two snapshots, added up bucket by bucket."""
    a, b = (spark.table(t).select(*keys, F.col("count").alias(n)) for t, n in ((one, "_a"), (two, "_b")))
    zero = F.lit(0)
    return a.join(b.hint("merge"), list(keys), "full").select(*keys, (F.coalesce("_a", zero) + F.coalesce("_b", zero)).alias("count"))


def advance(spark: SparkSession, table: str, new_counts: DataFrame, new_table: str, path: str, buckets: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The snapshot ``table`` and new counts as the snapshot ``new_table``, which ``path`` gets beside the new counts' own."""
    delta = f"{new_table}_delta"
    save(new_counts, delta, f"{path}/delta", buckets, keys)
    return save(merged(spark, table, delta, keys), new_table, f"{path}/merged", buckets, keys, dealt=True)
