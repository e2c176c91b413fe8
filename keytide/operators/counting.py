"""Keyed counts and multiset algebra over (key, value, count) tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.hashing import KEY_BITS, hash_64
from keytide.operators.tables import written


def keyed_count(df: DataFrame, *keys: str, weight: str | Column | None = None) -> DataFrame:
    """Count, or sum of weights, for each key; weights of 0 add nothing and make no row."""
    if weight is None:
        return df.groupBy(*keys).agg(F.count("*").alias("count"))
    w = F.col(weight) if isinstance(weight, str) else weight
    return df.withColumn("_w", w).where("_w <> 0").groupBy(*keys).agg(F.sum("_w").alias("count"))


def totals(counts: DataFrame, key: str = "key") -> DataFrame:
    """(total, distinct_keys, max_count) of a count table, in one pass if it has one row a key."""
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.countDistinct(key).alias("distinct_keys"), F.max("count").alias("max_count"))


def totals_by(counts: DataFrame, level: str) -> DataFrame:
    """The same for each level or cone; a key on two levels counts on both."""
    return counts.groupBy(level).agg(F.sum("count").alias("total"), F.count("*").alias("entries"))


def heavy_hitters(df: DataFrame, key: str, threshold: int, weight: str | None = None) -> DataFrame:
    """Keys with a total of at least ``threshold``: the final set of every reporting policy."""
    return keyed_count(df, key, weight=weight).where(F.col("count") >= threshold)


def merge(*counts: DataFrame, keys: tuple[str, ...] = ("key", "value")) -> DataFrame:
    """Union of multisets: counts of equal entries add up."""
    return reduce(DataFrame.unionByName, [c.select(*keys, "count") for c in counts]).groupBy(*keys).agg(F.sum("count").alias("count"))


def larger_first(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the side with more entries, the other); ``b`` if equally many. Both are written, so that counting them makes neither twice."""
    a, b = written(a), written(b)
    return (a, b) if a.count() > b.count() else (b, a)


def at_value_0(counts: DataFrame) -> DataFrame:
    """The entries that a lookup by key alone finds: those with value 0, or all if there are no values."""
    return counts.where("value = 0") if "value" in counts.columns else counts


def inner_product(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """(inner_product): sum over the entries of the larger side of their count times the other side's count of the key.

    With values, the other side is looked up at value 0 only, while each entry of the larger side
    counts, whatever its value. Without, the sides are alike.
    """
    if "value" in a.columns and "value" in b.columns:
        a, b = larger_first(a, b)
    x, y = a.select(key, F.col("count").alias("_a")), at_value_0(b).select(key, F.col("count").alias("_b"))
    return x.join(y, key).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("inner_product"))


def magnitude(a: DataFrame) -> DataFrame:
    """(magnitude): the Euclidean norm of the counts."""
    return a.agg(F.sqrt(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)).cast("double")).alias("magnitude"))


def cosine(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """(cosine): the inner product over the product of the norms; null if one is empty."""
    parts = inner_product(a, b, key).crossJoin(magnitude(a)).crossJoin(magnitude(b).withColumnRenamed("magnitude", "other"))  # one row each
    size = F.col("magnitude") * F.col("other")
    return parts.select(F.when(size > 0, F.col("inner_product") / size).alias("cosine"))


def intersect(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """The entries of the side that has more of them (``b`` if equally many) whose key the other has at value 0.

    The larger side is cut down by a semi join, which Spark may broadcast or shuffle as the smaller
    side's size allows.
    """
    large, small = larger_first(a, b)
    return large.join(at_value_0(small).select(key).distinct(), key, "left_semi")


def remove(counts: DataFrame, removals: DataFrame, key: str = "key") -> DataFrame:
    """Counts less removals, down to nothing: an entry that loses all of its count goes."""
    r = removals.groupBy(key).agg(F.sum("count").alias("_r"))
    left = F.col("count") - F.coalesce("_r", F.lit(0))
    return counts.join(r, key, "left").withColumn("count", left).where("count > 0").drop("_r")


def delete_keys(counts: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Counts without the given keys."""
    return counts.join(keys.select(key).distinct(), key, "left_anti")


def set_count(counts: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Counts with those of the given keys replaced; keys that weren't there are added."""
    return delete_keys(counts, new, key).unionByName(new.select(*counts.columns)).where("count > 0")


def in_hash_order(counts: DataFrame, start: int = 0, key: str = "key") -> DataFrame:
    """Counts with ``hash``, the invertible hash of the key, in its order from ``start`` on."""
    return counts.withColumn("hash", hash_64(F.col(key))).where(F.col("hash") >= start).orderBy("hash")


#: Leading bits of a hash by which places are counted.
RANGE_BITS = 14


def at_places(counts: DataFrame, first: int, n: int, key: str = "key") -> DataFrame:
    """The ``n`` entries from place ``first`` on (from 0) in the order of the invertible hash, with ``hash`` and ``place``.

    Counts of the entries in each range of hashes tell which ranges hold these places, and only
    those ranges' entries are put in order, each by itself. Entries with the same key are ordered by
    their other columns.
    """
    rows = counts.withColumn("hash", hash_64(F.col(key))).withColumn("_range", F.shiftrightunsigned("hash", KEY_BITS - RANGE_BITS).cast("int"))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # over 2^RANGE_BITS rows at most
    wanted = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col("_before") < first + n) & (F.col("_before") + F.col("_n") > first))
    ours = rows.join(F.broadcast(wanted.select("_range", "_before")), "_range")
    rest = [c for c in counts.columns if c != key]
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy("hash", *rest)) - 1
    return ours.withColumn("place", place).where(F.col("place").between(first, first + n - 1)).select(*counts.columns, "hash", "place")


def shards_combined(tallies: DataFrame, *keys: str) -> DataFrame:
    """Per-process tallies (keys.., count) summed over the processes."""
    return tallies.groupBy(*keys).agg(F.sum("count").alias("count"))
