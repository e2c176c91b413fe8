"""Timely reports: when each key reached its threshold, how long it took, and whether a report kept its bound.

A stream is a table (idx LONG dense, key LONG, ..); order is always by ``idx``. The T-th occurrence
comes from a ranked window, for which Spark keeps at most T rows a key before the shuffle, so a hot
key never moves whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.functions.hashing import cone, hash_64
from keytide.operators.tables import written


def first_rows(stream: DataFrame, threshold: int) -> DataFrame:
    """The first ``threshold`` rows of each key, with their rank ``rn``."""
    w = W.partitionBy("key").orderBy("idx")
    return stream.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= threshold)


def immediate(stream: DataFrame, threshold: int) -> DataFrame:
    """(key, i0, it, lifetime) of each key that reached the threshold, reported just then."""
    got = first_rows(stream, threshold).groupBy("key").agg(F.min("idx").alias("i0"), F.max("idx").alias("it"), F.count("*").alias("n"))
    return got.where(F.col("n") == threshold).select("key", "i0", "it", (F.col("it") - F.col("i0")).alias("lifetime"))


def chunked(stream: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """The same with ``report_idx``, the end of the chunk of rows in which the threshold was reached.

    This is the count-bounded delay: a report waits for the end of the batch it is found in, never
    past the stream's last row.
    """
    last = stream.agg(F.max("idx").alias("_last"))
    end = (F.floor(F.col("it") / chunk) + 1) * chunk - 1
    return immediate(stream, threshold).crossJoin(F.broadcast(last)).select("key", "i0", "it", "lifetime", F.least(end, "_last").alias("report_idx"))  # one row


def time_bounded(stream: DataFrame, threshold: int, alpha: float) -> DataFrame:
    """The same with the latest report that keeps the time stretch within 1 + alpha."""
    return immediate(stream, threshold).withColumn("report_idx", F.col("it") + F.floor(F.col("lifetime") * alpha).cast("long"))


def lifetimes(stream: DataFrame, threshold: int) -> DataFrame:
    """(key, i0, it, n): first row, T-th row (null if not reached) and rows seen, up to T.

    A key is reportable if i0 < it, so with a threshold of 1 none is.
    """
    got = first_rows(stream, threshold).groupBy("key").agg(F.min("idx").alias("i0"), F.max(F.when(F.col("rn") == threshold, F.col("idx"))).alias("it"), F.count("*").alias("n"))
    return got


#: Places of a block in which a key's rows are summed by one task.
BLOCK_ROWS = 1 << 20


def running_sum(rows: DataFrame, column: str, name: str, block_rows: int = BLOCK_ROWS, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """``rows`` with ``name``: the sum of ``column`` over the key's rows so far, by ``order``, whose first is a place.

    A key's rows are dealt by blocks of places, so a hot key is many tasks' work; the blocks' sums
    tell each block where it begins. ``rows`` is read twice, the second time for the sums alone, which
    are added up before they are shuffled: give it a table rather than costly work.
    """
    # a struct is equal to itself with a null key inside, so the join is on equality and keeps the rows where they are
    dealt = rows.select("*", F.struct("key").alias("_key"), F.floor(F.col(order[0]) / block_rows).alias("_at")).repartition("_key", "_at")
    sums = rows.groupBy(F.struct("key").alias("_key"), F.floor(F.col(order[0]) / block_rows).alias("_at")).agg(F.sum(column).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("_key", "_at", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(column).over(W.partitionBy("_key", "_at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    both = dealt.withColumn("_inside", inside).join(sums, ["_key", "_at"])
    return both.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def running_count(stream: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stream with each row's count of its key so far."""
    return running_sum(stream.withColumn("_one", F.lit(1)), "_one", "running", block_rows).drop("_one")


def count_at(stream: DataFrame, at: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, index, count): for each wanted (key, index) the key's rows up to and including it.

    The wanted places run along with the stream as rows that count nothing.
    """
    asked = at.select("key", F.col("index").alias("idx")).distinct().withColumns({"_one": F.lit(0), "_asks": F.lit(1)})
    rows = stream.select("key", "idx").withColumns({"_one": F.lit(1), "_asks": F.lit(0)}).unionByName(asked)
    got = running_sum(rows, "_one", "count", block_rows, ("idx", "_asks")).where("_asks = 1")
    return got.select("key", F.col("idx").alias("index"), "count")


def by_cone(stream: DataFrame, threshold: int, cones: int) -> DataFrame:
    """(cone, key, count, i0, it): each key's rows, first and T-th place (null if not reached), a cone's keys in its own partition.

    Rows go straight to the partition with the number of their cone, the leading bits of the key's
    hash, and one exchange serves counts and reports. ``cones`` is a power of two.
    """
    routed = stream.withColumn("cone", cone(hash_64(F.col("key")), cones).cast("int")).repartitionById(cones, "cone")
    rows = routed.withColumn("rn", F.row_number().over(W.partitionBy("cone", "key").orderBy("idx")))
    return rows.groupBy("cone", "key").agg(F.count("*").alias("count"), F.min("idx").alias("i0"), F.max(F.when(F.col("rn") == threshold, F.col("idx"))).alias("it"))


def point_query(stream: DataFrame, keys: DataFrame, threshold: int) -> DataFrame:
    """(key, count, report_idx) of the wanted keys: 0 and null for one that never came."""
    wanted = keys.select("key").distinct()
    own = stream.join(wanted, "key", "left_semi")
    counts = own.groupBy("key").agg(F.count("*").alias("count"))
    told = immediate(own, threshold).select("key", F.col("it").alias("report_idx"))
    return wanted.join(counts, "key", "left").join(told, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("count"), "report_idx")


def final_sweep(stream: DataFrame, told: DataFrame, threshold: int) -> DataFrame:
    """(key, report_idx, via): the reports so far, and at the last row every heavy key still untold."""
    from keytide.operators.counting import heavy_hitters

    last = stream.agg(F.max("idx").alias("report_idx"))
    rest = heavy_hitters(stream, "key", threshold).join(told.select("key"), "key", "left_anti")
    swept = rest.select("key").crossJoin(F.broadcast(last)).withColumn("via", F.lit("sweep"))  # one row
    return told.select("key", "report_idx", "via").unionByName(swept)


def by_channel(told: DataFrame) -> DataFrame:
    """(via, reports) and their total."""
    return told.rollup("via").agg(F.count("*").alias("reports")).select(F.coalesce("via", F.lit("total")).alias("via"), "reports")


def counters(told: DataFrame, on_demand: DataFrame, points: DataFrame) -> DataFrame:
    """(total, via_merge, via_query, on_demand, point_queries): the tallies of a run in one row.

    ``told`` are the reports, ``on_demand`` the popularity checks made while rows came in, ``points``
    the point queries asked.
    """
    tally = told.agg(F.count("*").alias("total"), F.count(F.when(F.col("via") == "merge", 1)).alias("via_merge"), F.count(F.when(F.col("via") == "query", 1)).alias("via_query"))
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return tally.crossJoin(one(on_demand, "on_demand")).crossJoin(one(points, "point_queries"))  # one row each


def stretches(stream: DataFrame, reports: DataFrame, threshold: int) -> DataFrame:
    """``reports`` (key, report_idx) joined with lifetimes: count and time stretch of each.

    Reports are written once, as both the rows up to them and the lifetimes are asked for them. A key's
    rows are counted by a join with its few reports, not put in order.
    """
    told = written(reports.select("key", "report_idx").distinct())
    known = lifetimes(stream, threshold).where("i0 < it").select("key", "i0", "it")
    counted = stream.select("key", "idx").join(told, "key").where("idx <= report_idx").groupBy("key", "report_idx").agg(F.count("*").alias("report_count"))
    rows = known.join(told, "key").join(counted, ["key", "report_idx"], "left").withColumn("report_count", F.coalesce("report_count", F.lit(0)))
    life = F.col("it") - F.col("i0")
    return rows.select(
        "key", "i0", "it", life.alias("lifetime"), "report_idx", "report_count",
        (F.col("report_count") / F.lit(float(threshold))).alias("count_stretch"),
        ((F.col("report_idx") - F.col("i0")) / life.cast("double")).alias("time_stretch"),
    )


def violations(stretched: DataFrame, policy: str, threshold: int, alpha: float = 1.0, slack: int | None = None) -> DataFrame:
    """The reports that break their policy's bound.

    ``immediate``: any delay. ``count``: a count over threshold + slack (twice the threshold if no
    slack is given). ``time``: a stretch over 1 + alpha. ``none``: no bound.
    """
    rule = {
        "immediate": F.col("report_idx") != F.col("it"),
        "count": F.col("report_count") > threshold + (threshold if slack is None else slack),
        "time": F.col("time_stretch") > 1 + alpha + 1e-12,
        "none": F.lit(False),
    }
    return stretched.where(rule[policy])


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """One row with an exact quantile (linear between neighbours) for each share, columns ``q0``, ``q1``, ..

    Approximate quantiles a little below and above bound each place, so only the few values
    between them are put in order; all others are only counted.
    """
    slack = 4 / accuracy
    bounds = [F.percentile_approx(column, [max(0.0, p - slack), min(1.0, p + slack)], accuracy).alias(f"b{k}") for k, p in enumerate(shares)]
    known = F.broadcast(df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), *bounds))  # one row
    rows = df.where(F.col(column).isNotNull()).crossJoin(known)
    near = F.array_compact(F.array(*(F.when(F.col(column).between(F.col(f"b{k}")[0], F.col(f"b{k}")[1]), k) for k in range(len(shares)))))
    v, low, high = F.col(column).cast("double"), (lambda k: F.col(f"b{k}")[0]), (lambda k: F.col(f"b{k}")[1])
    sides = [x for k in range(len(shares)) for x in (F.count(F.when(F.col(column) < low(k), 1)).alias(f"u{k}"), F.max(F.when(F.col(column) < low(k), v)).alias(f"p{k}"), F.min(F.when(F.col(column) > high(k), v)).alias(f"n{k}"))]
    outside = F.broadcast(rows.agg(*sides))  # one row: how many are below, and the nearest values on both sides
    values = rows.select(F.explode(near).alias("k"), v.alias("v"), "n").groupBy("k", "v", "n").agg(F.count("*").alias("times"))
    of = lambda c: F.create_map(*(x for k in range(len(shares)) for x in (F.lit(k), c(k))))[F.col("k")]
    upto = F.sum("times").over(W.partitionBy("k").orderBy("v"))
    seen = values.crossJoin(outside).select("k", "v", of(lambda k: F.col(f"u{k}")).alias("under"), of(lambda k: F.col(f"p{k}")).alias("before"), of(lambda k: F.col(f"n{k}")).alias("after"), upto.alias("upto"), of(lambda k: F.lit(float(shares[k])) * (F.col("n") - 1)).alias("at"))

    def ranked(r):  # the value of rank r, from 0
        return F.when(F.max(r) < F.max("under"), F.max("before")).otherwise(F.coalesce(F.min(F.when(F.col("under") + F.col("upto") > r, F.col("v"))), F.max("after")))

    each = seen.groupBy("k").agg(ranked(F.floor("at")).alias("low"), ranked(F.ceil("at")).alias("high"), F.max(F.col("at") - F.floor("at")).alias("part"))
    each = each.select("k", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))
    return each.agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(shares))))


def stretch_summary(stretched: DataFrame, column: str) -> DataFrame:
    """Box-plot numbers of a stretch column: least, quartiles (exact) and largest."""
    ends = stretched.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))
    return ends.crossJoin(F.broadcast(quantiles(stretched, column, (0.25, 0.5, 0.75)))).select("low", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "high", "n")  # one row each


def thresholds(levels: int, growth: int, threshold: int) -> list[int]:
    """How many of a key's occurrences each storage level may hold back under the count bound.

    The last level holds floor(growth^(2/3)), every one above that number times as many, the first
    the rest. Their sum over all but the first is the slack of the count policy.
    """
    base = int(growth ** (2 / 3) + 1e-9)
    held = [base ** (levels - k) for k in range(1, levels)]
    if sum(held) >= threshold:
        raise ValueError("the levels would hold back the threshold itself")
    return [threshold - sum(held), *held]
