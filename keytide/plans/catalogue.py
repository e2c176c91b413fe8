"""The registered queries over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import hashing
from keytide.operators import bias, counting, frequent, mutations, reports, scoring
from keytide.operators.tables import shared_dir
from keytide.sources import snapshots, streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
T = 24
#: The stream of the events table, in SQL.
STREAM = "(SELECT event_id AS idx, user_id AS key, CAST(event_type = 'error' AS INT) AS value, CAST(user_id % 16 = 1 AS INT) AS truth FROM events)"
#: Two-level parts made of the events: five in a row spell one inner key of 16.
PARTS = "(SELECT event_id AS idx, event_id // 5 AS okey, CAST(event_id % 5 + 1 AS INT) AS cnt, user_id % 2 AS bit, CAST(user_id % 16 = 1 AS INT) AS truth, CAST(event_type = 'error' AS INT) AS value FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.from_table(table(spark, d, "events"), "event_id", "user_id", F.col("event_type") == "error", F.col("user_id") % 16 == 1)


def parts(spark: SparkSession, d: str) -> DataFrame:
    e, cnt = table(spark, d, "events"), (F.col("event_id") % 5 + 1).cast("int")
    last = F.concat((F.col("user_id") % 16 == 1).cast("int").cast("string"), (F.col("event_type") == "error").cast("int").cast("string"))
    return e.select(F.col("event_id").alias("idx"), F.floor(F.col("event_id") / 5).alias("okey"), F.when(cnt == 5, last).otherwise((F.col("user_id") % 2).cast("string")).alias("val"), cnt.alias("cnt"))


def parts_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.keyed_count(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.lit(0).alias("value")), "key", "value")


def supplier_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.keyed_count(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.lit(0).alias("value")), "key", "value")


def customer_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.keyed_count(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit(0).alias("value")), "key", "value")


PARTS_SQL = "(SELECT l_partkey AS key, 0 AS value, count(*) AS count FROM lineitem GROUP BY 1)"
SUPPLIERS_SQL = "(SELECT l_suppkey AS key, 0 AS value, count(*) AS count FROM lineitem GROUP BY 1)"
CUSTOMERS_SQL = "(SELECT o_custkey AS key, 0 AS value, count(*) AS count FROM orders GROUP BY 1)"
FIRST = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS rn FROM {STREAM})"
IMMEDIATE = f"(SELECT key, min(idx) AS i0, max(idx) AS it, max(idx) - min(idx) AS lifetime FROM {FIRST} WHERE rn <= {T} GROUP BY key HAVING count(*) = {T})"
LABEL = "CASE WHEN ones <= 4 AND truth = 1 THEN 'true_anomaly' WHEN ones <= 4 THEN 'false_positive' WHEN truth = 1 THEN 'false_negative' ELSE 'true_negative' END"


def labelled_sql(source: str, by: str = "key", t: int = T) -> str:
    return f"(SELECT {by}, idx, ones, truth, {LABEL} AS label FROM (SELECT {by}, max(idx) AS idx, CAST(sum(value) AS BIGINT) AS ones, max(CASE WHEN rn = {t} THEN truth END) AS truth FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY idx) AS rn FROM {source}) WHERE rn <= {t} GROUP BY {by} HAVING count(*) = {t}))"


LABELLED = labelled_sql(STREAM)


# counting


@query("SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1")
def keyed_count(spark, d):
    return counting.keyed_count(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS count FROM lineitem WHERE l_linenumber <> 0 GROUP BY 1")
def weighted_keyed_count(spark, d):
    return counting.keyed_count(table(spark, d, "lineitem"), "l_partkey", weight=F.col("l_linenumber"))


@query("SELECT l_partkey AS key, l_linenumber AS value, count(*) AS count FROM lineitem GROUP BY 1, 2")
def key_value_count(spark, d):
    return counting.keyed_count(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("value")), "key", "value")


@query(f"SELECT CAST(sum(count) AS BIGINT) AS total, count(DISTINCT key) AS distinct_keys, max(count) AS max_count FROM {PARTS_SQL}")
def total_and_distinct(spark, d):
    return counting.totals(parts_counts(spark, d))


@query("SELECT CAST(key % 4 AS INT) AS level, CAST(sum(count) AS BIGINT) AS total, count(*) AS entries FROM (SELECT l_partkey AS key, count(*) AS count FROM lineitem GROUP BY 1) GROUP BY 1")
def level_totals(spark, d):
    return counting.totals_by(parts_counts(spark, d).withColumn("level", (F.col("key") % 4).cast("int")), "level")


@query(f"SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= {T}")
def heavy_hitters(spark, d):
    return counting.heavy_hitters(table(spark, d, "lineitem"), "l_partkey", T)


@query(f"SELECT count(*) AS keys FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) >= {T})")
def heavy_hitter_count(spark, d):
    return counting.heavy_hitters(table(spark, d, "lineitem"), "l_partkey", T).agg(F.count("*").alias("keys"))


@query(f"SELECT key, 0 AS value, CAST(sum(count) AS BIGINT) AS count FROM (SELECT * FROM {PARTS_SQL} UNION ALL SELECT * FROM {CUSTOMERS_SQL}) GROUP BY 1")
def multiset_merge(spark, d):
    return counting.merge(parts_counts(spark, d), customer_counts(spark, d))


@query(f"SELECT key, 0 AS value, CAST(sum(count) AS BIGINT) AS count FROM (SELECT * FROM {PARTS_SQL} UNION ALL SELECT * FROM {CUSTOMERS_SQL} UNION ALL SELECT * FROM {SUPPLIERS_SQL}) GROUP BY 1")
def multiset_kway_merge(spark, d):
    return counting.merge(parts_counts(spark, d), customer_counts(spark, d), supplier_counts(spark, d))


@query(f"SELECT CAST(sum(a.count * b.count) AS BIGINT) AS inner_product FROM {PARTS_SQL} a JOIN {CUSTOMERS_SQL} b USING (key)")
def multiset_inner_product(spark, d):
    return counting.inner_product(parts_counts(spark, d), customer_counts(spark, d))


@query(f"SELECT sum(a.count * b.count) / (sqrt((SELECT sum(count * count) FROM {PARTS_SQL})) * sqrt((SELECT sum(count * count) FROM {CUSTOMERS_SQL}))) AS cosine FROM {PARTS_SQL} a JOIN {CUSTOMERS_SQL} b USING (key)")
def multiset_cosine(spark, d):
    return counting.cosine(parts_counts(spark, d), customer_counts(spark, d))


@query(f"SELECT * FROM {PARTS_SQL} WHERE key IN (SELECT key FROM {SUPPLIERS_SQL})")
def multiset_intersect(spark, d):
    return counting.intersect(parts_counts(spark, d), supplier_counts(spark, d))


@query(f"SELECT sqrt(CAST(sum(count * count) AS DOUBLE)) AS magnitude FROM {PARTS_SQL}")
def multiset_magnitude(spark, d):
    return counting.magnitude(parts_counts(spark, d))


@query(f"SELECT p.key, p.value, p.count - coalesce(s.count, 0) AS count FROM {PARTS_SQL} p LEFT JOIN {SUPPLIERS_SQL} s USING (key) WHERE p.count - coalesce(s.count, 0) > 0")
def remove_n(spark, d):
    return counting.remove(parts_counts(spark, d), supplier_counts(spark, d))


@query(f"SELECT * FROM {PARTS_SQL} WHERE key NOT IN (SELECT key FROM {SUPPLIERS_SQL})")
def delete_key(spark, d):
    return counting.delete_keys(parts_counts(spark, d), supplier_counts(spark, d))


@query(f"SELECT * FROM {PARTS_SQL} WHERE key NOT IN (SELECT key FROM {SUPPLIERS_SQL}) UNION ALL SELECT * FROM {SUPPLIERS_SQL}")
def replace_value(spark, d):
    return counting.set_count(parts_counts(spark, d), supplier_counts(spark, d))


@query(f"SELECT key, CAST(sum(count) AS BIGINT) AS count FROM (SELECT user_id AS key, event_id % 3 AS shard, count(*) AS count FROM events GROUP BY 1, 2) GROUP BY 1")
def shard_merge(spark, d):
    shards = counting.keyed_count(stream(spark, d).withColumn("shard", F.col("idx") % 3), "key", "shard")
    return counting.shards_combined(shards, "key")


# timely reports


@query(f"SELECT * FROM {IMMEDIATE}")
def immediate_report(spark, d):
    return reports.immediate(stream(spark, d), T)


@query(f"SELECT key, i0, it, lifetime, least((it // 1024 + 1) * 1024 - 1, (SELECT max(event_id) FROM events)) AS report_idx FROM {IMMEDIATE}")
def count_bounded_report(spark, d):
    return reports.chunked(stream(spark, d), T, 1024)


@query(f"SELECT key, i0, it, lifetime, it + CAST(floor(lifetime * 0.25) AS BIGINT) AS report_idx FROM {IMMEDIATE}")
def time_bounded_report(spark, d):
    return reports.time_bounded(stream(spark, d), T, 0.25)


@query(f"SELECT idx, key, count(*) OVER (PARTITION BY key ORDER BY idx) AS running FROM {STREAM}")
def running_count(spark, d):
    return reports.running_count(stream(spark, d)).select("idx", "key", "running")


@query(f"SELECT w.key, w.index, count(s.idx) AS count FROM (SELECT DISTINCT user_id AS key, (SELECT max(event_id) // 2 FROM events) AS index FROM events) w LEFT JOIN {STREAM} s ON s.key = w.key AND s.idx <= w.index GROUP BY 1, 2")
def count_at_index(spark, d):
    s = stream(spark, d)
    half = s.agg(F.floor(F.max("idx") / 2).alias("index"))
    return reports.count_at(s, s.select("key").distinct().crossJoin(F.broadcast(half)))  # one row


@query(f"SELECT key, min(idx) AS i0, max(CASE WHEN rn = 70 THEN idx END) AS it, count(*) AS n FROM {FIRST} WHERE rn <= 70 GROUP BY key")
def key_lifetimes(spark, d):
    return reports.lifetimes(stream(spark, d), 70)


@query(f"SELECT count(*) AS keys, count(CASE WHEN n = 70 THEN 1 END) AS reportable, CAST(sum(CASE WHEN n = 70 THEN it - i0 END) AS BIGINT) AS lifetime_sum FROM (SELECT key, min(idx) AS i0, max(idx) AS it, count(*) AS n FROM {FIRST} WHERE rn <= 70 GROUP BY key)")
def lifetime_summary(spark, d):
    got = reports.lifetimes(stream(spark, d), 70)
    good = F.col("i0") < F.col("it")
    return got.agg(F.count("*").alias("keys"), F.count(F.when(good, 1)).alias("reportable"), F.sum(F.when(good, F.col("it") - F.col("i0"))).alias("lifetime_sum"))


@query(f"SELECT w.key, coalesce(c.count, 0) AS count, i.it AS report_idx FROM (SELECT c_custkey AS key FROM customer) w LEFT JOIN (SELECT key, count(*) AS count FROM {STREAM} GROUP BY 1) c USING (key) LEFT JOIN {IMMEDIATE} i USING (key)")
def point_query(spark, d):
    return reports.point_query(stream(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("key")), T)


EARLY = f"(SELECT key, it AS report_idx, CASE WHEN it % 2 = 0 THEN 'query' ELSE 'merge' END AS via FROM {IMMEDIATE} WHERE it < (SELECT max(event_id) // 3 FROM events))"
SWEPT = f"(SELECT * FROM {EARLY} UNION ALL SELECT key, (SELECT max(event_id) FROM events), 'sweep' FROM {STREAM} WHERE key NOT IN (SELECT key FROM {EARLY}) GROUP BY key HAVING count(*) >= {T})"


def swept(spark, d):
    s = stream(spark, d)
    third = F.broadcast(s.agg(F.floor(F.max("idx") / 3).alias("third")))  # one row
    told = reports.immediate(s, T).crossJoin(third).where("it < third")
    told = told.select("key", F.col("it").alias("report_idx"), F.when(F.col("it") % 2 == 0, "query").otherwise("merge").alias("via"))
    return reports.final_sweep(s, told, T)


@query(f"SELECT * FROM {SWEPT}")
def final_sweep(spark, d):
    return swept(spark, d)


@query(f"SELECT coalesce(via, 'total') AS via, count(*) AS reports FROM {SWEPT} GROUP BY ROLLUP (via)")
def reports_by_channel(spark, d):
    return reports.by_channel(swept(spark, d))


STRETCHED = f"(SELECT i.key, i.i0, i.it, i.lifetime, r.report_idx, (SELECT count(*) FROM {STREAM} s WHERE s.key = i.key AND s.idx <= r.report_idx) AS report_count FROM {IMMEDIATE} i JOIN (SELECT key, least((it // 1024 + 1) * 1024 - 1, (SELECT max(event_id) FROM events)) AS report_idx FROM {IMMEDIATE}) r USING (key))"
RATIOS = f"(SELECT *, report_count / 24.0::DOUBLE AS count_stretch, (report_idx - i0) / lifetime::DOUBLE AS time_stretch FROM {STRETCHED})"


def stretched(spark, d):
    s = stream(spark, d)
    return reports.stretches(s, reports.chunked(s, T, 1024).select("key", "report_idx"), T)


@query(f"SELECT * FROM {RATIOS}")
def report_stretches(spark, d):
    return stretched(spark, d)


@query(f"SELECT min(time_stretch) AS low, quantile_cont(time_stretch, 0.25) AS q1, quantile_cont(time_stretch, 0.5) AS median, quantile_cont(time_stretch, 0.75) AS q3, max(time_stretch) AS high, count(*) AS n FROM {RATIOS}")
def stretch_summary(spark, d):
    return reports.stretch_summary(stretched(spark, d), "time_stretch")


@query(f"SELECT lifetime // 1000 AS bucket, count(*) AS keys, max(count_stretch) AS worst FROM {RATIOS} GROUP BY 1")
def stretch_by_lifetime(spark, d):
    return stretched(spark, d).groupBy(F.floor(F.col("lifetime") / 1000).alias("bucket")).agg(F.count("*").alias("keys"), F.max("count_stretch").alias("worst"))


def violations_of(rule: str) -> str:
    return f"SELECT * FROM {RATIOS} WHERE {rule}"


@query(violations_of("report_idx <> it"))
def validate_immediate(spark, d):
    return reports.violations(stretched(spark, d), "immediate", T)


@query(violations_of("report_count > 24 + 14"))
def validate_count_bound(spark, d):
    return reports.violations(stretched(spark, d), "count", T, slack=sum(reports.thresholds(4, 4, T)[1:]))


@query(violations_of("time_stretch > 1.05 + 1e-12"))
def validate_time_bound(spark, d):
    return reports.violations(stretched(spark, d), "time", T, alpha=0.05)


# bias


@query(f"SELECT * FROM {LABELLED}")
def bias_detect(spark, d):
    return bias.classify(stream(spark, d))


@query(f"SELECT label, count(*) AS keys FROM {LABELLED} GROUP BY 1")
def confusion_matrix(spark, d):
    return bias.confusion(bias.classify(stream(spark, d)))


@query("SELECT count(*) AS datums, count(DISTINCT user_id) AS unique_keys, (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)) AS max_occurrence FROM events")
def bias_stats(spark, d):
    return bias.stats(stream(spark, d))


NEXT = f"(SELECT *, key % 8 AS shard, lag(idx) OVER (PARTITION BY key ORDER BY idx) AS p, lead(idx) OVER (PARTITION BY key ORDER BY idx) AS q FROM {STREAM})"
EPOCHS_JOINED = f"(WITH n AS {NEXT}, f AS (SELECT a.idx, any_value(a.key) AS key, any_value(a.value) AS value, any_value(a.truth) AS truth, any_value(a.shard) AS shard, CASE WHEN any_value(a.p) IS NULL OR count(b.idx) >= 4 THEN 1 ELSE 0 END AS fresh FROM n a LEFT JOIN n b ON b.shard = a.shard AND b.idx > a.p AND b.idx < a.idx AND (b.q IS NULL OR b.q > a.idx) GROUP BY a.idx) SELECT idx, key, value, truth, CAST(shard AS INT) AS shard, CAST(sum(fresh) OVER (PARTITION BY key ORDER BY idx) AS INT) AS epoch FROM f)"


@query(f"SELECT * FROM {EPOCHS_JOINED}")
def lru_epochs(spark, d):
    return bias.lru_epochs(stream(spark, d), 4, 8)


@query(f"SELECT * FROM {labelled_sql(EPOCHS_JOINED, 'key, epoch', 3)}")
def lru_bias_detect(spark, d):
    return bias.lru_classify(stream(spark, d), 4, 8, threshold=3)


def inner_sql(rule: str = "TRUE") -> str:
    return f"(SELECT okey, max(idx) AS idx, CAST(sum(CASE WHEN cnt <= 4 THEN bit * CAST(65536 ** (cnt - 1) AS BIGINT) END) AS BIGINT) AS key, max(CASE WHEN cnt = 5 THEN value END) AS value, max(CASE WHEN cnt = 5 THEN truth END) AS truth FROM {PARTS} WHERE {rule} GROUP BY okey HAVING count(*) = 5)"


@query(f"SELECT * FROM {inner_sql()}")
def two_level_assembly(spark, d):
    return bias.assemble(parts(spark, d))


@query(f"SELECT * FROM {inner_sql('idx % 37 <> 0')}")
def two_level_with_losses(spark, d):
    return bias.assemble(parts(spark, d).where("idx % 37 <> 0"))


@query(f"SELECT * FROM {labelled_sql(inner_sql(), 'key', 8)}")
def two_level_bias(spark, d):
    return bias.classify(bias.assemble(parts(spark, d)), 8)


@query(f"SELECT idx, okey, cnt, before FROM (SELECT idx, okey, cnt, lag(cnt) OVER (PARTITION BY okey ORDER BY idx) AS before FROM {PARTS} WHERE idx % 37 <> 0) WHERE cnt <> coalesce(before, 0) + 1")
def gap_discard(spark, d):
    return bias.gaps(parts(spark, d).where("idx % 37 <> 0")).select("idx", "okey", "cnt", "before")


#: Outer keys of which 16 or 64 are interleaved: of 320 events in a row, key k of a round sends its part in each of five passes.
WOVEN = "(SELECT idx, okey, cnt, bit, truth, value, size, spot FROM (SELECT event_id AS idx, size, (event_id % 320) % size AS spot, event_id // 320 * 320 + (event_id % (5 * size) % size) + (event_id % 320) // (5 * size) * size AS okey, CAST(event_id % (5 * size) // size + 1 AS INT) AS cnt, user_id % 2 AS bit, CAST(user_id % 16 = 1 AS INT) AS truth, CAST(event_type = 'error' AS INT) AS value FROM (SELECT *, CASE WHEN event_id // 320 % 2 = 0 THEN 16 ELSE 64 END AS size FROM events)))"
#: With a table of 32, only the last 32 of 64 interleaved keys outlive the first pass; a round that breaks off completes none.
WOVEN_INNER = f"(SELECT okey, max(idx) AS idx, CAST(sum(CASE WHEN cnt <= 4 THEN bit * CAST(65536 ** (cnt - 1) AS BIGINT) END) AS BIGINT) AS key, max(CASE WHEN cnt = 5 THEN value END) AS value, max(CASE WHEN cnt = 5 THEN truth END) AS truth FROM {WOVEN} GROUP BY okey HAVING count(*) = 5 AND min(spot) >= min(size) - 32)"


def woven(spark: SparkSession, d: str) -> DataFrame:
    e, at = table(spark, d, "events"), F.col("event_id")
    size = F.when(F.floor(at / 320) % 2 == 0, 16).otherwise(64)
    cnt = (F.floor(at % (5 * size) / size) + 1).cast("int")
    okey = F.floor(at / 320) * 320 + at % (5 * size) % size + F.floor(at % 320 / (5 * size)) * size
    last = F.concat((F.col("user_id") % 16 == 1).cast("int").cast("string"), (F.col("event_type") == "error").cast("int").cast("string"))
    return e.select(at.alias("idx"), okey.cast("long").alias("okey"), F.when(cnt == 5, last).otherwise((F.col("user_id") % 2).cast("string")).alias("val"), cnt.alias("cnt"))


@query(f"SELECT * FROM {WOVEN_INNER}")
def two_level_bounded_assembly(spark, d):
    return bias.assemble_bounded(woven(spark, d), 32, 1, block_rows=700)


def epochs_sql(source: str, capacity: int, shards: int) -> str:
    """Each row of a stream with the stay of its key in a table of so many keys, by counting the keys between."""
    steps = f"(SELECT *, CAST(((key % {shards}) + {shards}) % {shards} AS INT) AS shard, lag(idx) OVER (PARTITION BY key ORDER BY idx) AS p, lead(idx) OVER (PARTITION BY key ORDER BY idx) AS q FROM {source})"
    return f"(WITH n AS {steps}, f AS (SELECT a.idx, any_value(a.key) AS key, any_value(a.value) AS value, any_value(a.truth) AS truth, any_value(a.shard) AS shard, CASE WHEN any_value(a.p) IS NULL OR count(b.idx) >= {capacity} THEN 1 ELSE 0 END AS fresh FROM n a LEFT JOIN n b ON b.shard = a.shard AND b.idx > a.p AND b.idx < a.idx AND (b.q IS NULL OR b.q > a.idx) GROUP BY a.idx) SELECT idx, key, value, truth, shard, CAST(sum(fresh) OVER (PARTITION BY key ORDER BY idx) AS INT) AS epoch FROM f)"


@query(f"SELECT * FROM {labelled_sql(epochs_sql(WOVEN_INNER, 12, 1), 'key, epoch', 4)}")
def two_level_lru_bias(spark, d):
    return bias.lru_classify(bias.assemble_bounded(woven(spark, d), 32, 1, block_rows=700), 12, 1, threshold=4, block_rows=300)


@query(f"SELECT * FROM {epochs_sql(STREAM, 6, 2)}")
def lru_epochs_in_blocks(spark, d):
    return bias.lru_epochs(stream(spark, d), 6, 2, block_rows=100)


@query(f"SELECT (SELECT count(*) FROM {SWEPT}) AS total, (SELECT count(*) FROM {SWEPT} WHERE via = 'merge') AS via_merge, (SELECT count(*) FROM {SWEPT} WHERE via = 'query') AS via_query, (SELECT count(*) FROM events WHERE event_type = 'error') AS on_demand, (SELECT count(*) FROM customer) AS point_queries")
def report_counters(spark, d):
    return reports.counters(swept(spark, d), table(spark, d, "events").where("event_type = 'error'"), table(spark, d, "customer"))


#: Multisets of (key, value) pairs, values from 0 on: parts by line number, suppliers by return flag.
VALUED = "(SELECT l_partkey AS key, l_linenumber - 1 AS value, count(*) AS count FROM lineitem GROUP BY 1, 2)"
FLAGGED = "(SELECT l_suppkey AS key, CAST(l_returnflag = 'R' AS INT) AS value, count(*) AS count FROM lineitem GROUP BY 1, 2)"


def valued(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem")
    a = rows.select(F.col("l_partkey").alias("key"), (F.col("l_linenumber") - 1).alias("value"))
    b = rows.select(F.col("l_suppkey").alias("key"), (F.col("l_returnflag") == "R").cast("int").alias("value"))
    return counting.keyed_count(a, "key", "value"), counting.keyed_count(b, "key", "value")


@query(f"SELECT CAST(sum(a.count * b.count) AS BIGINT) AS inner_product FROM {VALUED} a JOIN {FLAGGED} b ON a.key = b.key AND b.value = 0")
def valued_inner_product(spark, d):
    return counting.inner_product(*valued(spark, d))


@query(f"SELECT a.key, a.value, a.count FROM {VALUED} a WHERE a.key IN (SELECT key FROM {FLAGGED} WHERE value = 0)")
def valued_intersect(spark, d):
    return counting.intersect(*reversed(valued(spark, d)))


# scoring


LOSSY = labelled_sql(f"(SELECT * FROM {STREAM} WHERE idx % 11 <> 0)")


@query(f"WITH a AS {LABELLED}, b AS {LOSSY}, ea AS (SELECT label, key FROM a WHERE label <> 'true_negative'), eb AS (SELECT label, key FROM b WHERE label <> 'true_negative'), s AS (SELECT (SELECT count(*) FROM (SELECT * FROM ea EXCEPT ALL SELECT * FROM eb)) AS missing, (SELECT count(*) FROM (SELECT * FROM eb EXCEPT ALL SELECT * FROM ea)) AS extra, abs((SELECT count(*) FROM a WHERE label = 'true_negative') - (SELECT count(*) FROM b WHERE label = 'true_negative')) AS negatives) SELECT missing, extra, negatives, missing + extra + negatives AS score FROM s")
def score(spark, d):
    s = stream(spark, d)
    return scoring.score(bias.classify(s), bias.classify(s.where("idx % 11 <> 0")))


@query("SELECT event_id % 4 AS sender, 100.0::DOUBLE - 100.0::DOUBLE * least(count(CASE WHEN event_id % 11 <> 0 THEN 1 END), count(*)) / count(*) AS percent FROM events GROUP BY 1")
def drop_rate(spark, d):
    got = stream(spark, d).groupBy((F.col("idx") % 4).alias("sender")).agg(F.count("*").alias("sent"), F.count(F.when(F.col("idx") % 11 != 0, 1)).alias("received"))
    return got.select("sender", scoring.drop_rate(F.col("sent"), F.col("received")).alias("percent"))


# packets and routing


@query(f"SELECT idx // 50 AS packet_id, CAST(idx % 50 AS INT) AS pos, key, value, truth FROM {STREAM}")
def packet_parse(spark, d):
    return streams.parse_packets(streams.to_packets(stream(spark, d)))


@query("SELECT event_id // 50 % 3 AS sender, count(DISTINCT event_id // 50) AS packets FROM events GROUP BY 1")
def sender_tally(spark, d):
    return streams.packets_by_sender(streams.parse_packets(streams.to_packets(stream(spark, d))), 3)


def hashed_sql(keys: str = "SELECT DISTINCT l_partkey AS key FROM lineitem") -> str:
    m = (1 << 48) - 1
    steps = [f"SELECT key, (({m} - key::HUGEINT) + (key::HUGEINT << 21)) & {m} AS h FROM ({keys})"]
    for shift, factor in ((24, 265), (14, 21), (28, (1 << 31) + 1)):
        steps.append(f"SELECT key, (xor(h, h >> {shift}) * {factor}::HUGEINT) & {m} AS h FROM ({steps[-1]})")
    return f"(SELECT key, CAST(h AS BIGINT) AS hash FROM ({steps[-1]}))"


def hashed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct().withColumn("hash", hashing.hash_64(F.col("key")))


@query(f"SELECT key, hash, CAST(hash // {1 << 45} AS BIGINT) AS cone, hash % {1 << 45} AS rest, key % 5 AS worker FROM {hashed_sql()}")
def cone_routing(spark, d):
    h = F.col("hash")
    return hashed(spark, d).select("key", "hash", hashing.cone(h, 8).alias("cone"), hashing.key_in_cone(h, 8).alias("rest"), hashing.partition_of(F.col("key"), 5).alias("worker"))


@query(f"SELECT CAST(hash // {1 << 45} AS BIGINT) AS cone, CAST(sum(c.count) AS BIGINT) AS total, count(*) AS entries FROM {hashed_sql()} h JOIN {PARTS_SQL} c USING (key) GROUP BY 1")
def cone_totals(spark, d):
    counts = parts_counts(spark, d).withColumn("cone", hashing.cone(hashing.hash_64(F.col("key")), 8))
    return counting.totals_by(counts, "cone")


@query(f"SELECT CAST(h.hash // {1 << 45} AS BIGINT) AS cone, h.key, c.count FROM {hashed_sql()} h JOIN {PARTS_SQL} c USING (key) WHERE c.count >= {T}")
def cone_heavy_hitters(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"))
    return counting.keyed_count(rows.withColumn("cone", hashing.cone(hashing.hash_64(F.col("key")), 8)), "cone", "key").where(F.col("count") >= T)


@query(f"SELECT key FROM {hashed_sql()}")
def hash_inverse(spark, d):
    return hashed(spark, d).select(hashing.numpy_udf(hashing.hash_64_inverse)("hash").alias("key"))


@query(f"SELECT h.key, 0 AS value, c.count, h.hash FROM {hashed_sql()} h JOIN {PARTS_SQL} c USING (key) WHERE h.hash >= {1 << 47} ORDER BY h.hash LIMIT 100")
def hash_ordered_page(spark, d):
    """A page of the table in hash order, found by seeking."""
    return counting.in_hash_order(parts_counts(spark, d), 1 << 47).limit(100)


@query(f"SELECT * FROM (SELECT h.key, 0 AS value, c.count, h.hash, row_number() OVER (ORDER BY h.hash) - 1 AS place FROM {hashed_sql()} h JOIN {PARTS_SQL} c USING (key)) WHERE place BETWEEN 700 AND 899")
def page_by_place(spark, d):
    """A page of the table in hash order, found by its place."""
    return counting.at_places(parts_counts(spark, d), 700, 200)


@query(f"SELECT key, value, CAST(sum(count) AS BIGINT) AS count FROM (SELECT * FROM {PARTS_SQL} UNION ALL SELECT * FROM {SUPPLIERS_SQL} UNION ALL SELECT * FROM {CUSTOMERS_SQL}) GROUP BY key, value")
def merged_snapshots(spark, d):
    """Counts of parts as a bucketed snapshot, to which those of suppliers and customers are added bucket by bucket."""
    mark = uuid.uuid4().hex
    folder = f"{shared_dir(spark)}/snapshots-{mark}"
    snapshots.save(parts_counts(spark, d), f"parts_{mark}", f"{folder}/parts", 8)
    snapshots.advance(spark, f"parts_{mark}", supplier_counts(spark, d), f"both_{mark}", f"{folder}/both", 8)
    snapshots.save(customer_counts(spark, d), f"customers_{mark}", f"{folder}/customers", 8)
    return snapshots.merged(spark, f"both_{mark}", f"customers_{mark}")


@query(f"SELECT CAST(h.hash // {1 << 45} AS INT) AS cone, s.key, count(*) AS count, min(s.idx) AS i0, max(CASE WHEN s.rn = {T} THEN s.idx END) AS it FROM {FIRST} s JOIN {hashed_sql("SELECT DISTINCT user_id AS key FROM events")} h USING (key) GROUP BY 1, 2")
def cone_reports(spark, d):
    return reports.by_cone(stream(spark, d), T, 8)


#: Heavy hitters by what they have of all rows: 1 part in 400 of the line items, and of their quantities.
@query(f"SELECT l_suppkey AS key, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= 600")
def sketched_heavy_hitters(spark, d):
    return frequent.heavy_hitters(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key")), "key", 600)


@query("SELECT l_partkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT)) >= 1000")
def sketched_heavy_weights(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("w"))
    return frequent.heavy_hitters(rows, "key", 1000, "w")


#: Mutations made of the events, for 60 keys: errors delete a key, signups set its count, purchases take off three.
OPS = "(SELECT event_id AS idx, user_id % 60 AS key, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'remove' ELSE 'insert' END AS op, CASE event_type WHEN 'signup' THEN user_id % 4 WHEN 'purchase' THEN 3 ELSE 1 END AS count FROM events)"
SEGMENTS = f"(SELECT *, sum(r) OVER (PARTITION BY key ORDER BY idx) AS seg FROM (SELECT *, CASE WHEN op = 'delete' OR op = 'set' AND count > 0 THEN 1 ELSE 0 END AS r, CASE op WHEN 'insert' THEN count WHEN 'remove' THEN -count ELSE 0 END AS d FROM {OPS}))"
SUMMED = f"(SELECT *, sum(d) OVER (PARTITION BY key, seg ORDER BY idx) AS s, max(CASE WHEN r = 1 THEN CASE op WHEN 'set' THEN count ELSE 0 END END) OVER (PARTITION BY key, seg) AS start FROM {SEGMENTS})"
NOW = f"(SELECT idx, key, op, count, CAST(greatest(coalesce(start, 0) + s, s - min(s) OVER (PARTITION BY key, seg ORDER BY idx)) AS BIGINT) AS now FROM {SUMMED})"


def ops(spark: SparkSession, d: str) -> DataFrame:
    e, kind = table(spark, d, "events"), F.col("event_type")
    op = F.when(kind == "error", "delete").when(kind == "signup", "set").when(kind == "purchase", "remove").otherwise("insert")
    count = F.when(kind == "signup", F.col("user_id") % 4).when(kind == "purchase", 3).otherwise(1)
    return e.select(F.col("event_id").alias("idx"), (F.col("user_id") % 60).alias("key"), op.alias("op"), count.alias("count"))


@query(f"SELECT *, CAST(now - coalesce(lag(now) OVER (PARTITION BY key ORDER BY idx), 0) AS BIGINT) AS applied FROM {NOW}")
def mutations_in_order(spark, d):
    return mutations.apply_in_order(ops(spark, d))


@query(f"SELECT key, max_by(now, idx) AS count FROM {NOW} GROUP BY key HAVING max_by(now, idx) > 0")
def counts_after_mutations(spark, d):
    return mutations.counts_after(ops(spark, d), block_rows=500)
