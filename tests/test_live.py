"""What is asked of running streams, delayed reports, sources that can be read again and logs that are written once."""

import glob
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keytide.functions import hashing
from keytide.operators import counting, reports
from keytide.sources import stored, streams
from keytide.streaming import timely

SCHEMA = "idx long, key long, value int, truth int"


def rows_of(seed, n=1200, keys=30):
    r = random.Random(seed)
    return pd.DataFrame([(i, r.choice([1, r.randrange(keys)]), r.randrange(2), 1) for i in range(n)], columns=["idx", "key", "value", "truth"]).astype({"value": "int32", "truth": "int32"})


def put(rows, folder, name, at):
    os.makedirs(folder, exist_ok=True)
    rows.to_parquet(f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (1000 + at, 1000 + at))


def source(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").option("path", f"{tmp_path}/out-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/out-{name}")


def test_state_answers_point_queries_of_any_batch(spark, tmp_path):
    rows = rows_of(1)
    for k in range(3):
        put(rows.iloc[400 * k : 400 * (k + 1)].sample(frac=1, random_state=k), tmp_path / "in", k, k)
    told = run(timely.report(source(spark, tmp_path / "in"), 24), tmp_path, "q")
    assert told.count() > 5
    keys = spark.createDataFrame([(k,) for k in [*range(33), 5]], "key long")
    whole = spark.createDataFrame(rows, SCHEMA)
    for batch, n in ((None, 1200), (0, 400), (1, 800)):
        got = timely.live_point_query(spark, f"{tmp_path}/cp-q", keys, batch)
        want = reports.point_query(whole.where(F.col("idx") < n), keys, 24)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert timely.live_counts(spark, f"{tmp_path}/cp-q").agg(F.sum("count")).first()[0] == 1200


def barrier(spark, tmp_path, then):
    q = timely.stopped_in_state(source(spark, tmp_path / "packets", "value string")).writeStream.outputMode("complete").foreachBatch(then)
    q.option("checkpointLocation", f"{tmp_path}/cp-barrier").trigger(availableNow=True).start().awaitTermination(120)


@pytest.mark.parametrize("policy", ["time", "count"])
def test_delayed_reports_wait_and_are_swept_once_all_senders_stopped(spark, tmp_path, policy):
    rows = rows_of(2, 1500, 45)
    for k in range(3):
        put(rows.iloc[500 * k : 500 * (k + 1)].sample(frac=1, random_state=k), tmp_path / "a", k, k)
    put(rows.iloc[:0], tmp_path / "b", "none", 0)

    def go():
        closed = timely.closing(spark, str(tmp_path / "closed"))
        senders = [timely.with_closing(source(spark, tmp_path / s), closed) for s in "ab"]
        return run(timely.delayed(senders, 24, policy, 0.5, 64), tmp_path, "q")

    close = timely.close_when_all_stopped(str(tmp_path / "closed"), 2)
    put(pd.DataFrame({"value": ["packet 1\n1,0,0\n", "0", "0"]}), tmp_path / "packets", 0, 0)
    barrier(spark, tmp_path, close)
    assert go().count() == 0  # the other sender was not heard of at all
    put(pd.DataFrame({"value": ["1"]}), tmp_path / "packets", 1, 1)
    barrier(spark, tmp_path, close)
    told = go()  # both restarted from their checkpoints
    whole = spark.createDataFrame(rows, SCHEMA)
    got = timely.settled(told, 1499)
    want = reports.time_bounded(whole, 24, 0.5) if policy == "time" else reports.chunked(whole, 24, 64)
    assert {x.key: x.report_idx for x in got.collect()} == {x.key: min(x.report_idx, 1499) for x in want.collect()}
    assert told.count() == counting.heavy_hitters(whole, "key", 24).count() > 5
    bad = reports.violations(reports.stretches(whole, got.select("key", "report_idx"), 24), policy, 24, alpha=0.5, slack=64)
    assert bad.count() == 0


def test_one_sender_is_told_as_the_stream_goes(spark, tmp_path):
    rows = rows_of(3, 1500, 20)
    for k in range(3):
        put(rows.iloc[500 * k : 500 * (k + 1)], tmp_path / "a", k, k)
    closed = timely.closing(spark, str(tmp_path / "closed"))
    go = lambda: run(timely.delayed([timely.with_closing(source(spark, tmp_path / "a"), closed)], 24, "count", chunk=100), tmp_path, "q")
    first = {x.key: x for x in go().collect()}
    want = {x.key: x.report_idx for x in reports.chunked(spark.createDataFrame(rows, SCHEMA), 24, 100).collect()}
    assert {k: x.due for k, x in first.items()} == {k: v for k, v in want.items() if v < 1499} and first and not any(x.swept for x in first.values())
    spark.range(1).select(F.col("id").alias("closed")).write.mode("append").parquet(str(tmp_path / "closed"))
    assert {x.key: min(x.due, 1499) for x in go().collect()} == want


def test_keys_are_streamed_from_files_and_read_again(spark, tmp_path):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    for k in range(3):
        os.makedirs(tmp_path / "keys", exist_ok=True)
        (tmp_path / "keys" / f"keys-{k:06d}").write_bytes(keys[1000 * k : 1000 * (k + 1)].astype("<i8").tobytes())
    (tmp_path / "keys" / "_hidden").write_bytes(b"x" * 80)
    got = streams.read_binary_keys(spark, str(tmp_path / "keys"), 300)
    assert got.rdd.getNumPartitions() == 12
    assert [x.key for x in got.orderBy("idx").collect()] == keys[:3000].tolist()
    seen = run(streams.stream_binary_keys(spark, str(tmp_path / "keys")), tmp_path, "k")
    assert seen.count() == 3000
    (tmp_path / "keys" / "keys-000003").write_bytes(keys[3000:].astype("<i8").tobytes())
    seen = run(streams.stream_binary_keys(spark, str(tmp_path / "keys")), tmp_path, "k")
    assert [(x.idx, x.key) for x in seen.orderBy("idx").collect()] == list(enumerate(keys.tolist()))
    streams.write_binary_keys(got, f"file:{tmp_path}/copy")
    assert [x.key for x in streams.read_binary_keys(spark, str(tmp_path / "copy")).orderBy("idx").collect()] == keys[:3000].tolist()
    assert streams.read_binary_keys(spark, str(tmp_path / "nothing")).count() == 0


def test_a_repeated_batch_leaves_one_line_a_key(spark, tmp_path):
    table = pd.DataFrame({"via": "merge", "key": range(300), "value": 0, "count": 24, "level": 1}).astype({"level": "int32"})
    put(table.iloc[:200], tmp_path / "in", 0, 0)
    put(table.iloc[200:], tmp_path / "in", 1, 1)
    log = str(tmp_path / "log")

    def go():
        q = streams.stream_reports(source(spark, tmp_path / "in", "via string, key long, value long, count long, level int").repartition(4), log).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return stored.read_report_log(spark, log)

    lines = go()
    assert lines.count() == 300 and {x.batch for x in lines.collect()} == {0, 1}
    for f in ("1", ".1.crc"):
        os.remove(f"{tmp_path}/cp/commits/{f}")  # as if the run had ended between the log's commit and its own
    again = go()
    keys = [int(re.search(r"Key: (\d+)", x.value)[1]) for x in again.collect()]
    assert sorted(keys) == list(range(300)) and len(glob.glob(f"{log}/parts/*.log")) <= 8
    writer = stored.ReportLogWriter({"path": log}, ["value"])
    lost, kept = (writer.write(iter([{"value": "x"}])) for _ in range(2))  # a task's two attempts, of which the first was lost
    writer.commit([kept, None, writer.write(iter([]))], 7)
    assert lost.name != kept.name and stored.read_report_log(spark, log).where("batch = 7").count() == 1


def test_the_barrier_remembers_senders_over_a_restart(spark, tmp_path):
    packets = lambda *t: pd.DataFrame({"value": list(t)})
    put(packets("packet 1\n1,0,0\n", "3", "3"), tmp_path / "packets", 0, 0)
    stop = timely.stop_when_all_stopped(spark, "main", 2)
    main = spark.readStream.format("rate").load().writeStream.format("noop").queryName("main").option("checkpointLocation", f"{tmp_path}/main").start()
    barrier(spark, tmp_path, stop)
    assert main.isActive
    put(packets("4"), tmp_path / "packets", 1, 1)
    barrier(spark, tmp_path, stop)
    assert main.awaitTermination(60)


def test_a_cone_has_a_partition_of_its_own(spark):
    s = spark.createDataFrame(rows_of(4, 3000, 200), SCHEMA)
    got = reports.by_cone(s, 24, 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    cone = hashing.cone(hashing.hash_64(F.col("key")), 8)
    assert got.where((F.spark_partition_id() != F.col("cone")) | (cone != F.col("cone"))).count() == 0
    assert got.select("cone").distinct().count() > 5
    want = reports.lifetimes(s, 24).join(counting.keyed_count(s, "key"), "key").select("key", "count", "i0", "it")
    assert sorted(map(tuple, got.drop("cone").collect())) == sorted(map(tuple, want.collect()))


def test_snapshots_merge_without_a_shuffle(spark, tmp_path):
    from keytide.sources import snapshots

    r = random.Random(6)
    made = [spark.createDataFrame([(r.choice([1, r.randrange(300)]), r.randrange(3), 1) for _ in range(2000)], "key long, value int, w int") for _ in range(3)]
    counts = [counting.keyed_count(x, "key", "value") for x in made]
    for k, c in enumerate(counts[:2]):
        snapshots.save(c, f"snap{k}", f"{tmp_path}/snap{k}", 6)
    got = snapshots.merged(spark, "snap0", "snap1")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, counting.merge(*counts[:2]).collect()), key=str)
    assert len(glob.glob(f"{tmp_path}/snap0/*.parquet")) <= 6
    after = snapshots.advance(spark, "snap0", counts[1], "snap2", f"{tmp_path}/snap2", 6)
    last = snapshots.advance(spark, "snap2", counts[2], "snap3", f"{tmp_path}/snap3", 6)
    assert after.count() == got.count() and len(glob.glob(f"{tmp_path}/snap3/merged/*.parquet")) <= 6
    assert sorted(map(tuple, last.collect()), key=str) == sorted(map(tuple, counting.merge(*counts).collect()), key=str)
    with pytest.raises(Exception, match="key is null"):
        snapshots.save(spark.createDataFrame([(None, 0, 1)], "key long, value int, count long"), "snap4", f"{tmp_path}/snap4", 6)
    for t in ("snap0", "snap1", "snap2", "snap3", "snap2_delta", "snap3_delta"):
        spark.sql(f"DROP TABLE {t}")
