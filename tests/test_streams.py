import os
import random
import socket
import threading
import time
from collections import OrderedDict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keytide.functions import hashing
from keytide.operators import bias, counting, reports, scoring
from keytide.sources import generators, streams, udp
from keytide.streaming import timely


def test_hashes():
    keys = np.array([0, 1, 24, 1000000065, (1 << 48) - 1], dtype=np.uint64)
    want = np.array([131731959509019, 136793493403854, 111762397121225, 11501139732237, 278361220053720], dtype=np.uint64)
    assert (hashing.hash_64_inverse(want) == keys).all()
    assert hashing.murmur64a(keys[:4]).tolist() == [14049860737169413206, 14441511261715443234, 5096088694746127453, 9486938725208878033]
    assert len(set(hashing.murmur64b(np.arange(5000, dtype=np.uint64)).tolist())) == 5000
    some = np.random.default_rng(1).integers(1 << 48, size=2000, dtype=np.uint64)
    assert len(set(hashing.evahash(some, 12345).tolist())) > 1990


def test_hash_and_inverse_in_spark(spark):
    rows = spark.range(2000).select((F.col("id") * 140737488355 % (1 << 48)).alias("k"))
    back = rows.withColumn("h", hashing.hash_64(F.col("k"))).withColumn("b", hashing.numpy_udf(hashing.hash_64_inverse)("h"))
    assert back.where("b <> k OR h < 0").count() == 0
    assert back.select("h").distinct().count() == back.select("k").distinct().count()
    big = spark.createDataFrame([("17996431805658317590",), ("5",)], "t string").select(hashing.unsigned(hashing.from_unsigned(F.col("t"))).cast("string").alias("t"))
    assert [r.t for r in big.collect()] == ["17996431805658317590", "5"]


def test_hash_is_a_short_expression(spark):
    """Where a hash stands in a filter, Spark evaluates the key as often as it is written out."""
    assert str(hashing.hash_64(F.col("the_key"))).count("the_key") <= 40
    rows = spark.createDataFrame([(k,) for k in (0, 1, 24, 1000000065, (1 << 48) - 1, -1, 1 << 48, None)], "k long")
    got = [r.h for r in rows.select(hashing.hash_64(F.col("k")).alias("h")).collect()]
    assert got == [131731959509019, 136793493403854, 111762397121225, 11501139732237, 278361220053720, 278361220053720, 131731959509019, None]
    assert rows.where(hashing.hash_64(F.col("k"), 8).between(0, 255)).count() == 7


def test_power_law_reproduces_the_recorded_results(spark):
    """10,000 packets: 8296 keys, at most 166654 times one, 3 true anomalies and 460 true negatives."""
    s = generators.powerlaw(spark, 10_000).cache()
    assert tuple(bias.stats(s).first()) == (500_000, 8296, 166654)
    got = bias.classify(s)
    assert {r.label: r["keys"] for r in bias.confusion(got).collect()} == {"true_anomaly": 3, "true_negative": 460}
    assert [r.value for r in scoring.event_lines(got).collect()] == [f"true_anomaly = {k}".replace("_", " ") for k in (1000000065, 1000000183, 1000000333)]
    parsed = scoring.parsed_lines(scoring.event_lines(got).select("value")).collect()
    assert parsed[0].name == "true anomaly" and parsed[0].value == "1000000065"
    s.unpersist()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_arbitrary_mixes(spark, kind):
    got = generators.arbitrary(spark, kind, 5000, 800).toPandas()
    assert sorted(got.idx) == list(range(len(got)))
    n = got.key.value_counts()
    if kind == 1:
        assert (n >= 24).sum() == 100 and n.max() <= 50
    if kind == 2:
        assert (n == 24).sum() == 100 and set(n) == {23, 24}
    if kind == 3:
        assert (n > 1).sum() == 100 and got.sort_values("idx").key.head(800).is_unique
    if kind == 4:
        assert 1 <= n.min() and n.max() <= 24


def test_other_generators(spark):
    z = generators.zipf(spark, 20_000, 1_000_000)
    n = counting.keyed_count(z, "key").orderBy(F.desc("count")).limit(2).collect()
    assert 1.8 < n[0]["count"] / n[1]["count"] < 4 and z.agg(F.max("key")).first()[0] < 1 << 48
    a = generators.active_set(spark, 20_000, 2000).toPandas()
    assert sorted(a.idx) == list(range(len(a))) and set(a.value) == {0, 1}
    t = generators.two_level(spark, 3000)
    inner = bias.assemble(t)
    full = t.groupBy("okey").agg(F.max("cnt").alias("c")).where("c = 5").count()
    assert inner.count() == full and inner.select("key").distinct().count() < full
    planted = generators.with_planted(z, spark.createDataFrame([(0, 7), (19_999, 7)], "idx long, key long"))
    assert planted.where("key = 7").count() == 2 and planted.count() == 20_000


def test_lru_against_a_dictionary(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(40)) for i in range(3000)]
    s = spark.createDataFrame(rows, "idx long, key long").withColumns({"value": F.lit(0), "truth": F.lit(0)}).repartition(4)
    live, epoch, want = {k: OrderedDict() for k in range(3)}, {}, []
    for i, k in rows:
        t = live[k % 3]
        if k in t:
            t.move_to_end(k)
        else:
            if len(t) >= 5:
                t.popitem(last=False)
            t[k] = 1
            epoch[k] = epoch.get(k, 0) + 1
        want.append((i, k, epoch[k]))
    assert sorted((x.idx, x.key, x.epoch) for x in bias.lru_epochs(s, 5, 3).collect()) == want


def test_assembly_against_a_state_machine(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(200), r.choice(["00", "01", "10", "11"]) if (c := r.choice([1, 2, 3, 4, 5, 5])) == 5 else str(r.randrange(65536)), c) for i in range(200)]
    at = 200
    for k in range(300):  # mostly in order, with losses and restarts
        for c in range(1, 6):
            if r.random() < 0.93:
                rows.append((at, k % 150, r.choice(["00", "01", "10", "11"]) if c == 5 else str(r.randrange(65536)), c))
                at += 1
    state, want = {}, []
    for i, k, v, c in rows:
        if k not in state:
            if c <= 1:
                state[k] = (1, int(v))
        elif state[k][0] != c - 1:
            del state[k]
        elif c <= 4:
            state[k] = (c, state[k][1] | int(v) << 16 * (c - 1))
        else:
            key = state.pop(k)[1]
            want.append((i, key - (1 << 64) if key >> 63 else key, int(v[1] != "0"), int(v[0] != "0")))
    got = bias.assemble(spark.createDataFrame(rows, "idx long, okey long, val string, cnt int").repartition(3))
    assert len(want) > 80 and sorted((x.idx, x.key, x.value, x.truth) for x in got.collect()) == sorted(want)


def test_thresholds_and_edge_cases(spark):
    assert [reports.thresholds(*x) for x in ((4, 4, 24), (3, 4, 24), (3, 2, 24))] == [[10, 8, 4, 2], [18, 4, 2], [22, 1, 1]]
    with pytest.raises(ValueError):
        reports.thresholds(5, 8, 24)
    with pytest.raises(ValueError):
        bias.classify(spark.range(1), 1)
    empty = spark.createDataFrame([], "idx long, key long, value int, truth int")
    assert reports.immediate(empty, 24).count() == bias.classify(empty).count() == 0
    one = spark.createDataFrame([(0, 5, 1, 0)], empty.schema)
    assert reports.immediate(one, 1).count() == 1 and reports.lifetimes(one, 1).where("i0 < it").count() == 0


def test_files(spark, tmp_path):
    keys = np.array([3, 2**63 + 5, 1, 3], dtype="<u8")
    (tmp_path / "k.bin").write_bytes(keys.tobytes())
    got = streams.read_binary_keys(spark, str(tmp_path / "k.bin"))
    assert [(r.idx, r.key) for r in got.orderBy("idx").collect()] == list(enumerate(keys.view(np.int64).tolist()))
    (tmp_path / "k.txt").write_text("3 9223372036854775813\n 1\n\n3")
    assert sorted(r.key for r in streams.read_text_keys(spark, str(tmp_path / "k.txt")).collect()) == sorted(keys.view(np.int64).tolist())
    assert streams.line_count(spark, str(tmp_path / "k.txt")) == 4
    (tmp_path / "life").write_text("1 2 9\n2 5 5\n")
    assert streams.read_lifetimes(spark, str(tmp_path / "life")).count() == 1
    counts = counting.keyed_count(got, "key")
    streams.save_counts(counts, str(tmp_path / "c"))
    assert sorted(streams.load_counts(spark, str(tmp_path / "c")).collect()) == sorted(counts.collect())
    s = spark.range(3000).select(F.col("id").alias("idx"), (F.col("id") % 7).alias("key"), F.lit(1).alias("value"), F.lit(0).alias("truth"))
    st = reports.stretches(s, reports.chunked(s, 24, 1024).select("key", "report_idx"), 24)
    for policy, head in streams.DUMPS.items():
        streams.write_validation(st, policy, str(tmp_path / policy))
        assert spark.read.csv(str(tmp_path / policy), sep=" ", header=True).columns == head.split(" ")
    streams.write_reports(spark.createDataFrame([("merge", 5, 0, 24, 1)], "via string, key long, value long, count long, level int"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value == "Reporting merge: Key: 5 Value: 0 Count: 24 Level: 1"


def test_packets(spark):
    texts = ["packet 4\n17996431805658317590,1,0\n7,0,1\n", "2", "3\n", "3"]
    p = spark.createDataFrame([(t,) for t in texts], "value string")
    assert [(r.packet_id, r.pos, r.key, r.value, r.truth) for r in streams.parse_packets(p).orderBy("pos").collect()] == [(4, 0, 17996431805658317590 - (1 << 64), 1, 0), (4, 1, 7, 0, 1)]
    assert [r.key for r in streams.captured_keys(spark.createDataFrame([("packet 4\n24,1,0\n1,0,1\n",)], "value string")).orderBy("pos").collect()] == [265716376411229, 156106598526498]
    assert streams.stopped_senders(p).first().senders == 2
    two = streams.parse_two_level(spark.createDataFrame([("packet 1\n5,77,1\n5,01,5\n",)], "value string")).orderBy("pos").collect()
    assert [(r.okey, r.val, r.cnt) for r in two] == [(5, "77", 1), (5, "01", 5)]


def test_streaming_equals_batch(spark, tmp_path):
    r = random.Random(6)
    rows = pd.DataFrame([(i, r.randrange(30), r.randrange(2), 1) for i in range(1200)], columns=["idx", "key", "value", "truth"]).astype({"value": "int32", "truth": "int32"})
    os.makedirs(tmp_path / "in")
    for k in range(3):
        part = rows.iloc[400 * k : 400 * (k + 1)].sample(frac=1, random_state=k)
        part.to_parquet(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1000 + k, 1000 + k))
    source = spark.readStream.schema("idx long, key long, value int, truth int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rates = timely.Throughput()
    spark.streams.addListener(rates)
    q = timely.report(source, 24, 12).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(50):
        if rates.series and rates.series[-1][0] == 1200:
            break
        time.sleep(0.2)
    spark.streams.removeListener(rates)
    assert rates.series[-1][0] == 1200
    got = sorted((x.key, x.i0, x.it, x.ones, x.biased) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = spark.createDataFrame(rows)
    want = {x.key: x for x in reports.immediate(batch, 24).collect()}
    ones = {x.key: x.ones for x in bias.classify(batch, 24, 12).collect()}
    assert got == sorted((k, x.i0, x.it, ones[k], ones[k] <= 12) for k, x in want.items()) and got


def test_udp(spark, tmp_path):
    ports = []
    for _ in range(2):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.bind(("127.0.0.1", 0))
            ports.append(s.getsockname()[1])
    folder = str(tmp_path / "packets")
    os.makedirs(folder)
    q = udp.captured(spark, folder).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start()
    sent = streams.to_packets(spark.range(200).select(F.col("id").alias("idx"), F.col("id").alias("key"), F.lit(1).alias("value"), F.lit(0).alias("truth"))).coalesce(1).cache()
    assert sent.count() == 4
    got = []
    t = threading.Thread(target=lambda: got.extend(udp.capture(spark, ports, folder, 8.0, host="127.0.0.1").collect()))
    t.start()
    for _ in range(12):
        time.sleep(0.5)
        udp.send_packets(sent, [f"127.0.0.1@{p}" for p in ports])
    t.join()
    q.processAllAvailable()
    q.stop()
    assert {r.port for r in got} == set(ports) and all(r.packets > 2 for r in got)
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == sum(r.packets for r in got)
    rows = streams.parse_packets(kept.distinct())
    assert rows.count() == 200 and rows.agg(F.sum("key")).first()[0] == sum(range(200))
    with udp.bound_socket("::", 0) as s:  # any address, whether or not there is IPv6
        assert s.getsockname()[1] > 0
