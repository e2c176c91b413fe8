"""Readers and writers of key streams, packets, lifetime logs, reports and count tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keytide.functions.hashing import fold, from_unsigned, murmur64a, numpy_udf
from keytide.sources import stored


def from_table(df: DataFrame, idx: str, key: str, value=None, truth=None) -> DataFrame:
    """A stream (idx, key, value, truth) from a table with a dense order column."""
    return df.select(F.col(idx).cast("long").alias("idx"), F.col(key).cast("long").alias("key"), (F.lit(0) if value is None else value).cast("int").alias("value"), (F.lit(0) if truth is None else truth).cast("int").alias("truth"))


def read_binary_keys(spark: SparkSession, path: str, chunk_keys: int = stored.PARTITION_KEYS) -> DataFrame:
    """(idx, key) of little-endian unsigned 64-bit keys in a file, or in a folder's files by name; idx is the place.

    Only names and sizes are looked up before tasks read their stretches of ``chunk_keys`` keys. Bytes at a
    file's end that make no key are left out.
    """
    stored.register(spark)
    return spark.read.format("keys").option("partition_keys", chunk_keys).load(path)


def stream_binary_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the keys in files that appear in ``folder``, which can be read again from any offset."""
    stored.register(spark)
    return spark.readStream.format("keys").load(folder)


def write_binary_keys(keys: DataFrame, folder: str) -> None:
    """Keys (idx, key) in order of idx as files of little-endian unsigned 64-bit keys, for ``read_binary_keys``.

    ``folder`` is one that all executors share. Each task writes one file and gives it its name when it is complete.
    """

    def write(batches):
        fs, inner = stored.place(folder)
        n, out = 0, f"{inner}/.{uuid.uuid4().hex}"
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(out) as f:
            for pdf in batches:
                f.write(pdf["key"].to_numpy(dtype="<i8").tobytes())
                n += len(pdf)
        fs.move(out, f"{inner}/keys-{TaskContext.get().partitionId():06d}")
        yield pd.DataFrame({"n": [n]})

    keys.select("idx", "key").repartitionByRange("idx").sortWithinPartitions("idx").mapInPandas(write, "n long").agg(F.sum("n")).first()


def read_text_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key) of white-space separated unsigned decimal keys; values over 2^63 keep their bit pattern."""
    word = F.explode(F.split(F.trim("value"), r"\s+"))
    return spark.read.text(path).select(word.alias("w")).where("w <> ''").select(from_unsigned(F.col("w")).alias("key"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_lifetimes(spark: SparkSession, path: str) -> DataFrame:
    """(key, i0, it) of a space-separated log; only keys whose T-th row came after the first."""
    return spark.read.csv(path, sep=" ", schema="key long, i0 long, it long").where("i0 < it")


def parse_packets(packets: DataFrame) -> DataFrame:
    """(packet_id, pos, key, value, truth) of packets in column ``value``: a head line, then ``key,value,truth`` lines.

    A STOP packet (shorter than 8 characters, a sender's number) has no data and gives no rows.
    """
    lines = packets.where(F.length(F.trim("value")) >= 8).select(F.split("value", "\n").alias("l"))
    head = F.regexp_extract(F.col("l")[0], r"packet\s+(\d+)", 1).cast("long")
    rows = lines.select(head.alias("packet_id"), F.posexplode(F.slice("l", 2, 1 << 30)).alias("pos", "line")).where("line <> ''")
    part = F.split("line", ",")
    return rows.select("packet_id", "pos", from_unsigned(part[0]).alias("key"), part[1].cast("int").alias("value"), part[2].cast("int").alias("truth"))


def parse_two_level(packets: DataFrame) -> DataFrame:
    """(packet_id, pos, okey, val, cnt) of two-level packets; ``val`` stays text."""
    lines = packets.where(F.length(F.trim("value")) >= 8).select(F.split("value", "\n").alias("l"))
    head = F.regexp_extract(F.col("l")[0], r"packet\s+(\d+)", 1).cast("long")
    rows = lines.select(head.alias("packet_id"), F.posexplode(F.slice("l", 2, 1 << 30)).alias("pos", "line")).where("line <> ''")
    part = F.split("line", ",")
    return rows.select("packet_id", "pos", part[0].cast("long").alias("okey"), part[1].alias("val"), part[2].cast("int").alias("cnt"))


def to_packets(stream: DataFrame, per_packet: int = 50, sender: int = 0, senders: int = 1) -> DataFrame:
    """(packet_id, value): the stream's rows as packet texts, ``per_packet`` to each.

    Several senders number their packets in turns: the i-th of a sender is i * senders + sender.
    """
    line = F.concat_ws(",", F.col("key").cast("string"), F.col("value").cast("string"), F.col("truth").cast("string"))
    rows = stream.select((F.floor(F.col("idx") / per_packet) * senders + sender).alias("packet_id"), F.struct("idx", line.alias("line")).alias("x"))
    lines = F.array_join(F.transform(F.array_sort("x"), lambda x: x["line"]), "\n")
    packed = rows.groupBy("packet_id").agg(F.collect_list("x").alias("x"))
    return packed.select("packet_id", F.concat(F.lit("packet "), F.col("packet_id").cast("string"), F.lit("\n"), lines, F.lit("\n")).alias("value"))


def captured_keys(packets: DataFrame) -> DataFrame:
    """(packet_id, pos, key): the keys of captured packets, hashed and folded to 48 bits for storing."""
    hashed = numpy_udf(murmur64a)
    return parse_packets(packets).select("packet_id", "pos", fold(hashed("key")).alias("key"))


def capture_keys(packets: DataFrame, folder: str, per_packet: int = 50) -> None:
    """The hashed keys of captured packets, in order of packet and place, as a binary key file set."""
    write_binary_keys(captured_keys(packets).select((F.col("packet_id") * per_packet + F.col("pos")).alias("idx"), "key"), folder)


def stops(packets: DataFrame) -> DataFrame:
    """(sender) of each STOP packet."""
    bare = packets.select(F.regexp_replace("value", r"\s+", "").alias("sender"))
    return bare.where((F.length("sender") < 8) & F.col("sender").rlike("^[0-9]+$"))


def stopped_senders(packets: DataFrame) -> DataFrame:
    """(senders): how many different senders have sent STOP; the run ends when all have."""
    return stops(packets).agg(F.countDistinct("sender").alias("senders"))


def packets_by_sender(packets: DataFrame, senders: int) -> DataFrame:
    """(sender, packets): packet numbers tell the sender modulo their count."""
    return packets.groupBy(F.pmod("packet_id", F.lit(senders)).alias("sender")).agg(F.countDistinct("packet_id").alias("packets"))


def report_lines(reports: DataFrame) -> DataFrame:
    """(value): reports (via, key, value, count, level) as log lines."""
    return reports.select(F.format_string("Reporting %s: Key: %d Value: %d Count: %d Level: %d", "via", "key", "value", "count", "level").alias("value"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as log lines, added to what is there."""
    report_lines(reports).write.mode("append").text(path)


def stream_reports(reports: DataFrame, path: str) -> DataStreamWriter:
    """A writer of a stream of reports as log lines, each batch once; ``stored.read_report_log`` reads them."""
    stored.register(reports.sparkSession)
    return report_lines(reports).writeStream.format("report_log").option("path", path)


#: Fixed column names of the validation dumps, by policy.
DUMPS = {
    "time": "Key Index-0 Index-T Lifetime ReportIndex CountStretch TimeStretch",
    "immediate": "key odp Index-0 Index-T Lifetime Report_Index",
    "count": "Key Index-0 Index-T Lifetime ReportCount CountStretch TimeStretch",
}


def write_validation(stretched: DataFrame, policy: str, path: str) -> None:
    """The stretches of reports as a space-separated file set with the policy's head line."""
    cols = {
        "time": ["key", "i0", "it", "lifetime", "report_idx", "count_stretch", "time_stretch"],
        "immediate": ["key", F.lit(1), "i0", "it", "lifetime", "report_idx"],
        "count": ["key", "i0", "it", "lifetime", "report_count", "count_stretch", "time_stretch"],
    }[policy]
    stretched.select(*cols).toDF(*DUMPS[policy].split(" ")).write.mode("overwrite").option("header", True).csv(path, sep=" ")


def save_counts(counts: DataFrame, path: str, key: str = "key") -> None:
    """A count table as Parquet, clustered by key so that readers skip row groups on a key filter."""
    counts.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
