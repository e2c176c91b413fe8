"""UDP packets: captured by executors into a shared folder, streamed from it, and sent.

UDP can't be read again, so packets are first written down. Each port is received by one task,
which writes a file every so often; a stream of these files is then replayable, and nothing goes
through the driver.
"""

from __future__ import annotations

import os
import socket
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Separates packets in a captured file.
BETWEEN = "\0"


def bound_socket(host: str, port: int) -> socket.socket:
    """A datagram socket on a port; "::" stands for any address, of IPv4 on a machine without IPv6."""
    ways = [(socket.AF_INET6, "::"), (socket.AF_INET, "0.0.0.0")] if host == "::" else [(socket.AF_INET6 if ":" in host else socket.AF_INET, host)]
    for k, (kind, name) in enumerate(ways):
        try:
            s = socket.socket(kind, socket.SOCK_DGRAM)
            s.bind((name, port))
            return s
        except OSError:
            if k == len(ways) - 1:
                raise
    raise ValueError(host)


def capture(spark: SparkSession, ports: list[int], folder: str, seconds: float, host: str = "::", roll_seconds: float = 1.0) -> DataFrame:
    """(port, packets): receives on each port for so long and writes what comes to ``folder``, which all executors share.

    One task for each port. A file appears under its name only when it is complete. A task that
    runs again goes on receiving; what the first attempt has written stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for port in (ports[k] for k in pdf["id"].tolist()):
                n, until = 0, time.monotonic() + seconds
                with bound_socket(host, port) as s:
                    while (now := time.monotonic()) < until:
                        got, turn = [], min(until, now + roll_seconds)
                        while (left := turn - time.monotonic()) > 0:
                            s.settimeout(left)
                            try:
                                got.append(s.recv(1 << 16).decode("ascii", "replace"))
                            except (TimeoutError, BlockingIOError):
                                break
                        if got:
                            os.makedirs(folder, exist_ok=True)
                            name = f"{port}-{time.time_ns()}-{uuid.uuid4().hex}"
                            with open(f"{folder}/.{name}", "w") as f:
                                f.write(BETWEEN.join(got))
                            os.replace(f"{folder}/.{name}", f"{folder}/{name}")
                            n += len(got)
                yield pd.DataFrame({"port": [port], "packets": [n]})

    return spark.range(0, len(ports), 1, len(ports)).mapInPandas(run, "port int, packets long")


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the packets (value) that ``capture`` writes to ``folder``."""
    return spark.readStream.option("lineSep", BETWEEN).text(folder)


def send_packets(packets: DataFrame, peers: list[str]) -> None:
    """Sends the rows of column ``value`` to peers ``host@port`` (port 55555 if not given) in turn.

    Each task sends its own rows; usable as ``foreachBatch`` of a stream.
    """
    where = [(h, int(p or 55555)) for h, _, p in (x.partition("@") for x in peers)]

    def send(rows):
        open_: dict = {}
        for i, row in enumerate(rows):
            host, port = where[i % len(where)]
            kind = socket.AF_INET6 if ":" in host else socket.AF_INET
            if kind not in open_:
                open_[kind] = socket.socket(kind, socket.SOCK_DGRAM)
            open_[kind].sendto(row["value"].encode(), (host, port))

    packets.select("value").foreachPartition(send)
