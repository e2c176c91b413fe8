"""Packing of token sequences by minimum bin slack.

Texts longer than a window are cut into full windows and a rest. The rests of a block of texts are
then packed one window at a time: the longest waiting rest opens the window, and a subset-sum
dynamic programme over a bitset of reachable fills, one shift and one or for each waiting rest,
picks the set that comes closest to the capacity; stepping back through the stored bitsets tells
how many rests of each length it takes. A window that no set fills is topped up by cutting one more
rest, so that only the last window of a block can stay short, and that one is cut into powers of
two, which need no padding.

Blocks are runs of rows of one input partition, bounded in tokens, so packing needs no shuffle and
its memory does not depend on the table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm import bpe
from keytide.llm.common import pieces, release_others, texts

#: Tokens whose rests are packed together.
BLOCK_TOKENS = 1 << 20
#: Texts that are encoded together.
TOGETHER = 500


def best_fill(waiting: dict[int, int], room: int) -> dict[int, int]:
    """How many rests of each length bring the fill closest to ``room`` without passing it.

    ``waiting`` has the number of rests of each length. Longer ones go first and the programme
    ends once ``room`` itself is reached, so long rests, which are harder to place, are preferred.
    """
    keep, mask = [], (1 << (room + 1)) - 1
    reach = 1
    for length in sorted((x for x in waiting if x <= room), reverse=True):
        for _ in range(min(waiting[length], room // length)):
            keep.append((length, reach))
            grown = (reach | reach << length) & mask
            if grown == reach:
                keep.pop()
                break
            reach = grown
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, before in reversed(keep):
        if not before >> at & 1:
            chosen[length] += 1
            at -= length
    return chosen


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(text, start, length, window, offset) of the pieces; windows are numbered from 0.

    Every token lies in one piece, a window's pieces lie one after another from 0, and a window
    holds ``capacity`` tokens or a power of two.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length: (text, start)
    window = 0
    for k, n in enumerate(lengths):
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            pieces.append((k, start, capacity, window, 0))
            window += 1
        if n > whole:
            waiting[n - whole].append((k, whole))
    left = sum(n * len(x) for n, x in waiting.items())

    def take(length: int) -> tuple[int, int]:
        got = waiting[length].pop()
        if not waiting[length]:
            del waiting[length]
        return got

    while left >= capacity:
        longest = max(waiting)
        k, start = take(longest)
        pieces.append((k, start, longest, window, 0))
        at = longest
        for length, times in sorted(best_fill({n: len(x) for n, x in waiting.items()}, capacity - at).items(), reverse=True):
            for _ in range(times):
                k, start = take(length)
                pieces.append((k, start, length, window, at))
                at += length
        if at < capacity:  # nothing fits the slack: cut the shortest rest that covers it
            slack = capacity - at
            length = min(n for n in waiting if n > slack)
            k, start = take(length)
            pieces.append((k, start, slack, window, at))
            waiting[length - slack].append((k, start + slack))
        left -= capacity
        window += 1
    tail = [(k, start, n) for n in sorted(waiting, reverse=True) for k, start in waiting[n]]
    total = sum(n for _, _, n in tail)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    at = 0
    for k, start, n in tail:
        while n:
            part = min(n, sizes[0] - at)
            pieces.append((k, start, part, window, at))
            start, n, at = start + part, n - part, at + part
            if at == sizes[0]:
                sizes.pop(0)
                window, at = window + 1, 0
    return pieces


def pack_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, capacity: int = 2048, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False, kept: float = 1.0) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each text is encoded by the tokenizer of ``path`` and closed with ``end_id``; a null or empty
    text is that one id. A repeated or null id is packed row by row like any other; other columns
    of ``docs`` aren't read. ``sequence_id`` is unique: the input partition and a running number.
    ``kept`` is the share of the tokenizer's caches to use, less for less memory in a worker.
    ``capacity`` must be a power of two. A table without rows gives no pieces.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = path or bpe.default_path()
    end = end_id.to_bytes(4, "little")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        release_others(bpe.__name__)
        m = bpe.model(path, kept)
        made = TaskContext.get().partitionId() << 32
        ids: list = []
        packed: list[bytes] = []
        held = 0

        def flush():
            nonlocal made, held
            lengths = [len(x) // 4 for x in packed]
            rows = pack(lengths, capacity)
            at = [np.fromiter((r[c] for r in rows), dtype=np.int64, count=len(rows)) for c in range(5)]
            cols = [
                pa.array([ids[r[0]] for r in rows], id_kind),
                pa.array(at[1]),
                pa.array(at[2]),
                pa.array([zlib.crc32(packed[k][4 * s : 4 * (s + n)]) for k, s, n, _, _ in rows], pa.int64()),
                pa.array([lengths[r[0]] for r in rows], pa.int64()),
                pa.array(at[3] + made),
                pa.array(at[4]),
            ]
            if with_ids:
                cols.append(pa.array([np.frombuffer(packed[k][4 * s : 4 * (s + n)], "<u4").astype(np.int32) for k, s, n, _, _ in rows], pa.list_(pa.int32())))
            made += (max(r[3] for r in rows) + 1) if rows else 0
            ids.clear(), packed.clear()
            held = 0
            return pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

        for batch in (part for b in batches for part in pieces(b, TOGETHER)):
            id_kind = batch.column(0).type
            encoded = m.packed_all(raw.decode() for raw in texts(batch.column(1)))
            for i, code in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids.append(i)
                packed.append(code + end)
                held += len(packed[-1]) // 4
                if held >= block_tokens:
                    yield flush()
        if packed:
            yield flush()

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
