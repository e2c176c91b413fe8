"""SimHash near-duplicates by fuzzy hashing with the perfect binary Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. The [23,12,7] Golay code
assigns every 23-bit word the one codeword within three bits; decoding a segment and each of its
one-bit neighbours gives at most six codeword indices. Two segments within two bits have a common
neighbour, so they share an index; if they differ in one bit, the index of either is among the
other's.

Four differing bits over three segments leave two cases:

* a segment is equal and another differs in at most two bits: the equal segment with any shared
  index of the other is a common key (six ordered pairs of segments, at most six keys each);
* no segment is equal: two differ in exactly one bit. One side gives (own index, all indices), the
  other (all indices, own index) of these two, so that the sides meet in one key.

Keys of 33 or 24 bits keep chance meetings rare, and every pair that meets is verified. Equal
fingerprints are one node, so a group of copies never becomes pairs, and a bucket passes on a
spanning forest of its links rather than all of them. A key of very many rows is met in pieces.

``keep_one`` works on texts of a Jaccard index of 0.8 and more, whose fingerprints differ in far
more than four bits. Its wide fingerprints are cut into more Golay segments and only propose
candidates; every link is verified on the texts' shingles.
"""

from __future__ import annotations

import functools
import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytide.llm.common import bounded_runs, connected_components, dropped, forest, in_batches, keeps, texts, whole_runs, written

#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
WIDTHS = (22, 21, 21)
#: Differing bits up to which the keys are complete.
MAX_DISTANCE = 4
#: Fingerprints beyond which keys of two indices have some tens of rows each.
CROWDED = 1 << 26
#: Rows of a bucket over which it is searched row by row, not by offsets.
LARGE = 48
#: Rows of a key that are met at once, and rows carried on from piece to piece of a key with more.
HOT, LEADERS = 4096, 64


@functools.cache
def codeword_index() -> np.ndarray:
    """For every 23-bit word the index (its 12 leading bits) of the codeword within three bits."""
    keeps(__name__, codeword_index.cache_clear)
    rest = np.zeros(1 << 23, dtype=np.uint16)  # the remainder by GOLAY, which is linear
    for bit in range(23):
        r = 1 << bit
        for shift in range(bit - 11, -1, -1):
            if r >> (shift + 11) & 1:
                r ^= GOLAY << shift
        rest[1 << bit : 2 << bit] = rest[: 1 << bit] ^ np.uint16(r)
    error = np.zeros(1 << 11, dtype=np.uint32)
    for weight in range(1, 4):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[rest[e]] = e
    for at in range(0, 1 << 23, 1 << 18):  # in place, block by block
        words = np.arange(at, at + (1 << 18), dtype=np.uint32)
        rest[at : at + (1 << 18)] = (words ^ error[rest[at : at + (1 << 18)]]) >> np.uint32(11)
    return rest


def indices(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(own index, all indices with repeats at -1) of each segment value."""
    table = codeword_index()
    near = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)
    all_ = np.sort(table[segment[:, None] ^ near[None, :]].astype(np.int64), axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
    return table[segment].astype(np.int64), all_


def keys(fingerprints: np.ndarray, third: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint; two within four bits have one in common.

    Where one segment is the same, another differs in two bits at most, and where no segment is the same, two
    differ in one bit each and the last in two at most. Segments within two bits share an index among
    all of theirs, within one bit one's own is among the other's. Keys of two indices have 24 bits;
    ``third`` adds those of the last segment to them.
    """
    f = fingerprints.astype(np.uint64)
    cut, shift = [], 0
    for w in WIDTHS:
        cut.append((f >> np.uint64(shift) & np.uint64((1 << w) - 1)).astype(np.int64))
        shift += w
    own, every = zip(*(indices(s, w) for s, w in zip(cut, WIDTHS, strict=True)), strict=True)
    row, key = [], []
    for tag, (i, j) in enumerate(itertools.permutations(range(3), 2)):
        r, c = np.nonzero(every[j] >= 0)
        row.append(r)
        key.append(cut[i][r] << 12 | every[j][r, c] | tag << 40)
    for tag, (i, j) in enumerate(itertools.combinations(range(3), 2), 8):
        k = 3 - i - j
        for mine, flat, low in ((own[i], every[j], False), (own[j], every[i], True)):
            r, c = np.nonzero(flat >= 0)
            two = flat[r, c] << 12 | mine[r] if low else mine[r] << 12 | flat[r, c]
            if third:
                s, d = np.nonzero(every[k][r] >= 0)
                r, two = r[s], two[s] << 12 | every[k][r[s], d]
            row.append(r)
            key.append(two | tag << 40)
    return np.concatenate(row), np.concatenate(key)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def reached(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows within ``most`` bits: each row once, from the row that reached it first."""
    left, i, j = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = apart(fp[left], fp[at]) <= most
            found = left[near]
            i.append(np.full(len(found), at))
            j.append(found)
            queue += found.tolist()
            left = left[~near]
    return (np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, np.int64), np.empty(0, np.int64))


def bucket_links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the nodes that pairs within ``most`` bits and with equal keys join.

    Rows are sorted by key, ``fp`` has a row of 64-bit words each. Every node has one link at most,
    to the smallest that it reaches in this block.
    """
    u, first, at = np.unique(node, return_index=True, return_inverse=True)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    i, j = [at[:0]], [at[:0]]
    for s, n in zip(begin[size > LARGE], size[size > LARGE], strict=True):
        own = np.unique(at[s : s + n])
        p, q = reached(fp[first[own]], most)
        i.append(own[p])
        j.append(own[q])
    small = np.flatnonzero(np.repeat(size <= LARGE, size))
    key, at, fp = key[small], at[small], fp[small]
    for off in range(1, LARGE):
        same = np.flatnonzero(key[off:] == key[:-off])
        if not len(same):
            break
        x, y = at[same], at[same + off]
        good = (x != y) & (apart(fp[same], fp[same + off]) <= most)
        i.append(x[good])
        j.append(y[good])
    label = forest(np.concatenate(i), np.concatenate(j), len(u))
    other = np.flatnonzero(label != np.arange(len(u)))
    return u[other], u[label[other]]


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the lower-cased (A-Z) text's word shingles, repeats included; of all words if fewer; none without."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype="<u8")
    line = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(line, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return np.array([h(line[s:e], seed) for s, e in zip(starts[: len(w) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def majority(h: np.ndarray) -> np.ndarray:
    """64 booleans: the bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones * 2 > len(h)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text's shingles; 0 without words."""
    return int(np.packbits(majority(shingle_hashes(text, words, seed)), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) of every whole text; a null text has none of words."""

    @in_batches
    def run(batch):
        return {id_col: batch.column(0), "fp": pa.array(np.array([fingerprint(x, words, seed) for x in texts(batch.column(1))], dtype=np.uint64).view(np.int64))}

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def meetings(spread: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(a, b): verified links that join all of ``spread`` (key, node, fingerprint columns) with a common key within ``most`` bits.

    A task holds a bounded number of rows. A key with more than ``HOT`` is met piece by piece, with
    ``LEADERS`` rows carried on from the pieces before. If that joins its rows to one component,
    nothing more is to be found; else all rows outside of the key's largest component are
    compared, in blocks, with all of the key's.
    """
    words = [f"f.{c}" for c in columns]

    def fingerprints_of(t):
        return np.stack([t[c].to_numpy() for c in columns], axis=1).view(np.uint64)

    def meet(batches):
        lead = None
        for t, hot in bounded_runs(batches, "key", HOT):
            kind = pa.field("key", t["key"].type)
            if hot and lead is not None and lead["key"][0] == t["key"][0]:
                t = pa.concat_tables([lead, t])
            a, b = bucket_links(t["key"].to_numpy(), t["node"].to_numpy(), fingerprints_of(t), most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), kind.type)], ["a", "b", "hot"])
            if hot:
                new = t.slice(lead.num_rows) if lead is not None and lead["key"][0] == t["key"][0] else t
                for part in new.select(["node", "key"]).to_batches():
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(part.num_rows, pa.int64()), part.column(1)], ["a", "b", "hot"])
                roots = np.flatnonzero(~np.isin(t["node"].to_numpy(), a))[:LEADERS]
                lead = t.take(pa.array(roots)) if len(roots) else t.slice(0, 1)
            else:
                lead = None

    kind = dict(spread.dtypes)["key"]
    met = written(spread.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, f"a long, b long, hot {kind}"))
    found = met.where("b is not null").select("a", "b").distinct()
    hot = met.where("b is null").select(F.col("hot").alias("key"), F.col("a").alias("node"))
    if hot.isEmpty():
        return found
    comps = connected_components(found, "a", "b")
    rows = hot.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("own"))
    prints = spread.select("node", F.struct(*columns).alias("f")).dropDuplicates(["node"])
    rows = written(rows.join(prints, "node").select("key", "node", "own", *words))
    parts = rows.groupBy("key", "own").agg(F.count("*").alias("n"))
    keys_ = parts.groupBy("key").agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("open")).where("open > 0")
    ours = rows.join(keys_, "key").withColumns({"nb": F.ceil(F.col("n") / HOT).cast("int"), "ob": F.ceil(F.col("open") / HOT).cast("int")})
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = ours.withColumn("q", block("nb")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ob") - 1)))
    rest = ours.where("own <> main").withColumn("p", block("ob")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = every.unionByName(rest).select("key", "p", "q", "node", *columns)

    def compare(batches):
        for t in whole_runs(batches, ["key", "p", "q"]):
            cell = np.unique(np.stack([t[c].to_numpy().astype(np.int64) for c in ("key", "p", "q")]), axis=1, return_inverse=True)[1].ravel()
            a, b = bucket_links(cell, t["node"].to_numpy(), fingerprints_of(t), most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return found.unionByName(cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, "a long, b long"))


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that join all of ``distinct.fp`` within ``max_distance`` bits, each verified.

    Over ``crowded`` fingerprints get more keys with fewer rows in each; they find the same.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"the keys are complete up to {MAX_DISTANCE} differing bits")
    third = distinct.count() > crowded

    @in_batches
    def spread(batch):
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = keys(fp.view(np.uint64), third)
        return {"key": pa.array(key), "node": pa.array(fp[row]), "fp": pa.array(fp[row])}

    return meetings(distinct.select("fp").mapInArrow(spread, "key long, node long, fp long"), ["fp"], max_distance)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 4, max_distance: int = MAX_DISTANCE, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id, root) of every row of ``docs``.

    Fingerprints link at ``max_distance`` or fewer differing bits; ``component_id`` is the smallest
    id among the documents reachable over links, itself included; ``root`` is a fingerprint that stands
    for the component. A null or empty text has
    fingerprint zero and links like any other. Repeated rows stay. A null id is never a component's
    name while a named document is in it. Only the two named columns are read.
    """
    fps = written(fingerprints(docs, text_col, id_col, words, seed).withColumnRenamed(id_col, "id"))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    comps = connected_components(links(nodes, max_distance), "a", "b")
    rooted = nodes.join(comps, nodes.fp == comps.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id", "root")
    hexa = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), hexa.alias("fingerprint"), "component_id", "root")


#: Words of 64 bits of a wide fingerprint, its Golay segments of 23 bits, and how far apart segments are paired.
WIDE, SEGMENTS, STEPS = 6, 16, 5
#: Words that meetings compare, and the differing bits up to which these are candidates: at a Jaccard
#: index j two texts differ in a share of acos(2j / (1 + j)) / pi of all bits; this is that for 0.8,
#: 39 of 256, and two and a half standard deviations more.
COMPARED, CANDIDATE_BITS = 4, 53
#: Smallest shingle hashes of a text that tell whether it can have a near copy.
SKETCH = 32
#: Texts and shingles of a block that is verified at once, and texts that are compared with every block of their group.
BLOCK_TEXTS, BLOCK_SHINGLES, PIVOTS = 256, 400_000, 8


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """64-bit words: the SimHash of as many mixes of the shingle hashes."""
    words = []
    for k in range(WIDE):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        words.append(np.packbits(majority(x ^ x >> np.uint64(29)), bitorder="little").view("<u8")[0])
    return np.array(words, dtype=np.uint64)


def wide_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for wide fingerprints: Golay segments of 23 bits, taken two by two.

    A text has (own index, all indices) of two segments and (all, own). Segments within one bit
    always meet and farther ones often.
    """
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), WIDE * 8), axis=1, bitorder="little")
    cut = bits[:, : 23 * SEGMENTS].reshape(len(fp), SEGMENTS, 23).astype(np.int64) @ (1 << np.arange(23))
    own, every = zip(*(indices(cut[:, k], 23) for k in range(SEGMENTS)), strict=True)
    row, key = [], []
    for tag, (i, step) in enumerate(itertools.product(range(SEGMENTS), range(1, STEPS + 1))):
        j = (i + step) % SEGMENTS
        r, c = np.nonzero(every[j] >= 0)
        row.append(r)
        key.append(tag << 24 | own[i][r] << 12 | every[j][r, c])
        r, c = np.nonzero((every[i] >= 0) & (every[i] != own[i][:, None]))
        row.append(r)
        key.append(tag << 24 | every[i][r, c] << 12 | own[j][r])
    return np.concatenate(row), np.concatenate(key).astype(np.int32)


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Whether each two of some sets of distinct numbers have a Jaccard index of ``least`` or more; exact."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    member = np.concatenate(sets)
    of = np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(member, kind="stable")
    member, of = member[order], of[order]
    begin = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
    times = np.diff(np.append(begin, len(member)))
    shared = np.repeat(times > 1, times)
    of, number = of[shared], np.repeat(np.arange((times > 1).sum()), times[times > 1])
    both, step = np.zeros((n, n)), 4096
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + step + 1, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((n, step), dtype=np.float32)
        m[of[a:b], number[a:b] - k * step] = 1
        both += m @ m.T
    np.fill_diagonal(both, size)
    return both / (size[:, None] + size[None, :] - both) >= least


def verified_links(members: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join all of the texts of a group whose sets have a Jaccard index of ``least`` or more.

    ``members`` has (component, node, n, s): a group of candidates, a text, its number of shingles
    and their hashes. Small groups are one block each. A large one is dealt into blocks; each is
    verified within itself and against a few texts of the group. What then isn't in the group's
    largest class is compared with every block of the group. Every pair of a group is thus
    verified or already joined.
    """
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    rows = members.join(sizes, "component").withColumn("q", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    top = W.partitionBy("component").orderBy("node")
    pivots = rows.where("blocks > 1").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= PIVOTS).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.withColumn("p", F.lit(0)).unionByName(pivots.drop("rank").withColumn("p", F.lit(0)))

    def check(batches):
        for t in whole_runs(batches, ["component", "p", "q"]):
            comp, p, q = (t[c].to_numpy() for c in ("component", "p", "q"))
            new = np.flatnonzero((comp[1:] != comp[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            node, i, j = t["node"].to_numpy(), [], []
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(node)], strict=True):
                a, b = np.nonzero(similar([np.frombuffer(x, "<u8") for x in t["s"].slice(s, e - s).to_pylist()], least))
                i.append(a[a < b] + s)
                j.append(b[a < b] + s)
            u, at = np.unique(node, return_inverse=True)
            label = forest(at[np.concatenate(i)], at[np.concatenate(j)], len(u))
            other = np.flatnonzero(label != np.arange(len(u)))
            yield pa.RecordBatch.from_arrays([pa.array(u[other]), pa.array(u[label[other]])], ["a", "b"])

    def checked(cells):
        return cells.select("component", "p", "q", "node", "s").repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").mapInArrow(check, "a long, b long")

    first = written(checked(cells))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return first
    joined = connected_components(first, "a", "b").withColumnRenamed("component", "class")
    large = written(large.join(joined, "node", "left").withColumn("class", F.coalesce("class", "node")))
    parts = large.groupBy("component", "class").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    main = parts.groupBy("component").agg(F.max_by("class", F.struct("m", "class")).alias("main"))
    open_ = parts.join(main, "component").where("class <> main").groupBy("component", "main").agg(F.greatest(F.ceil(F.sum("m") / BLOCK_TEXTS), F.ceil(F.sum("w") / BLOCK_SHINGLES)).cast("int").alias("ob"))
    large = large.join(open_, "component")
    every = large.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ob") - 1)))
    rest = large.where("class <> main").withColumn("p", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("ob")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return first.unionByName(checked(every.select("component", "p", "q", "node", "s").unionByName(rest.select("component", "p", "q", "node", "s"))))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near copies: the one with the smallest id, of several texts under it
    the one whose hash is smallest, of repeated rows the first in order of their JSON.

    Two texts link if the Jaccard index of their distinct ``words``-word shingles (A-Z lower-cased)
    is ``similarity`` or more, which is verified for every link; groups are what links join. Which
    pairs are verified comes from the texts' SimHash by Golay keys: a pair right at 0.8 becomes a
    candidate with a chance of 0.98, farther copies hardly ever fail to. Texts with equal sets of
    shingles are one; null and empty texts are copies of each other. All columns stay; a null id
    never comes before others.

    Keys are given only to texts that can have a near copy: each shingle of a near copy is in
    another text with a chance of at least ``similarity``, so of a text's ``SKETCH`` smallest hashes
    less than half are shared with a chance of 1 in 10^4 at most, at 0.8. A text so
    short that no near copy of it has more shingles than that is judged by all of them, which is exact.
    """
    cols = [f"w{k}" for k in range(WIDE)]
    compared = cols[:COMPARED]

    def shingles(raw):
        return np.unique(shingle_hashes(raw, words))

    @in_batches
    def hashed(batch):
        sets = [shingles(raw) for raw in texts(batch.column(2))]
        node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        low = [s[:SKETCH].view(np.int64) for s in sets]
        return {"id": batch.column(0), "h": batch.column(1), "node": pa.array(node), "n": pa.array([len(s) for s in sets], pa.int32()), "low": pa.array(low, pa.list_(pa.int64()))}

    @in_batches
    def printed(batch):
        sets = [shingles(raw) for raw in texts(batch.column(1))]
        w = np.array([wide_fingerprint(s) for s in sets]).view(np.int64).reshape(-1, len(cols))
        return {"node": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int32()), "s": pa.array([s.tobytes() for s in sets], pa.binary()), **{c: pa.array(w[:, k]) for k, c in enumerate(cols)}}

    @partial(in_batches, rows=256)
    def spread(batch):
        row, key = wide_keys(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).view(np.uint64))
        at = pa.array(row)
        return {"key": pa.array(key), "node": batch.column(0).take(at), **{c: batch.column(c).take(at) for c in compared}}

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    prints = written(rows.mapInArrow(hashed, f"id {kind}, h long, node long, n int, low array<long>"))
    nodes = written(prints.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep"), F.first("n").alias("n"), F.first("low").alias("low")))
    least = nodes.select("node", F.explode("low").alias("x"))
    common = written(least.groupBy("x").agg(F.count("*").alias("times")).where("times > 1").select("x"))
    need = F.when(F.col("n") <= SKETCH * similarity, F.ceil(F.col("n") * similarity - 1e-9)).otherwise(SKETCH // 2)
    able = least.join(common, "x").groupBy("node").agg(F.count("*").alias("has")).join(nodes.select("node", "n", "rep"), "node").where(F.col("has") >= need)
    able = able.select("node", F.col("rep.id").alias("rid"), F.col("rep.h").alias("rh"))
    source = rows.join(able, F.col("id").eqNullSafe(F.col("rid")) & (F.col("h") == F.col("rh"))).select("node", "text")
    longs = ", ".join(f"{c} long" for c in cols)
    busy = written(source.mapInArrow(printed, f"node long, n int, s binary, {longs}").dropDuplicates(["node"]))
    met = meetings(busy.select("node", *cols).mapInArrow(spread, "key int, node long, " + ", ".join(f"{c} long" for c in compared)), compared, CANDIDATE_BITS)
    members = written(busy.select("node", "n", "s").join(connected_components(met, "a", "b"), "node"))
    dropped(busy, common)
    links_ = written(verified_links(members, similarity))
    comps = connected_components(links_, "a", "b")
    dropped(members, links_)
    rooted = nodes.select("node", "rep").join(comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct("rep.none", "rep.id")).alias("best"))
    named = rooted.join(best, "root").where(F.col("rep.id").eqNullSafe(F.col("best.id"))).select("root", "node", F.col("best.id").alias("lowest"))
    winner = prints.join(named, "node").where(F.col("id").eqNullSafe(F.col("lowest"))).groupBy("root", "id", "h").agg(F.count("*").alias("times"))
    winner = written(winner.groupBy("root").agg(F.min(F.struct("h", "id", "times")).alias("w")).select(F.col("w.id").alias("id2"), F.col("w.h").alias("h2"), "w.times"))
    dropped(prints, nodes)
    all_ = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"))
    kept = all_.join(winner, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    again = kept.where("times > 1").groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    kept = kept.where("times = 1").select("row").unionByName(again.select("row"))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
