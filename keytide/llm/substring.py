"""Removal of repeated passages by FM-indexes over content-routed shards.

A window is ``window`` consecutive words. Texts are cut where their content says: every window is
assigned to the smallest hash among its runs of ``anchor`` words, and a stretch of windows with one
anchor is a segment. Equal windows have equal anchors, so all that can match a segment lies under
its anchor's hash, and that hash decides its shard; no text is searched in another shard. Segments
whose anchor occurs under one document id only are left out, and equal segments are one.

Each shard sorts the suffixes of its segments (to the depth of a window) and keeps of them the
Burrows-Wheeler transform, as a wavelet matrix of compressed bit vectors. The documents' segments
are streamed through it from right to left, all in step. Backward search gives their matching
statistics: at each place how many words from there on the index has together. Where these reach
the window, the smallest document id among the rows that have them tells from which document on
the window is a repeat.

An anchor with very many different segments (the border of a passage that countless documents
share) is dealt anew by the content of each window, so that no shard is larger for it.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import dropped, in_batches, release_others, texts, whole_ids, written

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 50, 12
#: Words of a shard, about, and different segments of an anchor from which it is dealt by window.
SHARD_WORDS, HEAVY = 500_000, 4096


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def segments(codes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, number of windows) of each segment of a text."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs = len(codes) - anchor + 1
    h = np.zeros(runs, dtype=np.uint64)
    for k in range(anchor):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + runs]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low, at, size, span = h, np.arange(runs), 1, window - anchor + 1
    while size < span:  # the smallest of ``size`` hashes from each place on, the leftmost of equals
        step = min(size, span - size)
        a, b = low[:-step], low[step:]
        left = a <= b
        low, at, size = np.where(left, a, b), np.where(left, at[:-step], at[step:]), size + step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return low[first], first, np.diff(np.append(first, n))


class Bits:
    """A bit vector with ranks, in words of 64 bits of which only those that aren't all alike are kept."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.concatenate([bits.astype(np.uint8), np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
        self.ones = words == ~np.uint64(0)
        mixed = (words != 0) & ~self.ones
        self.kept = words[mixed]
        self.place = np.where(mixed, np.cumsum(mixed) - 1, -1).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        at = self.place[w]
        word = np.where(at >= 0, self.kept[at] if len(self.kept) else np.uint64(0), np.where(self.ones[w], ~np.uint64(0), np.uint64(0)))
        return self.before[w] + np.bitwise_count(word & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)


class WordIndex:
    """Compressed FM-index of a sequence of words, exact for patterns up to ``depth`` words.

    Kept are the bits of a wavelet matrix over the Burrows-Wheeler transform, how many words each
    row shares with the one before (a byte, up to ``depth``), and the smallest owner of each group
    of rows that share ``depth`` words. The suffix array itself is given up.
    """

    def __init__(self, seq: np.ndarray, depth: int, owner: np.ndarray):
        """``seq`` holds numbers from 1 on, and 0 between segments; ``owner`` has a number for each place."""
        n, self.depth = len(seq), depth
        ranks, h = {1: seq.astype(np.int64)}, 1
        while h < depth:
            r = ranks[h].astype(np.int64)
            tail = np.concatenate([r[h:] + 1, np.zeros(min(h, n), np.int64)])[:n]
            ranks[2 * h] = np.unique(r * (int(tail.max()) + 1) + tail, return_inverse=True)[1].astype(np.int32)
            h *= 2
        sa = np.argsort(ranks[h], kind="stable")
        shared = np.zeros(n, dtype=np.int64)  # with the row before, found from the longest blocks down
        alike = np.concatenate([[False], ranks[h][sa[1:]] == ranks[h][sa[:-1]]])
        one, two = sa[1:], sa[:-1]
        step = h // 2
        while step:
            r = ranks[step]
            p, q = one + shared[1:], two + shared[1:]
            inside = (p < n) & (q < n)
            same = inside & (r[np.minimum(p, n - 1)] == r[np.minimum(q, n - 1)])
            shared[1:] += np.where(same, step, 0)
            step //= 2
        self.shared = np.minimum(np.where(alike, depth, shared), depth).astype(np.uint8)
        begins = np.flatnonzero(self.shared < depth)
        self.least = np.minimum.reduceat(owner[sa], begins)
        self.groups, self.shorter = Bits(self.shared < depth), np.flatnonzero(self.shared < depth - 1).astype(np.int32)
        bwt = seq[sa - 1]
        self.n, self.levels = n, max(1, int(seq.max()).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            b = bwt >> level & 1
            self.bits.append(Bits(b))
            self.zeros.append(n - int(b.sum()))
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])
        symbols = np.arange(int(seq.max()) + 1)
        self.smaller = np.searchsorted(np.sort(seq), symbols)
        self.start = self.walk(symbols, np.zeros(len(symbols), np.int64))

    def walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place ``i`` of the transform comes to stand if ``c`` leads down the wavelet matrix."""
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with word ``c`` put before them."""
        at = self.walk(np.concatenate([c, c]), np.concatenate([lo, hi])) - np.concatenate([self.start[c]] * 2) + np.concatenate([self.smaller[c]] * 2)
        return at[: len(c)], at[len(c) :]

    def shortened(self, lo: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows that share so many words with each row ``lo``."""
        out = np.zeros(len(lo), np.int64), np.full(len(lo), self.n, np.int64)
        for d in np.unique(words).tolist():
            if d:
                some = words == d
                begins = self.shorter if d == self.depth - 1 else np.flatnonzero(self.shared < d)
                k = np.searchsorted(begins, lo[some], side="right")
                out[0][some] = begins[k - 1]
                out[1][some] = np.append(begins, self.n)[k]
        return out

    def matches(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of documents that are streamed through the index from right to left, all in step.

        ``words`` has the documents' words one after another, 0 for one that the index doesn't know.
        Of each place: how many words from there on the index has together, up to ``depth``, and where
        that is ``depth`` the smallest owner of a place that has them, else -1. A word is put before
        the match; as long as the index doesn't have that, the match loses its last word.
        """
        ends = np.cumsum(lengths)
        rows = np.flatnonzero(lengths)
        size, owner = np.zeros(len(words), np.uint8), np.full(len(words), -1, np.int64)
        lo, hi, have = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64), np.zeros(len(lengths), np.int64)
        step = 0
        while len(rows):
            at = ends[rows] - 1 - step
            new = rows[words[at] == 0]
            lo[new], hi[new], have[new] = 0, self.n, 0
            full = rows[have[rows] == self.depth]
            have[full] -= 1
            lo[full], hi[full] = self.shortened(lo[full], have[full])
            open_ = rows[words[at] > 0]
            while len(open_):
                a, b = self.extend(words[ends[open_] - 1 - step], lo[open_], hi[open_])
                good = b > a
                done = open_[good]
                lo[done], hi[done] = a[good], b[good]
                have[done] += 1
                open_ = open_[~good & (have[open_] > 0)]  # a known word is somewhere: an empty match always takes it
                have[open_] -= 1
                lo[open_], hi[open_] = self.shortened(lo[open_], have[open_])
            size[at] = have[rows]
            whole = have[rows] == self.depth
            owner[at[whole]] = self.least[self.groups.rank(lo[rows[whole]] + 1) - 1]
            step += 1
            rows = rows[lengths[rows] > step]
        return size, owner


def smallest_owner(lengths: np.ndarray, codes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment and each of its windows the smallest owner of a segment that holds it.

    ``codes`` has the segments' words one after another, ``owner`` one number for each segment.
    """
    _, ids = np.unique(codes, return_inverse=True)
    begin = np.cumsum(lengths + 1) - lengths - 1  # with a 0 after each segment
    seq = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    inside = np.ones(len(seq), dtype=bool)
    inside[begin + lengths] = False
    seq[inside] = ids + 1
    size, low = WordIndex(seq, window, np.repeat(owner, lengths + 1)).matches(ids + 1, lengths)
    ends = np.cumsum(lengths)
    assert (size[np.concatenate([np.arange(e - n, e - window + 1) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)])] == window).all()
    return [low[e - n : e - window + 1] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def stretches(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each stretch of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return first, np.append(first[1:], len(low)) - 1


def repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, heavy: int = HEAVY) -> DataFrame:
    """(id, h, cuts): for each row with repeated windows the word ranges [s, e) that they cover.

    ``h`` is ``xxhash64`` of the text; rows that agree in id and text agree in cuts. A window is
    repeated if its words also stand together in a document with a smaller id. Rows with a null id
    or text neither count nor are cut. Ids must be whole numbers.
    """
    whole_ids(docs, id_col)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    @in_batches
    def cut_up(batch):
        of, seg, first, number, name = [], [], [], [], []
        for k, raw in enumerate(texts(batch.column(2))):
            codes = codes_of(raw.split())
            g, a, c = segments(codes, window, anchor)
            of.append(np.full(len(g), k))
            seg.append(g)
            first.append(a)
            number.append(c)
            data, h = codes.view(np.uint8), xxhash.xxh3_64_intdigest
            name += [h(data[8 * s : 8 * e]) for s, e in zip(a.tolist(), (a + c + window - 1).tolist(), strict=True)]
        of = pa.array(np.concatenate(of))
        return {"g": pa.array(np.concatenate(seg).view(np.int64)), "s": pa.array(np.array(name, dtype=np.uint64).view(np.int64)), "id": batch.column(0).take(of), "h": batch.column(1).take(of), "a": pa.array(np.concatenate(first).astype(np.int32)), "c": pa.array(np.concatenate(number).astype(np.int32))}

    every = written(rows.mapInArrow(cut_up, "g long, s long, id long, h long, a int, c int"))
    shared = written(every.groupBy("g").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("g"))  # a plain join side: a hot anchor can be split
    kept = written(every.join(shared, "g"))
    dropped(every, shared)
    reps = kept.groupBy("g", "s").agg(F.min(F.struct("id", "h", "a", "c")).alias("r")).select("g", "s", "r.*")
    reps = written(reps)
    crowded = reps.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("g", F.lit(True).alias("crowd"))
    marked = reps.join(crowded, "g", "left").groupBy("id", "h").agg(F.collect_list(F.struct("g", "s", "a", "c", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("segs"))

    @partial(in_batches, rows=200)  # a crowded text's windows take much more room than the text
    def fetch(batch):
        out: dict[str, list] = {k: [] for k in ("g", "s", "off", "id", "words", "crowd")}
        for owner, raw, segs in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            w = raw.split()
            for x in segs:
                parts = [(k, window) for k in range(x["c"])] if x["crowd"] else [(0, x["c"] + window - 1)]
                for off, n in parts:
                    for name, v in zip(out, (x["g"], x["s"], off, owner, b" ".join(w[x["a"] + off : x["a"] + off + n]).decode(), x["crowd"]), strict=True):
                        out[name].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        return {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)}

    fetched = written(rows.join(marked, ["id", "h"]).select("id", "text", "segs").mapInArrow(fetch, "g long, s long, off int, id long, words string, crowd boolean"))
    dropped(reps)
    total = fetched.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // (6 * shard_words)))
    # windows of crowded anchors are named by their content and pooled, then dealt by it
    single = fetched.where("crowd").withColumns({"w": F.xxhash64("words"), "w2": F.xxhash64(F.lit(1), "words")})
    pooled = single.groupBy("w", "w2").agg(F.min("id").alias("id"), F.first("words").alias("words")).select(F.col("w").alias("g"), F.col("w2").alias("s"), "id", "words")
    whole = fetched.where("NOT crowd").select("g", "s", "id", "words")
    dealt = [d.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")) for d in (whole, pooled)]

    def search(t):
        words = [x.split() for x in texts(t["words"].combine_chunks())]
        low = smallest_owner(np.array([len(x) for x in words]), codes_of([y for x in words for y in x]), t["id"].to_numpy(), window)
        ends = [stretches(x) for x in low]
        of = pa.array(np.repeat(np.arange(len(low)), [len(a) for a, _ in ends]))
        first, last = (np.concatenate(x) for x in zip(*ends, strict=True))
        values = np.concatenate([x[a] for x, (a, _) in zip(low, ends, strict=True)])
        return pa.table({"g": t["g"].take(of), "s": t["s"].take(of), "p": pa.array(first.astype(np.int32)), "q": pa.array(last.astype(np.int32)), "low": pa.array(values)})

    found = [d.groupBy("shard").applyInArrow(search, "g long, s long, p int, q int, low long") for d in dealt]
    back = single.join(found[1].select(F.col("g").alias("w"), F.col("s").alias("w2"), "low"), ["w", "w2"]).select("g", "s", F.col("off").alias("p"), F.col("off").alias("q"), "low")
    hits = kept.join(found[0].unionByName(back), ["g", "s"]).where(F.col("low") < F.col("id"))
    cuts = written(hits.groupBy("id", "h").agg(F.collect_list(F.struct((F.col("a") + F.col("p")).alias("s"), (F.col("a") + F.col("q") + window).alias("e"))).alias("cuts")))
    dropped(kept, fetched)
    return cuts


def with_cuts(docs: DataFrame, text_col: str, id_col: str, **options) -> DataFrame:
    """(row, id, text, cuts): every row of ``docs`` as a struct, with the word ranges to remove."""
    cuts = repeats(docs, text_col, id_col, **options).withColumnsRenamed({"id": "id2", "h": "h2"})
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(cuts, (F.col("id").cast("long") == F.col("id2")) & (F.xxhash64("text") == F.col("h2")), "left").drop("id2", "h2")


def kept_words(raw: bytes, cuts: list | None) -> tuple[int, list[bytes]]:
    """(number of words, those outside of the cuts)."""
    words = raw.split()
    if not cuts:
        return len(words), words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, [x["s"] for x in cuts], 1)
    np.add.at(change, [x["e"] for x in cuts], -1)
    keep = np.cumsum(change[:-1]) == 0
    return len(words), [words[k] for k in np.flatnonzero(keep).tolist()]


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row of ``docs``; a null text has no words.

    Rows with a null id keep all their words. Repeated rows are cut alike, and a document isn't
    cut for a repeat within itself or under its own id. Only the two named columns are read.
    """
    both = with_cuts(docs.select(id_col, text_col), text_col, id_col, **options).select("id", "text", "cuts")

    @in_batches
    def run(batch):
        n, gone, sha = [], [], []
        for raw, cuts in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            total, words = kept_words(raw, cuts)
            n.append(total)
            gone.append(total - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return {"id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha)}

    kind = dict(both.dtypes)["id"]
    return both.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with repeated passages cut from the text, the words left joined by one space.

    Texts without a repeat stay as they are, spaces included; all columns and rows stay.
    """
    both = with_cuts(docs, text_col, id_col, **options)

    @F.arrow_udf("string")
    def rest(text: pa.Array, cuts: pa.Array) -> pa.Array:
        release_others(__name__)
        left = (None if c.as_py() is None else b" ".join(kept_words(t.as_py(), c.as_py())[1]).decode() for t, c in zip(text.cast(pa.binary()), cuts, strict=True))
        return pa.array(left, pa.string())

    text = F.when(F.col("cuts").isNotNull(), rest("text", "cuts")).otherwise(F.col("text"))
    return both.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
