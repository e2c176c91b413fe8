"""Language-model scoring with a log-frequency Bloom filter.

The model is an interpolated bigram model, in which single tokens have the weight of new pairs among
all that were trained on, d / (n + d) for d different of n. Its pair counts are quantised to steps of a logarithm,
and a pair with step q is stored in a Bloom filter as the entries (pair, 1) .. (pair, q). A count
is read by probing for step 1, 2, 3, .. until an entry is missing, and taken to be the smallest of
its last step. So the stored counts of a context's followers never add up to more than the context's
own, and with single tokens' shares, which add up to one with one unknown word, neither do the
probabilities; only a false positive of the filter (one pair in 2000) adds to them.

Every pair of the training texts is in the filter, however rare. Counts of words and pairs meet by hash in
shards of about one size, as many as the corpus asks for; there the pairs' steps go into the shard's
filter and their counts are given up, and words keep exact counts. Where the model is sure to be small, it is
learnt first, broadcast and used where the texts are. Else texts are dealt into chunks, and a chunk sends each
shard its distinct words and pairs there once, with their counts in its training texts: the shard learns from
these of all chunks, and then tells each the counts of its words and the steps of its pairs, in the order
sent. So every code is sent once, for both. What is sent grows with the tokens, and neither words nor
pairs reach the driver but in a broadcast model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import in_batches, pieces, release_others, texts

#: Base of the quantisation.
BASE = 1.25
#: Bits of the filter for each entry, and hash functions.
ENTRY_BITS, HASHES = 16, 7
#: Tokens of a chunk of texts, and training tokens for each shard of the model, about.
CHUNK_TOKENS = 2_000_000
#: Bytes of a model up to which it is broadcast, and those that a training token takes at most: a word's code and count, a filter's entry.
BROADCAST_BYTES, TOKEN_BYTES = 8 << 20, 8 + 8 + ENTRY_BITS // 8
#: Codes that probe a filter at a time, which bounds a worker's memory.
PROBED = 1 << 18
#: Bits of the codes of words and pairs.
CODE_BITS = {"w": 64, "p": 56}
#: Codes beside the words' hashes: the end and the begin of a text.
END, BEGIN = 1, 2
#: Salt of a pair's code.
PAIR = 0xC2B2AE3D27D4EB4F


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of hashes with a salt."""
    x = (x ^ np.uint64(salt & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def pair_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Codes of 56 bits: of 10^12 pairs one in 10^5 shares another's, far less than the filter's false positives."""
    return mixed(first * np.uint64(0x9FB21C651E98DF25) + second, PAIR) >> np.uint64(8)


#: Numbers whose bits are unpacked at a time.
BLOCK = 1 << 16


def low_bits(top: int, n: int) -> int:
    """How many bits of ``n`` numbers up to ``top`` are kept as they are; the others tell about one number from the next."""
    return max(0, (top // n).bit_length() - 1)


def packed(x: np.ndarray, top: int) -> bytes:
    """Increasing numbers up to ``top`` in two bits more than their mean gap takes, about.

    Bit high + place is set for each number's high bits and its place, then all low bits follow.
    """
    n = len(x)
    if not n:
        return b""
    low = low_bits(top, n)
    high = np.zeros((top >> low) + n, dtype=bool)
    high[(x >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
    out = [n.to_bytes(8, "little"), np.packbits(high).tobytes()]
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(x[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :low]).tobytes())
    return b"".join(out)


def unpacked(sent: bytes, top: int) -> np.ndarray:
    """The numbers of ``packed``."""
    if not sent:
        return np.empty(0, dtype="<u8")
    n = int.from_bytes(sent[:8], "little")
    low = low_bits(top, n)
    size = (top >> low) + n
    got = np.frombuffer(sent, np.uint8, offset=8)
    x = (np.flatnonzero(np.unpackbits(got, count=size)) - np.arange(n)).astype("<u8") << np.uint64(low)
    got = got[-(-size // 8) :]
    for at in range(0, n, BLOCK):
        some = min(BLOCK, n - at)
        bits = np.zeros((some, 64), dtype=np.uint8)
        bits[:, :low] = np.unpackbits(got[at * low // 8 :], count=some * low).reshape(some, low)
        x[at : at + some] |= np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return x


def squeezed(x: np.ndarray) -> bytes:
    """Numbers that are small mostly: all first bytes, all second bytes and so on, compressed."""
    return pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def unsqueezed(sent: bytes, n: int, kind: str) -> np.ndarray:
    """The ``n`` numbers of ``squeezed``."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(sent, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).ravel() if n else np.empty(0, kind)


def word_codes(raw: bytes) -> np.ndarray:
    """Codes of a text's lower-cased words, then of its end."""
    words = raw.lower().split()
    codes = np.empty(len(words) + 1, dtype=np.uint64)
    codes[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    codes[:-1][codes[:-1] <= BEGIN] += np.uint64(3)
    codes[-1] = END
    return codes


def batch_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts of a batch one after another, number of each)."""
    parts = [word_codes(x) for x in texts(column)]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(x) for x in parts], dtype=np.int64)


def before(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The code before each; BEGIN at the start of a text."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = BEGIN
    return out


class LogFrequencyFilter:
    """Quantised counts behind Bloom filter probes."""

    def __init__(self, words: np.ndarray, least: float, base: float = BASE):
        self.words, self.least, self.base = words, least, base
        self.bits = np.uint64(len(words) * 64)

    @staticmethod
    def places(code: np.ndarray, step: np.ndarray | int, bits: int | np.uint64) -> np.ndarray:
        """Bit positions of the entries (code, step), one row for each hash function."""
        a = mixed(code + np.asarray(step).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), 0x51)
        b = mixed(a, 0x52) | np.uint64(1)
        return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(HASHES)])

    @staticmethod
    def steps(count: np.ndarray, least: float, base: float) -> np.ndarray:
        return 1 + np.floor(np.log(np.maximum(count / least, 1.0)) / np.log(base) + 1e-9).astype(np.int64)

    @classmethod
    def of(cls, code: np.ndarray, count: np.ndarray, least: float = 1.0, base: float = BASE, entry_bits: int = ENTRY_BITS) -> LogFrequencyFilter:
        """The filter of distinct codes with their counts, in one block."""
        q = cls.steps(count, least, base)
        size = max(1, -(-int(q.sum()) * entry_bits // 64))
        bits = np.zeros(size * 64, dtype=bool)
        step = 1
        while len(q):
            bits[cls.places(code, step, size * 64)] = True
            code, q, step = code[q > step], q[q > step], step + 1
        return cls(np.packbits(bits, bitorder="little").view("<u8"), least, base)

    @staticmethod
    def least_count(step: np.ndarray, least: float = 1.0, base: float = BASE) -> np.ndarray:
        """The smallest whole count of a step, which no count stored as it is below; 0 without one."""
        return np.where(step > 0, np.ceil(least * base ** (step - 1.0) - 1e-9), 0.0)

    def count(self, code: np.ndarray) -> np.ndarray:
        """Counts by repeated probes: the smallest of the last step found, 0 without any."""
        return self.least_count(self.found(code), self.least, self.base)

    def found(self, code: np.ndarray) -> np.ndarray:
        """The last step found of each code, 0 without any."""
        if len(code) > PROBED:
            return np.concatenate([self.found(code[at : at + PROBED]) for at in range(0, len(code), PROBED)])
        step = np.zeros(len(code), dtype=np.int64)
        alive = np.arange(len(code))
        while len(alive):
            at = self.places(code[alive], int(step[alive[0]]) + 1, self.bits)
            found = np.ones(len(alive), dtype=bool)
            for row in at:
                found &= (self.words[(row >> np.uint64(6)).astype(np.int64)] >> (row & np.uint64(63)) & np.uint64(1)).astype(bool)
            alive = alive[found]
            step[alive] += 1
        return step


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def by_shard(codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes ordered by shard and code, place of each of ``codes`` among them, begin of each shard and the end)."""
    unique, at = np.unique(codes, return_inverse=True)
    shard = (unique % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return unique[order], place[at], np.searchsorted(shard[order], np.arange(shards + 1))


def token_totals(rows: DataFrame) -> tuple[int, int]:
    """(tokens of training texts, tokens of all texts) of ``rows`` (held, text), ends of texts included."""

    @in_batches
    def run(batch):
        n = np.array([len(x.split()) + 1 for x in texts(batch.column(1))], dtype=np.int64)
        return {"n": pa.array([int(n[~batch.column(0).to_numpy(zero_copy_only=False)].sum())]), "every": pa.array([int(n.sum())])}

    zero = F.lit(0)
    return tuple(rows.select("held", "text").mapInArrow(run, "n long, every long").agg(F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("every"), zero)).first())


#: A chunk's message to a shard: its distinct words and pairs there, and how often each stands in training texts.
MESSAGE = "w binary, w_n binary, p binary, p_n binary"


def messages(words: tuple, pairs: tuple, trains: np.ndarray, shards: int) -> dict[str, list[bytes]]:
    """Columns of a message for each shard, from words and pairs as by ``by_shard``; ``trains`` tells which tokens count."""
    out = {}
    for name, (unique, at, begin) in (("w", words), ("p", pairs)):
        n = np.bincount(at[trains], minlength=len(unique)).astype("<u4")
        cuts = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
        top = ((1 << CODE_BITS[name]) - 1) // shards
        out[name] = [packed(unique[s:e] // np.uint64(shards), top) for s, e in cuts]
        out[f"{name}_n"] = [squeezed(n[s:e]) for s, e in cuts]
    return out


def received(t: pa.Table, name: str, shard: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all messages to a shard one after another, their counts in training texts, and where each message ends."""
    top = ((1 << CODE_BITS[name]) - 1) // shards
    codes = [unpacked(x, top) for x in t[name].to_pylist()]
    counts = [unsqueezed(x, len(c), "<u4") for x, c in zip(t[f"{name}_n"].to_pylist(), codes, strict=True)]
    return np.concatenate(codes) * np.uint64(shards) + np.uint64(shard), np.concatenate(counts).astype(np.int64), np.cumsum([len(c) for c in codes])


def total(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes that stand in training texts, in order, and how often."""
    unique, at = np.unique(codes[counts > 0], return_inverse=True)
    out = np.zeros(len(unique), dtype=np.int64)
    np.add.at(out, at, counts[counts > 0])
    return unique, out


def known(w: np.ndarray, c: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Counts of ``words`` by codes in order and their counts, 0 where there are none."""
    if not len(w):
        return np.zeros(len(words), dtype="<i8")
    at = np.minimum(np.searchsorted(w, words), len(w) - 1)
    return np.where(w[at] == words, c[at], 0).astype("<i8")


def coded(column: pa.ChunkedArray | pa.Array, shards: int) -> tuple[tuple, tuple, np.ndarray]:
    """Words and pairs of texts as by ``by_shard``, and the size of each text."""
    parts = [batch_codes(column.slice(at, 500)) for at in range(0, len(column), 500)]
    codes, sizes = np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts])
    return by_shard(codes, shards), by_shard(pair_code(before(codes, sizes), codes), shards), sizes


def learn(train: DataFrame, shards: int, most: int = CHUNK_TOKENS) -> DataFrame:
    """(shard, w, c, filter, pairs): of each shard its words' codes in order, their counts, and its filter of so many pairs.

    ``train`` has text. A task adds up about ``most`` tokens' words and pairs before it sends them.
    """

    def count(batches):
        release_others(__name__)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            codes = np.concatenate([c for c, _ in held])
            sizes = np.concatenate([s for _, s in held])
            held.clear()
            out = messages(by_shard(codes, shards), by_shard(pair_code(before(codes, sizes), codes), shards), np.ones(len(codes), bool), shards)
            some = [k for k in range(shards) if out["w"][k] or out["p"][k]]
            cols = [pa.array(some, pa.int32()), *(pa.array([x[k] for k in some], pa.binary()) for x in out.values())]
            return pa.RecordBatch.from_arrays(cols, ["shard", *out])

        for batch in batches:
            for part in pieces(batch):
                held.append(batch_codes(part.column(0)))
                if sum(len(c) for c, _ in held) >= most:
                    yield flush()
        if held:
            yield flush()

    def build(key, t):
        release_others(__name__)
        (w, c), (p, n) = (total(*received(t, name, key[0].as_py(), shards)[:2]) for name in ("w", "p"))
        row = {"w": w.tobytes(), "c": c.tobytes(), "filter": LogFrequencyFilter.of(p, n).words.tobytes()}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([x], pa.binary()) for k, x in row.items()}, "pairs": pa.array([len(p)])})

    sent = train.select("text").mapInArrow(count, f"shard int, {MESSAGE}")
    return sent.groupBy("shard").applyInArrow(build, "shard int, w binary, c binary, filter binary, pairs long")


def scored(t, words: tuple, pairs: tuple, sizes: np.ndarray, counts: np.ndarray, steps: np.ndarray, n: int, v: int, new: int) -> dict[str, pa.Array]:
    """Columns of the scores of ``t`` (id, held, ..), by counts of its distinct words and steps of its distinct pairs."""
    count, pair = counts[words[1]], LogFrequencyFilter.least_count(steps)[pairs[1]]
    ends = np.cumsum(sizes)
    begin = ends - sizes
    context = np.empty_like(count)
    context[1:] = count[:-1]
    context[begin] = count[ends - 1]  # as many texts begin as end
    alone = (count + 1) / (n + v + 1)
    seen = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
    weight = np.where(context > 0, n / max(1, n + new), 0.0)  # so often a pair of the training texts was new
    smooth = weight * np.minimum(seen, 1.0) + (1 - weight) * alone
    made = {"n_tokens": pa.array(sizes), "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), begin)), "train_tokens": pa.array(np.full(t.num_rows, n, np.int64))}
    made |= {"base_score": pa.array(np.add.reduceat(np.log10(alone), begin)), "score": pa.array(np.add.reduceat(np.log10(smooth), begin))}
    return {"id": t.column("id"), "held_out": t.column("held"), **made}


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", chunk_tokens: int = CHUNK_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Learns from the rows that aren't held out and scores all. A null or empty text is one end
    token. Rows with a null id aren't held out. Repeated rows train and are scored as often as they
    stand there, dealt like others by their place. With no training rows every count is 0. Only the two
    named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    n, every = token_totals(rows)
    shards, chunks = max(1, -(-n // chunk_tokens)), max(1, -(-every // chunk_tokens))
    made = f"id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if TOKEN_BYTES * n <= broadcast_bytes:
        model = {r.shard: (bytes(r.w), bytes(r.c), bytes(r.filter), r.pairs) for r in learn(rows.where(~F.col("held")), shards, chunk_tokens).collect()}  # its size is bounded by the check
        v, new = sum(len(w) // 8 for w, _, _, _ in model.values()), sum(x[3] for x in model.values())
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @in_batches
        def here(batch):
            words, pairs, sizes = coded(batch.column("text"), shards)
            counts, steps = np.zeros(len(words[0]), dtype=np.int64), np.zeros(len(pairs[0]), dtype=np.int64)
            for shard, (w, c, f, _) in sent.value.items():
                ours, theirs = (slice(x[2][shard], x[2][shard + 1]) for x in (words, pairs))
                counts[ours] = known(np.frombuffer(w, "<u8"), np.frombuffer(c, "<i8"), words[0][ours])
                steps[theirs] = LogFrequencyFilter(np.frombuffer(f, "<u8"), 1.0).found(pairs[0][theirs])
            return scored(batch, words, pairs, sizes, counts, steps, n, v, new)

        return rows.mapInArrow(here, made).withColumnRenamed("id", id_col)

    parts = max(1, min(chunks, 100_000))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition(parts, "chunk")

    def ask(key, t):
        release_others(__name__)
        words, pairs, sizes = coded(t["text"], shards)
        sent = messages(words, pairs, np.repeat(~t["held"].to_numpy(), sizes), shards)
        to = {"shard": pa.array(range(shards), pa.int32()), "chunk": pa.array([key[0].as_py()] * shards, pa.int32())}  # all, as each tells its totals
        return pa.table(to | {k: pa.array(x, pa.binary()) for k, x in sent.items()})

    def answer(key, asked):
        release_others(__name__)
        each = lambda x, ends: [squeezed(part) for part in np.split(x, ends[:-1])]
        words, n_words, ends = received(asked, "w", key[0].as_py(), shards)
        w, c = total(words, n_words)
        counts = each(known(w, c, words), ends)
        del words, n_words, c
        pairs, n_pairs, ends = received(asked, "p", key[0].as_py(), shards)
        p, count = total(pairs, n_pairs)
        new, f = len(p), LogFrequencyFilter.of(p, count)
        del n_pairs, p, count
        steps = each(np.minimum(f.found(pairs), 255).astype("u1"), ends)
        told = {"w": pa.array(counts, pa.binary()), "p": pa.array(steps, pa.binary()), "words": pa.array([len(w)] * len(counts)), "pairs": pa.array([new] * len(counts))}
        return pa.table({"chunk": asked["chunk"], "shard": asked["shard"], **told})

    def heard(key, t, told):
        release_others(__name__)
        words, pairs, sizes = coded(t["text"], shards)
        told = told.sort_by("shard")
        got = [np.concatenate([unsqueezed(x, size, kind) for x, size in zip(told[name].to_pylist(), np.diff(begin).tolist(), strict=True)]) for name, kind, begin in (("w", "<i8", words[2]), ("p", "u1", pairs[2]))]
        v, new = (sum(told[x].to_pylist()) for x in ("words", "pairs"))
        return pa.table(scored(t, words, pairs, sizes, got[0], got[1].astype(np.int64), n, v, new))

    asked = dealt.groupBy("chunk").applyInArrow(ask, f"shard int, chunk int, {MESSAGE}")
    answers = asked.groupBy("shard").applyInArrow(answer, "chunk int, shard int, w binary, p binary, words long, pairs long").repartition(parts, "chunk")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(heard, made).withColumnRenamed("id", id_col)
