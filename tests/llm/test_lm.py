import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keytide.llm import lm


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_base_counts_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(200)
    extra = spark.createDataFrame([(900001, None), (900002, ""), (900003, "  \t"), (900004, "the " * 5000), (900004, "the " * 5000), (None, "null id text")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t in rows)
    got = lm.score_documents(docs.withColumn("score", docs.text).withColumn("id", docs.text), chunk_tokens=9000).collect()
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score <= 0 for r in got)
    gain = sum(r.score - r.base_score for r in got if r.held_out)
    assert gain > 0  # pairs help on texts that weren't trained on


def test_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filter_counts_within_a_step():
    r = np.random.default_rng(1)
    code = r.integers(1 << 62, size=30_000).astype(np.uint64)
    count = np.exp(r.uniform(np.log(1), np.log(1e6), 30_000)).astype(int)
    f = lm.LogFrequencyFilter.of(code, count)
    got = f.count(code)
    over = got > count  # by a false positive of the next step
    assert over.mean() < 0.002 and (got >= count / lm.BASE - 1e-9)[~over].all() and (got[count < 4] == count[count < 4]).mean() > 0.998
    assert (f.count(r.integers(1 << 62, size=200_000).astype(np.uint64)) > 0).mean() < 0.001


def test_probabilities_of_a_context_add_up_to_one_at_most(spark):
    """One context with 60 followers seen once and some more often: all its words' probabilities, by texts held out."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train, out = (iter([i for i in range(9000) if held(i) == h]) for h in (False, True))
    follow = [f"f{k}" for k in range(60)] + ["g1"] * 2 + ["g2"] * 3 + ["g3"] * 7
    rows = [(next(train), f"ctx {f}") for f in follow] + [(next(train), f"other{k} f{k % 60}") for k in range(300)]
    vocabulary = sorted({w for _, t in rows for w in t.split()}) + ["never"]
    asked = {w: next(out) for w in vocabulary} | {None: next(out)}
    texts = rows + [(i, f"ctx {w}" if w else "ctx") for w, i in asked.items()]
    got = {x.doc_id: x.score for x in lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    # score of "ctx w" = P(ctx | begin) P(w | ctx) P(end | w); the last and the first factor are computed by hand
    c, pairs = Counter(), Counter()
    for _, t in rows:
        w = ["<", *t.split(), ">"]
        c.update(w)
        pairs.update(zip(w[:-1], w[1:]))
    n, v = sum(c.values()) - c["<"], len(c) - 1
    share = n / (n + len(pairs))
    low = lambda x: math.ceil(lm.BASE ** math.floor(math.log(x) / math.log(lm.BASE) + 1e-9) - 1e-9) if x else 0
    p = lambda a, b: (share * low(pairs[a, b]) / c[a] if c[a] else 0) + (1 - (share if c[a] else 0)) * (c[b] + 1) / (n + v + 1)
    total = 0.0
    for w, i in asked.items():
        known = math.log10(p("<", "ctx")) + (math.log10(p(w, ">")) if w else 0)
        one = 10 ** (got[i] - known)
        assert one == pytest.approx(p("ctx", w or ">"), rel=1e-6) or pairs["ctx", w or ">"] == 0  # false positives aside
        total += one
    assert 0.6 < total <= 1 + len(asked) * 0.0005


def test_rare_pairs_of_a_large_corpus_count(spark):
    """Every pair counts, also in a corpus of over a million tokens: against exact counts of all pairs."""
    r = np.random.default_rng(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rare = [[f"r{k}w{x}" for x in range(40)] for k in range(30)]  # each pair in one training text
    train, out = (iter([i for i in range(400) if held(i) == h]) for h in (False, True))
    rows = [(next(train), " ".join(w)) for w in rare] + [(next(out), " ".join(w)) for w in rare]
    rows += [(next(train), " ".join(f"c{x}" for x in r.integers(300, size=20_000))) for _ in range(110)]
    c, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = ["<", *t.split(), ">"]
            c.update(w)
            pairs.update(zip(w[:-1], w[1:]))
    n, v = sum(c.values()) - c["<"], len(c) - 1
    assert n > 2_000_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x.doc_id: x for x in lm.score_documents(docs, chunk_tokens=300_000).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = ["<", *t.split(), ">"]
        alone = [(c[b] + 1) / (n + v + 1) for b in w[1:]]
        share = n / (n + len(pairs))
        exact = [(share * pairs[a, b] / c[a] if c[a] else 0) + (1 - (share if c[a] else 0)) * p for a, b, p in zip(w[:-1], w[1:], alone)]
        assert got[i].train_tokens == n
        assert sum(map(math.log10, exact)) - len(exact) * math.log10(lm.BASE) - 1e-6 <= got[i].score <= sum(map(math.log10, exact)) + 0.3, i


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_scores_equal_a_plain_scorer_with_the_same_filters(spark, broadcast_bytes):
    r = random.Random(12)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(5, "A b a B a")] * 40 + [(None, "a b"), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    n = sum(len((t or "").split()) + 1 for t in train)
    most = 700
    shards = -(-n // most)
    model = {x.shard: x for x in lm.learn(spark.createDataFrame([(t,) for t in train], "text string"), shards, most).collect()}
    assert len(model) == shards > 5
    count = {int(w): int(c) for x in model.values() for w, c in zip(np.frombuffer(x.w, "<u8"), np.frombuffer(x.c, "<i8"))}
    filters = {k: lm.LogFrequencyFilter(np.frombuffer(x["filter"], "<u8"), 1.0) for k, x in model.items()}
    v, new = len(count), sum(x.pairs for x in model.values())
    assert sum(count.values()) == n

    def plain(text):
        codes, score, last = lm.word_codes((text or "").encode()).tolist(), 0.0, lm.BEGIN
        for c in codes:
            pair = lm.pair_code(np.array([last], np.uint64), np.array([c], np.uint64))
            stored = float(filters[int(pair[0] % np.uint64(shards))].count(pair)[0])
            context = count.get(lm.END if last == lm.BEGIN else last, 0)
            weight = n / (n + new) if context else 0
            score += math.log10(weight * min(1, stored / context if context else 0) + (1 - weight) * (count.get(c, 0) + 1) / (n + v + 1))
            last = c
        return score

    got = lm.score_documents(docs, chunk_tokens=most, broadcast_bytes=broadcast_bytes).collect()
    assert len(got) == len(rows) and all(x.train_tokens == n and x.held_out == held(x.doc_id) for x in got)
    want = sorted(round(plain(t), 9) for _, t in rows)
    assert np.allclose(sorted(x.score for x in got), want, rtol=0, atol=1e-8)
    by_id = {x.doc_id: x.score for x in got}
    assert all(abs(by_id[i] - plain(t)) < 1e-9 for i, t in rows[:300] if i != 5)


def test_all_rows_held_out(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, f"word{i} b c") for i in ids], "doc_id long, text string")
    for most in (4, 1 << 20):  # several chunks, though nothing trains
        got = lm.score_documents(docs, chunk_tokens=most).collect()
        assert len(got) == len(ids) and all(x.held_out and x.train_tokens == x.n_known == x.score == x.base_score == 0 for x in got)


def test_packed_codes_are_the_same_and_short():
    r = np.random.default_rng(8)
    for bits, shards, n in ((56, 6, 150_000), (64, 6, 70_000), (64, 1, 1), (64, 1, 100_000), (56, 1000, 3), (64, 1, 0), (8, 1, 200)):
        top = ((1 << bits) - 1) // shards
        x = np.unique(np.concatenate([r.integers(top, size=max(0, n - 2), dtype=np.uint64, endpoint=True), np.array([0, top][:n], np.uint64)]))
        sent = lm.packed(x, top)
        assert np.array_equal(lm.unpacked(sent, top), x)
        assert len(sent) <= 18 + len(x) * (math.log2(top / max(1, len(x)) + 1) + 2) / 8
    for kind in ("u1", "<u4", "<i8"):
        x = r.integers(np.iinfo(kind).max, size=500, endpoint=True).astype(kind)
        for y in (x, x[:1], x[:0]):
            assert np.array_equal(lm.unsqueezed(lm.squeezed(y), len(y), kind), y)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_codes_are_sent_once(spark, broadcast_bytes):
    """Bytes that tasks write for others, on texts whose pairs are nearly all different: a code once, a text only if it is dealt."""
    r = np.random.default_rng(4)
    words = [f"{x:x}" for x in r.integers(1 << 40, size=40_000).tolist()]
    rows = [(i, " ".join(words[k] for k in r.integers(len(words), size=399))) for i in range(2500)]
    docs, sc = spark.createDataFrame(rows, "doc_id long, text string"), spark.sparkContext

    def sent():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    old = sent()
    got = lm.score_documents(docs, chunk_tokens=250_000, broadcast_bytes=broadcast_bytes).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == [(i, 400) for i in range(2500)]
    written = sum(v for k, v in sent().items() if k not in old)
    assert 4_000_000 < written < 9 * 400 * 2500 + (0 if broadcast_bytes else sum(len(t) for _, t in rows)), written
