import itertools
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from keytide.llm import simhash
from keytide.llm.common import connected_components


@settings(max_examples=300, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_pair_within_four_bits_meets(a, bits):
    b = a ^ sum(1 << x for x in bits)
    for third, most in ((False, 72), (True, 300)):
        row, key = simhash.keys(np.array([a, b], dtype=np.uint64), third)
        assert (np.bincount(row, minlength=2) <= most).all() and set(key[row == 0]) & set(key[row == 1])


def brute(texts, most=4):
    def one(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [one(t) for t in texts]
    label = list(range(len(f)))
    for _ in f:
        for i, j in itertools.combinations(range(len(f)), 2):
            if bin(f[i] ^ f[j]).count("1") <= most:
                label[i] = label[j] = min(label[i], label[j])
    return f, label


def test_against_all_pairs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Über", "É", "MIX"]
    base = [" ".join(r.choice(words) for _ in range(400)) for _ in range(12)]
    texts = list(base)
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append("  ".join(w))
    texts += [None, "", " \t\n", "one", "one", "One two three", "a b c d", "x" * 50_000, "the " * 20_000]
    f, label = brute(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(5)
    got = {x.doc_id: x for x in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    prints = spark.createDataFrame([(x - (x >> 63 << 64),) for x in set(f)], "fp long")
    one, two = (connected_components(simhash.links(prints, crowded=c), "a", "b") for c in (1 << 26, 10))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []
    assert len(set(label)) < len(texts) - 40
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{f[i]:016x}" and got[i].component_id == label[i], i


def test_large_bucket_and_empty(spark):
    r = random.Random(4)
    centre = r.getrandbits(64)
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}
    rows = [(np.uint64(x).astype(np.int64).item(),) for x in near]
    found = simhash.links(spark.createDataFrame(rows, "fp long"))
    from keytide.llm.common import connected_components

    comps = connected_components(found, "a", "b").collect()
    assert len(comps) == len(near) and len({c.component for c in comps}) == 1
    none = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "q r s t u v")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.component_id) for x in simhash.near_duplicates(docs).collect())
    assert got == [("3", 3), ("7", 7), ("7", 7), ("None", 7)]


def shingles(text, words=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)])


def classes(texts, least=0.8):
    """The smallest place that each text reaches over Jaccard links, and the links, by all pairs."""
    f = [shingles(t) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(f)), 2) if len(f[i] & f[j]) >= least * len(f[i] | f[j])]
    label, again = list(range(len(f))), True
    while again:
        again = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                again = True
    return label, near


def edited(r, text, words, times):
    w = text.split()
    for _ in range(times):
        w[r.randrange(len(w))] = r.choice(words)
    return " ".join(w)


def test_keep_one_against_all_pairs_by_jaccard(spark):
    """Families of texts with 0 to 8 % of words changed: Jaccard indexes on both sides of 0.8."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for n in (6, 12, 40, 100, 300, 900):
        for _ in range(4):
            base = " ".join(r.choice(words) for _ in range(n))
            texts += [base] + [edited(r, base, words, r.randint(0, max(1, n * 8 // 100))) for _ in range(9)]
    texts += [" ".join(r.choice(words) for _ in range(50)) for _ in range(50)]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    label, near = classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    want = {i for i, x in enumerate(label) if i == x}
    assert len(near) > 200 and want <= kept  # nothing without a verified link goes
    assert len(kept - want) <= 0.02 * (len(texts) - len(want))


def test_recall_right_at_the_threshold(spark):
    """Pairs of two texts each, at a Jaccard index from 0.8 to 0.83."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(20_000)]
    texts = []
    while len(texts) < 800:
        base = " ".join(r.choice(words) for _ in range(r.randint(120, 400)))
        other = edited(r, base, words, round(len(base.split()) * 0.0215))
        a, b = shingles(base), shingles(other)
        if 0.8 <= len(a & b) / len(a | b) < 0.83:
            texts += [base, other]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).count()
    assert 400 <= kept <= 400 + 0.05 * 400


def test_large_family_is_dealt_into_blocks(spark, monkeypatch):
    """A group of many blocks, with a class that its first pivots don't reach."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 16)
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    base = " ".join(r.choice(words) for _ in range(120))
    texts = [edited(r, base, words, r.randint(0, 9)) for _ in range(260)]
    label, near = classes(texts)
    want = {i for i, x in enumerate(label) if i == x}
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert len(near) > 1000 and 10 < len(want) < 250 and want <= kept and len(kept - want) <= 3


def test_links_of_a_large_near_copy_group_stay_few(spark, monkeypatch):
    """6000 fingerprints around one centre, also when its keys are met piece by piece."""
    from keytide.llm.common import connected_components

    r = random.Random(8)
    centre = r.getrandbits(64)
    near = {centre}
    while len(near) < 6000:
        near.add(centre ^ sum({1 << r.randrange(64) for _ in range(3)}))
    rows = [(np.uint64(x).astype(np.int64).item(),) for x in near]
    for hot in (4096, 700):
        monkeypatch.setattr(simhash, "HOT", hot)
        found = simhash.links(spark.createDataFrame(rows, "fp long")).cache()
        assert found.count() < 50_000
        comps = connected_components(found, "a", "b").collect()
        assert len(comps) == 6000 and len({c.component for c in comps}) == 1


def test_hot_keys_lose_no_link(spark, monkeypatch):
    """Fingerprints that share a segment but form many components, met in pieces of 40 rows."""
    from keytide.llm.common import connected_components

    monkeypatch.setattr(simhash, "HOT", 40)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    r = random.Random(9)
    low = r.getrandbits(43)
    fps = set()
    for _ in range(70):
        c = low | r.getrandbits(21) << 43
        fps |= {c} | {c ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, 4))}) for _ in range(6)}
    fps = sorted(fps)
    label = list(range(len(fps)))
    again = True
    while again:
        again = False
        for i, j in itertools.combinations(range(len(fps)), 2):
            if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= 4:
                label[i] = label[j] = min(label[i], label[j])
                again = True
    signed = [np.uint64(x).astype(np.int64).item() for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3))
    comps = {x.node: x.component for x in connected_components(found, "a", "b").collect()}
    groups = {}
    for x, k in zip(signed, label):
        groups.setdefault(k, set()).add(comps.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_short_texts_find_copies_longer_than_the_sketch(spark):
    """A text of 26 to 32 shingles whose copy has up to 40: the copy's smallest hashes leave shared ones out."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(150):
        n = 26 + k % 7
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, int(n / 0.8) + 4)]
        rows += [(2 * k, " ".join(words[: n + 4])), (2 * k + 1, " ".join(words))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(150)} <= kept
    assert len(kept) <= 150 + 8  # pairs at 0.8 become candidates with a chance of 0.98
