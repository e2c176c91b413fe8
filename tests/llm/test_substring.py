import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keytide.llm import substring


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=4, max_size=12), min_size=1, max_size=8), st.randoms())
def test_index_against_all_windows(segs, r):
    owner = np.array([r.randint(0, 9) for _ in segs])
    low = substring.smallest_owner(np.array([len(s) for s in segs]), np.array([x for s in segs for x in s], dtype=np.uint64), owner, 4)
    best = {}
    for s, o in zip(segs, owner):
        for k in range(len(s) - 3):
            best[tuple(s[k : k + 4])] = min(o, best.get(tuple(s[k : k + 4]), 99))
    for s, got in zip(segs, low):
        assert got.tolist() == [best[tuple(s[k : k + 4])] for k in range(len(s) - 3)]


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(0)
    passage = r.integers(1 << 60, size=70).astype(np.uint64)
    names = []
    for _ in range(5):
        a = np.concatenate([r.integers(1 << 60, size=r.integers(90)).astype(np.uint64), passage, r.integers(1 << 60, size=40).astype(np.uint64)])
        g, first, n = substring.segments(a)
        assert n.sum() == len(a) - 49 and (first == np.cumsum(n) - n).all()
        at = len(a) - 40 - 70
        names.append(np.repeat(g, n)[at : at + 21].tolist())
    assert all(x == names[0] for x in names)
    assert len(substring.segments(passage[:49])[0]) == 0


def brute(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("heavy", [4096, 2])
def test_against_all_windows(spark, heavy):
    r = random.Random(heavy)
    word = lambda: f"w{r.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (50, 49, 51, 120, 400)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            at = r.randrange(len(w) + 1)
            w[at:at] = p[: a + 1] if r.random() < 0.3 else p
        rows.append((i, r.choice(["  ", " ", "\n"]).join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (501, rows[7][1]), (None, rows[3][1]), (600, None), (601, ""), (602, "the " * 3000), (603, "the " * 2000), (604, "a b " * 200), (-5, " ".join(passages[4]))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cuts string, h int").repartition(6)
    want = brute(rows, 50)
    got = sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in substring.digests(docs, heavy=heavy, shard_words=3000).collect())
    assert got == [x[:4] for x in want]
    assert sum(x[2] > 0 for x in want) > 30
    if heavy > 2:
        texts = sorted((str(x.doc_id), " ".join((x.text or "").split()), x.cuts, x.h) for x in substring.remove(docs).collect())
        assert [x[:2] for x in texts] == sorted((x[0], x[4]) for x in want) and all(x[2:] == ("x", 1) for x in texts)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.digests(empty).count() == 0 and substring.remove(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=14), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 3), max_size=15), min_size=1, max_size=6), st.integers(2, 9))
def test_matching_statistics_of_streamed_documents(segs, docs, depth):
    """Documents that aren't in the index, with words that it doesn't know (0)."""
    seq = np.array([x for s in segs for x in [*s, 0]])
    owner = np.repeat(np.arange(len(segs)) * 7 % 5, [len(s) + 1 for s in segs])
    index = substring.WordIndex(seq, depth, owner)
    known = {x for s in segs for x in s}
    docs = [[x if x in known else 0 for x in d] for d in docs]
    size, low = index.matches(np.array([x for d in docs for x in d], dtype=np.int64), np.array([len(d) for d in docs]))
    at = 0
    for d in docs:
        for k in range(len(d)):
            holds = lambda n: [o * 7 % 5 for o, s in enumerate(segs) if any(s[i : i + n] == d[k : k + n] for i in range(len(s) - n + 1))]
            want = max([n for n in range(1, min(depth, len(d) - k) + 1) if d[k] in known and holds(n)], default=0)
            assert size[at] == want and low[at] == (min(holds(depth)) if want == depth else -1)
            at += 1


def test_index_is_small_and_exact_at_size():
    r = np.random.default_rng(1)
    passage = r.integers(1, 20_000, size=400)
    seq = np.concatenate([np.append(np.concatenate([r.integers(1, 20_000, size=60), passage]), 0) for _ in range(400)])
    index = substring.WordIndex(seq, 50, np.zeros(len(seq), np.int64))
    size = index.shared.nbytes + index.least.nbytes + index.shorter.nbytes + index.smaller.nbytes + index.start.nbytes + sum(x.nbytes for b in [index.groups, *index.bits] for x in (b.kept, b.place, b.before, b.ones))
    assert size < 10 * len(seq)  # little over one array of 64-bit numbers, the words' own tables included
    bare, parts = seq[seq > 0], [460] * 400
    got, low = index.matches(bare, np.array(parts))
    assert (got.reshape(400, 460)[:, :411] == 50).all() and (got.reshape(400, 460)[:, 411:] == np.arange(49, 0, -1)).all()
    assert (low.reshape(400, 460)[:, :411] == 0).all()


def test_ids_must_be_whole_numbers(spark):
    import pytest

    from keytide.llm import embed_dedup

    with pytest.raises(TypeError, match="doc_id"):
        substring.digests(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(TypeError, match="vec_id"):
        embed_dedup.link_near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))
