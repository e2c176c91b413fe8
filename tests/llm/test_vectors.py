import math

import numpy as np
import pytest

from keytide.llm import ann, embed_dedup

NAN = float("nan")
SCHEMA = "vec_id long, embedding array<float>, kept string, score int"


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(2)
    rows = [r.standard_normal(16) for _ in range(300)]
    for c in range(6):  # groups about the threshold, one larger than a window
        base = r.standard_normal(16)
        rows += [base + r.standard_normal(16) * s for s in r.uniform(0.02, 0.3, 160 if c == 0 else 25)]
    rows += [rows[0]] * 5 + [rows[310]] * 7
    vecs = {i: [float(np.float32(x)) for x in v] for i, v in enumerate(rows)}
    odd = {2000: None, 2020: [0.0] * 16, 2001: [NAN] + [1.0] * 15, 2002: [None] + [1.0] * 15, 2003: [math.inf] + [1.0] * 15, 2040: [1.0, 2.0], 2005: [2.0, 4.0], 2006: []}
    return vecs, odd


def frame(spark, data):
    return spark.createDataFrame([(i, v, "x", 1) for d in data for i, v in d.items()] , SCHEMA).repartition(6)


def test_links_against_all_pairs(spark, data, monkeypatch):
    vecs, odd = data
    for block in (1024, 48):  # and with blocks small enough for the centre rule
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        got = {x.vec_id: x for x in embed_dedup.link_near_duplicates(frame(spark, data)).collect()}
        x = np.array([vecs[i] for i in sorted(vecs)])
        x /= np.linalg.norm(x, axis=1)[:, None]
        link = x @ x.T >= 0.95
        np.fill_diagonal(link, False)
        label = np.arange(len(x))
        for _ in range(50):
            label = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        assert link.sum() > 5000
        assert len(got) == len(vecs) + len(odd)
        for i in range(len(x)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), label[i], label[i] == i), i
        for i in odd:
            pair = i in (2040, 2005)
            assert (got[i].n_links, got[i].component_id) == ((1, 2005) if pair else (0, i))


def test_links_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embed_dedup.link_near_duplicates(empty).count() == 0
    assert ann.nearest(empty, empty.vec_id % 20 == 0).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 2.0], "", 1), (4, [1.0, 2.0], "", 1), (4, [1.0, 2.0], "", 1)], SCHEMA)
    got = sorted((str(x.vec_id), x.n_links, x.component_id, x.kept) for x in embed_dedup.link_near_duplicates(nulls).collect())
    assert got == [("4", 2, 4, True), ("4", 2, 4, True), ("None", 2, 4, False)]


def test_nearest_against_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    vecs, odd = data
    df = frame(spark, data)
    got = {}
    for x in ann.nearest(df, df.vec_id % 20 == 0, 20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ids = np.array(sorted(vecs))
    x = np.array([vecs[i] for i in ids], dtype=np.float64)
    for q in [i for i in vecs if i % 20 == 0]:
        s = x @ x[q]
        want = [(-s[j], j) for j in ids if j != q]
        want.sort()
        rows = sorted(got.pop(q))
        assert [r[0] for r in rows] == list(range(1, 21))
        assert np.allclose([r[2] for r in rows], [-w[0] for w in want[:20]], rtol=1e-12, atol=1e-12)
        clear = [k for k in range(20) if abs(want[k][0] - want[k + 1][0]) > 1e-9 and (k == 0 or abs(want[k][0] - want[k - 1][0]) > 1e-9)]
        assert all(rows[k][1] == want[k][1] for k in clear)
    assert {q: [r[1] for r in v] for q, v in got.items()} == {2040: [2005]}


def test_exact_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 1.0], "", 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(x["rank"], x.vec_id) for x in ann.nearest(df, df.vec_id == 20, 5).collect()]
    assert sorted(got) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_pairs_in_a_dense_group_are_found(spark):
    """A third of the rows in one group at cosines of 0.9 among themselves, with planted pairs at 0.955."""
    r = np.random.default_rng(9)
    n, dim, planted = 45_000, 64, 600
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(r.standard_normal(dim))
    aside = lambda x, c: unit(x - (x * c).sum(axis=-1, keepdims=True) * c)
    group = math.sqrt(0.9) * centre + math.sqrt(0.1) * aside(r.standard_normal((n // 3, dim)), centre)
    of = group[:planted]
    copies = 0.955 * of + math.sqrt(1 - 0.955**2) * aside(r.standard_normal((planted, dim)), of)
    x = np.concatenate([group, copies, r.standard_normal((n - len(group) - planted, dim))]).astype("<f4")
    y = unit(x[: len(group) + planted].astype(float))
    link = np.concatenate([y[s : s + 1000] @ y.T >= 0.95 for s in range(0, len(y), 1000)])
    count = link.sum(axis=1) - 1
    assert (count[:planted] > 0).mean() > 0.9
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(8)
    got = {z.vec_id: z.n_links for z in embed_dedup.link_near_duplicates(df).collect()}
    assert len(got) == n
    lost = sum(count[i] - got[i] for i in range(len(y)))
    assert lost <= 0.005 * count.sum()


def test_a_repeated_query_id_answers_once_whatever_the_order(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-5, 6, 6).astype(float).tolist(), "", 1) for i in range(40)] + [(20, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0], "", 1), (20, [3.0, 0.0, 0.0, 1.0, 1.0, 1.0], "", 1), (7, [2.0] * 6, "", 1)]
    got = []
    for k in range(3):
        df = spark.createDataFrame(rows[k * 17 :] + rows[: k * 17], SCHEMA).repartition(3 + k)
        got.append(sorted(map(tuple, ann.nearest(df, df.vec_id % 20 == 0, 9).collect())))
    assert got[0] == got[1] == got[2] and [x[1] for x in got[0] if x[0] == 20] == list(range(1, 10))
    first = min((len(v), np.array(v).tobytes(), v) for i, v, *_ in rows if i == 20)[2]
    want = sorted((-float(np.dot(first, v)), i) for i, v, *_ in rows if i != 20 and any(v))[:9]
    assert [(x[3], x[2]) for x in got[0] if x[0] == 20] == [(-s, i) for s, i in want]


def test_passes_alone_find_planted_pairs_and_their_components(spark):
    """Pairs from 0.95 to 0.96, chains and copies among random vectors, with hardly any left to be compared all with all."""
    r = np.random.default_rng(13)
    dim, n = 24, 3000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(r.standard_normal((n, dim)))
    aside = unit((lambda z: z - (z * base[:400]).sum(axis=1, keepdims=True) * base[:400])(r.standard_normal((400, dim))))
    cos = r.uniform(0.951, 0.96, (400, 1))
    x = np.concatenate([base, cos * base[:400] + np.sqrt(1 - cos**2) * aside, base[500:520]])
    link = unit(x) @ unit(x).T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(20):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(6)
    nodes = df.count()
    found = embed_dedup.passes(nodes, 0.95, 16)
    assert 2 * 16 * found < nodes  # so that passes are what is made
    got = {z.vec_id: z for z in embed_dedup.link_near_duplicates(df, few=0, window=16).collect()}
    right = [got[i].n_links == link[i].sum() and got[i].component_id == comp[i] for i in range(len(x))]
    linked = link.any(axis=1)
    assert linked.sum() > 800 and np.mean(np.array(right)[linked]) >= 0.99 and all(np.array(right)[~linked])
