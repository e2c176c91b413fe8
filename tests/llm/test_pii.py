import hashlib
import random
import re

from keytide.llm import pii

BRUTE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(BRUTE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def odd_texts():
    r = random.Random(8)
    bits = ["a@b.c", "+d@e.f", "@", ".", "-", "1.2.3.4", "256.1.1.1", "0000255.1.2.3", ".5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "+1 (988) 555-2485", "+", "(", ")", " ", "é", "𝒳", "x", "12", "0", "\n", "_", "%"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(600)]
    texts += ["1" * 3000, "a." * 3000, "a@b" + ".c" * 9000, "1." * 4000 + "1", "+1" + "(" * 5000, "9 " * 4000, "0" * 4000 + ".1.1.1", None, ""]
    return texts


def test_base_spans_against_python(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(7)
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t, line, got[i].spans)
        assert [got[i][f"n_{k}"] for k in BRUTE] == [sum(x[3] == k for x in want) for k in BRUTE]


def test_contexts_discover_and_clean_texts_stay(spark):
    r = random.Random(9)
    words = ["the", "of", "and", "lorem", "ipsum", "dolor"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    seeds = [f"{prose(20)} my mobile +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} {prose(5)}" for _ in range(12)]
    unseen = [f"{prose(9)} my mobile (0{r.randint(10, 99)}) 555-{r.randint(1000, 9999)} {prose(5)}" for _ in range(4)]
    clean = [f"{prose(30)} of and (099) 555-1234 {prose(9)} of and +1 (988) 555-248{k} {prose(20)} of and" for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen + clean)) + [(None, None), (3, seeds[3])], "doc_id long, text string")
    got = pii.find(docs).collect()
    assert len(got) == 12 + 4 + 9 + 2
    added = {(x.doc_id, unseen[x.doc_id - 12][p.s : p.e], p.kind) for x in got for p in x.spans if not p.base}
    assert {a[0] for a in added} == set(range(12, 16)) and all(k == "phone" and re.fullmatch(r"\(0\d\d\) 555-\d{4}", v) for _, v, k in added)
    masked = {x.doc_id: x.text for x in pii.mask(docs).collect() if x.doc_id != 3}
    assert all("my mobile [PHONE] " in masked[i] for i in range(16) if i != 3)
    assert masked[None] is None


def test_mask_against_python(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, h string")
    got = {r.doc_id: r for r in pii.mask(docs).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for s, _, e, kind in brute(t):
            if s >= at:
                out += t[at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        assert got[i].text == (out + t[at:] if t else t) and got[i].h == t
    assert pii.digests(docs.limit(0)).count() == 0 and pii.mask(docs.limit(0)).count() == 0


def patterns(text, s, e, start, end):
    """The patterns around text[s:e], whose neighbours of the same search end at ``start`` and begin at ``end``."""
    left = re.sub(r"[\x20\x09-\x0D]*[\"'(\[<{]*$", "", text[start:s]).lower().split()[-2:]
    right = re.sub(r"^[\"')\]>}]*", "", text[e:end]).lower().split()[:1]
    found = [" ".join(left) + " _"] * (len(left) == 2) + [w + " _" for w in left[-1:]] + ["_ " + w for w in right]
    return [p for p in found if any(c.isalpha() for c in p)]


def scored(rows, turns=3, bar=0.5, half=3, form=0.8):
    """{(pattern, kind): confidence} of simple texts (spaces only, separate matches) in plain Python."""
    key = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}=?=?"
    loose = key + r"|(?<![A-Za-z0-9])(?:[A-Za-z]{1,3}|[(+])?[0-9][0-9(). -]{3,}[0-9](?![A-Za-z0-9])"
    edges, seen, base = {}, {}, {}
    for text in rows:
        words = text.lower().split()
        for a in [*words, *zip(words, words[1:])]:
            name = a if isinstance(a, str) else " ".join(a)
            seen[name] = seen.get(name, 0) + 1
        found = [(s, e, k, True) for s, _, e, k in brute(text)]
        for kind in BRUTE:
            ms = list(re.finditer(BRUTE[kind], text))
            for k, m in enumerate(ms):
                if any(x[:3] == (m.start(), m.end(), kind) for x in found):
                    for p in patterns(text, m.start(), m.end(), ms[k - 1].end() if k else 0, ms[k + 1].start() if k + 1 < len(ms) else len(text)):
                        n, _ = edges.get((p, kind, m[0]), (0, 0))
                        edges[p, kind, m[0]] = (n + 1, 1.0)
        ms = list(re.finditer(loose, text))
        for k, m in enumerate(ms):
            if any(m.start() < e and s < m.end() for s, e, *_ in found):
                continue
            d = len(re.sub("[^0-9]", "", m[0]))
            kinds = ["secret"] * (d >= 4) if re.fullmatch(key, m[0]) else [x for x, (a, b) in {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}.items() if a <= d <= b]
            for kind in kinds:
                seed = form if kind == "secret" and re.fullmatch("[0-9a-f]{40}", m[0]) else 0.0
                for p in patterns(text, m.start(), m.end(), ms[k - 1].end() if k else 0, ms[k + 1].start() if k + 1 < len(ms) else len(text)):
                    n, c = edges.get((p, kind, m[0]), (0, 0.0))
                    edges[p, kind, m[0]] = (n + 1, max(c, seed))
    seeds = {}
    for (_, kind, v), (_, c) in edges.items():
        if c:
            seeds[kind, v] = max(c, seeds.get((kind, v), 0))
    value, out = dict(seeds), {}
    for _ in range(turns):
        good, d, slots = {}, {}, {}
        for (p, kind, v), (n, _) in edges.items():
            slots[p, kind] = slots.get((p, kind), 0) + n
            if value.get((kind, v), 0) >= bar:
                good[p, kind] = good.get((p, kind), 0) + n * value[kind, v]
                d[p, kind] = d.get((p, kind), 0) + 1
        out = {x: g / max(slots[x], seen.get(x[0].removesuffix(" _").removeprefix("_ "), 0)) * d[x] / (d[x] + half) for x, g in good.items()}
        out = {x: c for x, c in out.items() if c >= bar}
        value, miss = dict(seeds), {}
        for (p, kind, v), _ in edges.items():
            if (p, kind) in out:
                miss[kind, v] = miss.get((kind, v), 1) * max(1e-12, 1 - out[p, kind])
        for x, m in miss.items():
            value[x] = max(value.get(x, 0), 1 - m)
    return out


def scene(seed):
    r = random.Random(seed)
    words = ["the", "of", "and", "lorem", "ipsum", "dolor", "sit", "amet"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    bare = lambda: f"(0{r.randint(10, 99)}) 555-{r.randint(1000, 9999)}"
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    other = lambda: "".join(r.choice("0123456789ABCDEFGHkmnpq") for _ in range(24)) + "7a1b2"
    rows = [f"{prose(9)} my mobile {phone()} please {prose(4)}" for _ in range(12)] + [f"{prose(9)} my mobile {bare()} please {prose(4)}" for _ in range(5)]
    rows += [f"{prose(5)} ring {bare()} please {prose(3)}" for _ in range(4)] + [f"{prose(6)} of and {bare()} {prose(9)}" for _ in range(5)]
    rows += [f'{prose(7)} token = "{secret()}" {prose(5)}' for _ in range(25)] + [f'{prose(7)} token = "{other()}" {prose(5)}' for _ in range(4)]
    rows += [f"{prose(7)} commit {secret()} {prose(5)}" for _ in range(2)] + [f"{prose(60)} mobile lorem ring the"] * 3
    return rows


def test_graph_against_a_plain_scorer(spark, monkeypatch):
    rows = scene(4)
    want = scored(rows)
    assert {("my mobile _", "phone"), ("_ please", "phone"), ("token = _", "secret")} <= set(want)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    for listed in (10_000, 0):  # words looked for by a list, and all pairs counted
        monkeypatch.setattr(pii.occurrences, "__defaults__", (listed,))
        spans = pii.base_spans(docs.select(docs.doc_id.alias("id"), "text")).cache()
        got = {(x.pattern, x.kind): x.confidence for x in pii.trusted_patterns(docs, "text", spans).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want), listed


def test_discovered_kinds_and_bounds(spark):
    rows = scene(5)
    got = {x.doc_id: [(p.kind, rows[x.doc_id][p.s : p.e]) for p in x.spans if not p.base] for x in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all([k for k, _ in got[i]] == ["phone"] for i in range(12, 21))  # the last four by a pattern that discovered ones share
    assert all(not got[i] for i in range(21, 26))  # a context that mostly precedes other words
    assert all([k for k, _ in got[i]] == ["secret"] for i in range(26, 55) if not brute(rows[i]))
    assert all(not got[i] for i in range(55, len(rows)))  # two seeds don't make a pattern


def test_written_out_addresses_and_long_words(spark):
    long = "w" * 300
    rows = [f"lorem {long} contact me{k}@mail.example.com ipsum dolor" for k in range(9)] + [f"lorem {long} contact you{k} [at] mail{k} (dot) example.com ipsum sit" for k in range(3)]
    rows += ["meet me (at) home today"]
    got = {x.doc_id: [(p.kind, rows[x.doc_id][p.s : p.e]) for p in x.spans if not p.base] for x in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[9 + k] == [("email", f"you{k} [at] mail{k} (dot) example.com")] for k in range(3)) and not got[12]
    assert all(not got[k] for k in range(9))


def test_a_text_of_many_matches(spark):
    text = " ".join(f"id {7000000 + i} +1 (555) {1000000 + i}," if i % 2 else f"10.0.{i % 250}.{i % 199} x{i * 977} a{i}@b.example.org 4111 1111 1111 1111." for i in range(6000))
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    want = {(s, e, k) for s, _, e, k in brute(text)}
    assert {(x.s, x.e, x.kind) for x in got if x.base} == want and len(want) > 9000
    free = pii.base_spans(spark.createDataFrame([(1, text)], "id long, text string")).select("other", *pii.KINDS).first()
    taken = sorted((b.s, b.e) for k in pii.KINDS for b in free[k])
    assert len(free.other) > 1000 and not any(s < x.e and x.s < e for x in free.other for s, e in taken)
