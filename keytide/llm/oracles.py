"""SQL that DuckDB must agree with, for what SQL can express of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document's words, and crc32 of its id as text by the bitwise rule.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = v.vec_id) AS component_id, v.vec_id = (SELECT min(b) FROM r WHERE r.a = v.vec_id) AS kept FROM v"""

OP6 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT r, doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
low AS (SELECT s, min(doc_id) AS m FROM p GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 50)) AS j FROM p JOIN low USING (s) WHERE m < doc_id),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, (SELECT count(*) FROM gone WHERE gone.r = d.r) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

ANN = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS x FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(x, 8) AS score FROM k WHERE rank <= 20"""

LM = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {CRC32} % 7 = 2 AS held_out, list_append({WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, chr(10)) AS w FROM documents),
t AS (SELECT r, held_out, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)) AS b FROM t LEFT JOIN c USING (x) CROSS JOIN n GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(b, 3) AS base_score FROM d JOIN s USING (r) CROSS JOIN n"""

#: For pages that mark their article by its tag and have paragraphs and a heading in it, as all pages of the tables do.
PAGES = r"""
WITH b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>'),
  lambda x: replace(replace(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '&quot;', '"'), '&amp;', '&')) AS b FROM pages),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

#: Terms of a text, and the search over all documents for all items.
TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {TERMS.format("coalesce(text, '')")} AS t FROM documents),
a AS (SELECT count(*)::HUGEINT AS nd, sum(len(t))::HUGEINT AS nt FROM d WHERE len(t) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN a GROUP BY t, nd),
q AS (SELECT DISTINCT item_id, k, unnest({TERMS.format("coalesce(text, '')")}) AS t FROM (SELECT *, row_number() OVER () AS k FROM benchmark)),
s AS (SELECT item_id, k, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * CAST(10 + (90 * len(d.t) * nd) // nt AS BIGINT))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN d USING (r) CROSS JOIN a GROUP BY item_id, k, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o WHERE rank <= 10"""

#: Words of at least seven letters, deletions by a table of crc32, nearness by deletions and by patterns with one letter left open.
SPELLING = r"""
WITH RECURSIVE x AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS t),
o AS (SELECT translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS d FROM documents),
c AS (SELECT t, d, count(*) AS n FROM o GROUP BY ALL),
b AS (SELECT c.t, n, x.t AS tab, flatten(list_transform(string_split(d || ':' || c.t, ''), lambda s: CASE WHEN ascii(s) < 128 THEN [ascii(s)::BIGINT] ELSE [192 + (ascii(s)::BIGINT >> 6), 128 + (ascii(s)::BIGINT & 63)] END)) AS y FROM c CROSS JOIN x),
h AS (SELECT t, n, xor(list_reduce(list_prepend(4294967295::BIGINT, y), lambda a, e: xor(a >> 8, tab[CAST(xor(a, e) & 255 AS BIGINT) + 1])), 4294967295::BIGINT) AS h FROM b),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(t, h % length(t)) || substr(t, h % length(t) + 2) ELSE t END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM w),
p AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less, left(word, i) || chr(1) || substr(word, i + 2) AS wild FROM k),
e AS (SELECT a.word AS u, b.word AS v FROM p a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word FROM p a JOIN w b ON a.less = b.word UNION SELECT a.word, b.word FROM p a JOIN p b ON a.wild = b.wild AND a.word <> b.word),
m AS (SELECT u, v, n, count(*) OVER (PARTITION BY u) AS c, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS r FROM e JOIN w ON w.word = e.v),
f AS (SELECT w.word, w.n, coalesce(c, 0) AS n_near, CASE WHEN m.n >= 10 * w.n THEN v END AS form, CASE WHEN m.n >= 10 * w.n THEN m.n END AS form_n FROM w LEFT JOIN m ON w.word = m.u AND m.r = 1),
g(word, root) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, g.root FROM f JOIN g ON g.word = f.word JOIN f z ON z.word = g.root AND z.form IS NULL"""


def _kind(kind: str, order: int, pattern: str, good: str) -> str:
    """Spans (r, s, o, e, kind) of one kind: places from the lengths of the stretches between matches."""
    p = pattern.replace("'", "''")
    cut = f"SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS p FROM d"
    each = f"SELECT r, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS k, m, p FROM ({cut})"
    at = f"SELECT r, v, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS s, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM ({each})"
    return f"SELECT r, CAST(s AS BIGINT) AS s, {order} AS o, CAST(s + length(v) AS BIGINT) AS e, '{kind}' AS kind FROM ({at}) WHERE {good}"


LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(g[length(g) + 1 - i] AS BIGINT) ELSE (2 * CAST(g[length(g) + 1 - i] AS BIGINT)) // 10 + (2 * CAST(g[length(g) + 1 - i] AS BIGINT)) % 10 END)) % 10 = 0"
SPANS = " UNION ALL ".join(
    [
        _kind("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
        _kind("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: CAST(right('000' || ltrim(x, '0'), greatest(3, length(ltrim(x, '0')))) AS DOUBLE))) <= 255"),
        _kind("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length(g) BETWEEN 12 AND 19 AND {LUHN}"),
        _kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 9 AND 15"),
    ]
)
PII = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), s AS ({SPANS}),
g AS (SELECT r, count(CASE WHEN o = 0 THEN 1 END) AS n_email, count(CASE WHEN o = 1 THEN 1 END) AS n_ip, count(CASE WHEN o = 2 THEN 1 END) AS n_card, count(CASE WHEN o = 3 THEN 1 END) AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS line FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(line, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)"""


def ann_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_ann`` with its scores to eight places, as sums in another order differ in the last bits."""
    from keytide.llm.queries import op10_ann

    return op10_ann(spark, sf_dir).withColumn("score", F.round("score", 8))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_lm`` that its base model gives, its score to three places."""
    from keytide.llm.queries import op7_lm

    return op7_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op3_pii`` that its base patterns give."""
    from keytide.llm.queries import op3_pii

    return op3_pii(spark, sf_dir).drop("spans")


QUERIES = {f.__name__: f for f in (ann_rounded, lm_base, pii_base)}
ORACLE_SQL = {"op1_embedding_dedup": OP1, "op6_substring": OP6, "ann_rounded": ANN, "lm_base": LM, "pii_base": PII, "op11_spelling": SPELLING, "op12_lexical": SEARCH, "op13_html_text": PAGES}
