"""Personal data by patterns and by bootstrapped contexts, with DataFrame functions only.

Base spans come from four fixed patterns. They are the seeds of a bootstrap, and so are, with less
weight, strings in the form of a digest or an access key. The words around a seed induce lexical
patterns: the two words before, the one before, the one after. Patterns and the identifiers that
stand in them form a graph, over which confidence runs in turns. A pattern is as good as the known
identifiers in it and as seldom as its words stand anywhere else, and needs several of them; an
identifier is as good as its patterns together. Identifiers that become known support further
patterns in the next turn. Patterns with high confidence mark the strings in them that no base
pattern took: number-like ones, key-like ones (kind ``secret``) and written-out addresses.

Positions are found without leaving the engine: splitting a text by a pattern gives the stretches
between its matches, whose lengths add up to the matches' places in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import dropped, written

KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order of spans that start at one place; the last is only ever discovered.
ALL_KINDS = (*KINDS, "secret")
#: The base patterns. A match can't start later in a run of characters that its first part takes
#: whole, so matches start where a run starts (or where the last match ended), and repeats are
#: possessive: the same matches in one pass, for texts with runs of any length.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings that a context may mark: key-like ones (letters and digits), else number-like ones.
KEY = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}+"
CANDIDATE = KEY + r"|(?<![A-Za-z0-9])(?:[A-Za-z]{1,3}|[(+])?[0-9][0-9().\x20-]{3,}[0-9](?![A-Za-z0-9])"
#: Addresses with a bracketed "at".
AT = r"[(\[{]\x20?+[Aa][Tt]\x20?+[)\]}]"
ADDRESS = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+{AT}\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|[(\[{{]\x20?+[Dd][Oo][Tt]\x20?+[)\]}}])\x20?+[A-Za-z0-9-]++)++"
#: Key-like strings whose form alone makes them seeds: digests in hexadecimal digits, access keys.
SECRET_FORM = r"^(?:(?:[0-9a-f]{32}|[0-9A-F]{32})(?:[0-9a-f]{8}|[0-9A-F]{8}|[0-9a-f]{32}|[0-9A-F]{32})?|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36})$"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Where a word starts.
START = rf"(?:^|(?<={SPACE}))"
#: The last one or two words before a match and the first after it; quotes and brackets at the match don't count.
BEFORE = rf"((?:{START}{WORD}++{SPACE}++)?{START}{WORD}++){SPACE}*+[\"'(\[<{{]*+$"
AFTER = rf"^[\"')\]>}}]*+{SPACE}*+({WORD}++)"
#: Turns of the iteration, the least confidence that counts, and the number of different known
#: identifiers at which a pattern has half of its full confidence.
TURNS, LEAST_CONFIDENCE, HALF = 3, 0.5, 3
#: Confidence of a seed that only has the form of a secret.
FORM_CONFIDENCE = 0.8
#: Digits that a discovered identifier of a number-like kind may have.
DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
#: Patterns up to which their words' hashes (8 MB) are broadcast to the scan; beyond, all words and pairs are counted and joined.
LISTED = 1_000_000


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


#: Entries of an array that are added up or looked through at once.
FAN = 64


def levels(df: DataFrame, name: str, merged) -> DataFrame:
    """Adds ``name``1 and ``name``2: of the array ``name`` what ``merged(array)`` makes of each ``FAN`` entries, and of each ``FAN`` of these."""

    def above(of: str) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / FAN).cast("int")), lambda j: merged(F.slice(of, j * FAN + 1, F.lit(FAN))))
        return F.when(F.size(of) > 0, blocks).otherwise(F.slice(of, 1, 0))

    return df.withColumn(f"{name}1", above(name)).withColumn(f"{name}2", above(f"{name}1"))


def added(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda t, x: t + x)


def sum_before(name: str, i: Column) -> Column:
    """The sum of the first ``i`` entries of the array ``name``, in some hundred steps at most for a million entries."""
    whole = lambda n: F.floor(i / n).cast("int")
    top, middle = whole(FAN * FAN), whole(FAN)
    return added(F.slice(f"{name}2", 1, top)) + added(F.slice(f"{name}1", top * FAN + 1, middle - top * FAN)) + added(F.slice(name, middle * FAN + 1, i - middle * FAN))


def entries_below(name: str, x: Column) -> Column:
    """How many entries of the sorted array ``name`` are below ``x``; its levels have the first entries."""
    below = lambda a: F.size(F.filter(a, lambda y: y < x))
    top = below(F.col(f"{name}2"))
    middle = F.greatest(F.lit(0), (top - 1) * FAN) + below(F.slice(f"{name}1", F.greatest(F.lit(0), top - 1) * FAN + 1, F.lit(FAN)))
    return F.greatest(F.lit(0), (middle - 1) * FAN) + below(F.slice(name, F.greatest(F.lit(0), middle - 1) * FAN + 1, F.lit(FAN)))


def placed(df: DataFrame, name: str, pattern: str, gate: Column, keep=None) -> DataFrame:
    """Adds column ``name``: array of (s, e, v, before, after) of the matches in ``text``, in order.

    ``s`` and ``e`` are code points; ``before`` and ``after`` are the lower-case words around, as far
    as the matches next to it. One step a column, so that no expensive expression is evaluated twice.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(none))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("_n", F.transform("_p", F.length))
    df = levels(df.withColumn("_w", F.zip_with("_n", F.transform("_m", F.length), lambda n, k: n + F.coalesce(k, F.lit(0)))), "_w", added)

    def one(v: Column, i: Column) -> Column:
        s = sum_before("_w", i) + F.get("_n", i)
        before = F.lower(F.regexp_replace(F.regexp_extract(F.get("_p", i), BEFORE, 1), rf"{SPACE}+", " "))
        after = F.lower(F.regexp_extract(F.get("_p", i + 1), AFTER, 1))
        return F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"), before.alias("before"), after.alias("after"))

    if keep is not None:  # matches that don't count still bound the words around others
        one_ = lambda v, i: F.when(keep(v), one(v, i))
    else:
        one_ = one
    found = F.when(F.size("_m") > 0, F.transform("_m", one_)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,before:string,after:string>>"))
    df = df.withColumn(name, found)
    if keep is not None:
        df = df.withColumn(name, F.filter(name, lambda x: x.isNotNull()))
    return df.drop("_m", "_p", "_n", "_w", "_w1", "_w2")


def fitting(v: Column) -> Column:
    """The kinds that a candidate may be discovered as."""
    n = F.length(digits(v))
    key, address = v.rlike(rf"^(?:{KEY})$"), v.rlike(AT)
    kinds = [F.when(address, "email"), *(F.when(~key & ~address & n.between(*DIGITS[k]), k) for k in DIGITS), F.when(key & (n >= 4), "secret")]
    return F.array_compact(F.array(*kinds))


def base_spans(df: DataFrame) -> DataFrame:
    """Adds ``h``, a hash of the text, an array of matches for each kind, and ``other``, free candidates.

    ``df`` has ``id`` and ``text``. ``id`` and ``h`` name a row: rows that agree in both have the
    same spans.
    """
    df = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    gates = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind in KINDS:
        df = placed(df, kind, PATTERNS[kind], gates.get(kind, F.lit(True)), lambda v, kind=kind: valid(kind, v))
    df = placed(df, "loose", CANDIDATE, F.lit(True))
    df = placed(df, "written", ADDRESS, F.col("text").rlike(AT))
    df = df.withColumn("taken", F.flatten(F.array(*KINDS))).withColumn("other", F.concat("loose", "written"))
    many = F.size("taken") > FAN
    for kind in KINDS:  # a kind's spans are in order and apart
        starts = F.when(many, F.transform(kind, lambda b: b["s"])).otherwise(F.array().cast("array<int>"))
        df = levels(df.withColumn(f"_{kind}", starts), f"_{kind}", lambda a: F.get(a, F.lit(0)))

    def met(c: Column, kind: str) -> Column:
        """Whether the last span of the kind that begins before the candidate ends reaches into it."""
        return F.coalesce(F.get(kind, entries_below(f"_{kind}", c["e"]) - 1)["e"] > c["s"], F.lit(False))

    few = lambda c: F.exists("taken", lambda b: (c["s"] < b["e"]) & (b["s"] < c["e"]))
    meets = lambda c: F.when(many, reduce(Column.__or__, [met(c, k) for k in KINDS])).otherwise(few(c))
    free = F.filter("other", lambda c: ~meets(c) & (F.size(fitting(c["v"])) > 0))
    return df.withColumn("other", free).drop("taken", "loose", "written", *(f"_{k}{n}" for k in KINDS for n in ("", 1, 2)))


def patterns_of(x: Column) -> Column:
    """The lexical patterns that an occurrence stands in: two words before, one before, one after; each has a letter."""
    one = F.substring_index(x["before"], " ", -1)
    two = F.when(F.contains(x["before"], F.lit(" ")), F.concat(x["before"], F.lit(" _")))
    every = F.array_compact(F.array(two, F.when(one != "", F.concat(one, F.lit(" _"))), F.when(x["after"] != "", F.concat(F.lit("_ "), x["after"]))))
    return F.filter(every, lambda p: p.rlike(r"\p{L}"))


def graph(spans: DataFrame) -> DataFrame:
    """(pattern, kind, v, n, seed): how often each identifier stands in a pattern, and its confidence as a seed."""
    seeds = [spans.select(F.explode(k).alias("x"), F.lit(k).alias("kind"), F.lit(1.0).alias("seed")) for k in KINDS]
    others = spans.select(F.explode("other").alias("x")).select("x", F.explode(fitting(F.col("x.v"))).alias("kind"))
    form = F.when((F.col("kind") == "secret") & F.col("x.v").rlike(SECRET_FORM), FORM_CONFIDENCE).otherwise(0.0)
    rows = reduce(DataFrame.unionByName, [*seeds, others.withColumn("seed", form)])
    rows = rows.select(F.explode(patterns_of(F.col("x"))).alias("pattern"), "kind", F.col("x.v").alias("v"), "seed")
    return rows.groupBy("pattern", "kind", "v").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))


def occurrences(docs: DataFrame, text_col: str, wanted: DataFrame, listed: int = LISTED) -> DataFrame:
    """(pattern, seen): how often each wanted pattern's words stand anywhere in the corpus.

    Words are counted before anything large is joined.
    """
    part = F.split("bare", " ")
    codes = wanted.withColumn("bare", F.regexp_replace("pattern", "^_ | _$", ""))
    codes = codes.select("pattern", F.when(F.size(part) > 1, F.xxhash64(part[0], F.get(part, F.lit(1)))).otherwise(F.xxhash64(part[0])).alias("code"))
    words = F.filter(F.split(F.lower(F.col(text_col)), rf"{SPACE}+", -1), lambda w: w != "")
    rows = docs.where(F.col(text_col).isNotNull()).select(words.alias("w")).where(F.size("w") > 0)
    pairs = rows.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b")))).toDF("a", "b")
    both = pairs.select(F.explode(F.array(F.xxhash64("a"), F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")))).alias("code")).where("code IS NOT NULL")
    some = codes.select("code").distinct()
    if some.count() <= listed:
        both = both.join(F.broadcast(some), "code", "left_semi")  # its size is checked
    counts = both.groupBy("code").agg(F.count("*").alias("seen"))
    return codes.join(counts, "code").select("pattern", "seen")


def trusted_patterns(docs: DataFrame, text_col: str, spans: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that may mark identifiers.

    A pattern's confidence is the sum of the confidence of the known identifiers in it, over all
    occurrences of its words, times d / (d + ``HALF``) for d different ones. An identifier that is no
    seed gets 1 - prod(1 - c) over its trusted patterns, and is known from ``LEAST_CONFIDENCE`` on.
    """
    first = written(graph(spans))
    least = LEAST_CONFIDENCE * HALF / (1 - LEAST_CONFIDENCE)  # with fewer different ones none can be trusted
    wanted = written(first.groupBy("pattern", "kind").agg(F.count("*").alias("d"), F.sum("n").alias("slots")).where(F.col("d") >= least).drop("d"))
    nothing = wanted.select("pattern", "kind", F.lit(0.0).alias("confidence")).where("false")
    if wanted.isEmpty():
        return nothing
    seen = occurrences(docs, text_col, wanted.select("pattern").distinct())
    room = written(wanted.join(seen, "pattern", "left").select("pattern", "kind", F.greatest("slots", F.coalesce("seen", F.lit(0))).alias("seen")))
    edges = written(first.join(room, ["pattern", "kind"]))
    dropped(first, wanted, room)
    seeds = edges.where("seed > 0").groupBy("kind", "v").agg(F.max("seed").alias("c"))
    value, pattern, made = seeds, nothing, []
    for _ in range(TURNS):
        support = edges.join(value.where(F.col("c") >= LEAST_CONFIDENCE), ["kind", "v"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("c")).alias("good"), F.count("*").alias("d"), F.max("seen").alias("seen"))
        pattern = support.select("pattern", "kind", (F.col("good") / F.col("seen") * F.col("d") / (F.col("d") + HALF)).alias("confidence"))
        pattern = written(pattern.where(F.col("confidence") >= LEAST_CONFIDENCE))
        made.append(pattern)
        miss = F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))))
        value = edges.join(pattern, ["pattern", "kind"]).groupBy("kind", "v").agg((1 - miss).alias("c")).unionByName(seeds).groupBy("kind", "v").agg(F.max("c").alias("c"))
    dropped(edges, *made[:-1])
    return pattern


def span(s: Column, e: Column, kind: Column, base: bool) -> Column:
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind).cast("int")
    return F.struct(s.cast("int").alias("s"), order.alias("order"), e.cast("int").alias("e"), kind.alias("kind"), F.lit(base).alias("base"))


def discovered(spans: DataFrame, trusted: DataFrame) -> DataFrame:
    """(id2, h2, more): the spans that trusted patterns add to each row that has any."""
    loose = spans.select("id", "h", F.explode("other").alias("x")).select("id", "h", "x", F.explode(patterns_of(F.col("x"))).alias("pattern")).join(trusted, "pattern")
    loose = loose.where(F.array_contains(fitting(F.col("x.v")), F.col("kind")))
    best = loose.groupBy("id", "h", F.col("x.s").alias("s"), F.col("x.e").alias("e")).agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    more = best.groupBy("id", "h").agg(F.collect_list(span(F.col("s"), F.col("e"), F.col("kind"), False)).alias("more"))
    return more.withColumnsRenamed({"id": "id2", "h": "h2"})


def joined(base: DataFrame, more: DataFrame) -> DataFrame:
    """``base`` with ``spans``: its own and the discovered ones, by place and kind."""
    of_kind = lambda k: F.transform(k, lambda x: span(x["s"], x["e"], F.lit(k), True))
    own = F.flatten(F.array(*map(of_kind, KINDS)))
    both = base.withColumn("own", own).join(more, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    none = F.array().cast("array<struct<s:int,order:int,e:int,kind:string,base:boolean>>")
    return both.withColumn("spans", F.array_sort(F.concat(F.col("own").cast("array<struct<s:int,order:int,e:int,kind:string,base:boolean>>"), F.coalesce("more", none))))


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, spans array<struct<s, order, e, kind, base>>) of every row of ``docs``, by place and kind.

    A null text is empty. Base spans are the valid leftmost matches of each kind; discovered ones
    (``base`` false) overlap none of them, and one in a trusted pattern of several kinds is of that
    with most confidence. Repeated rows stay, null ids too; only the two named
    columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = written(base_spans(rows).drop("text"))
    more = discovered(spans, trusted_patterns(docs, text_col, spans))
    return joined(spans, more).select(F.col("id").alias(id_col), "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``."""
    base = F.filter("spans", lambda x: x["base"])
    found = find(docs, text_col, id_col).select(id_col, base.alias("base"), "spans")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; all columns and rows stay.

    Where spans overlap, what an earlier one doesn't cover goes without a mark of its own. A text
    without spans, null and empty ones too, stays as it is.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = written(base_spans(rows))
    more = discovered(spans, trusted_patterns(docs, text_col, spans))
    both = joined(spans.drop("other"), written(more))

    def step(t: Column, x: Column) -> Column:
        kept = F.when(x["s"] >= t["at"], F.concat(F.substring(F.col("text"), t["at"] + 1, x["s"] - t["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(t["out"], kept).alias("out"), F.greatest(t["at"], x["e"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("spans", start, step, lambda t: F.concat(t["out"], F.substring(F.col("text"), t["at"] + 1, F.length("text"))))
    cols = [F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return both.select(*cols)
