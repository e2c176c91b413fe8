"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

One weight vector serves all grades: P(grade <= k) = sigmoid(threshold_k - w.x), with ordered
thresholds. The features are the words of a text and their beginnings (4 to 8 letters), hashed,
with damped counts of unit norm; each is scaled by the log-odds of its presence in graded texts, so
that rare chance words don't outweigh telling ones. The model is fitted on a sample of labelled
rows that is bounded by a parameter; all texts are graded by the expected grade.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import in_batches, keeps, texts

#: Labelled rows that the model is fitted on, about; the only sample here.
SAMPLE_ROWS = 12_000
#: Hashed features.
FEATURES = 1 << 20
#: Weight of the squared weights in the loss.
RIDGE = 1e-4
#: Texts of the sample that a feature must be in, and the log-odds below which it doesn't count.
LEAST_TEXTS, LEAST_ODDS = 3, 1.0
#: Norm of a text's features.
NORM = 10.0
#: Features of a word: itself and its beginnings of so many letters.
BEGINNINGS = (4, 5, 6, 7, 8)
CACHE_WORDS = 500_000

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_words: dict[bytes, bytes] = {}


def word_features(word: bytes) -> bytes:
    """Hashes of a word and its proper beginnings, as signed 32-bit numbers; -1 where there is none."""
    text = word.decode(errors="replace")
    found = [zlib.crc32(word) & (FEATURES - 1)] + [zlib.crc32(text[:k].encode(), k) & (FEATURES - 1) if len(text) > k else -1 for k in BEGINNINGS]
    value = np.array(found, dtype="<i4").tobytes()
    if len(word) <= 48:
        if len(_words) >= CACHE_WORDS:
            _words.clear()
        _words[word] = value
    return value


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a text: log(1 + count), scaled to the common norm."""
    keeps(__name__, _words.clear)
    count = Counter(raw.lower().translate(_WORD_BYTES).split())
    get = _words.get
    at = np.frombuffer(b"".join([get(w) or word_features(w) for w in count]), dtype="<i4")
    times = np.repeat(np.fromiter(count.values(), dtype=np.float64, count=len(count)), 1 + len(BEGINNINGS))
    at, of = np.unique(at, return_inverse=True)
    value = np.log1p(np.bincount(of, weights=times, minlength=len(at)))
    at, value = at[at >= 0], value[at >= 0]
    return at, value * (NORM / np.sqrt((value * value).sum()) if len(value) else 1.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def contrast(at: np.ndarray, row: np.ndarray, grade: np.ndarray, size: int = FEATURES) -> np.ndarray:
    """Each feature's scale: the log-odds of texts over grade 0 to have it, less ``LEAST_ODDS``."""
    over = (grade > 0).astype(np.float64)
    yes, all_ = np.bincount(at, weights=over[row], minlength=size), np.bincount(at, minlength=size)
    odds = np.log((yes + 0.5) / (over.sum() + 1)) - np.log((all_ - yes + 0.5) / (len(grade) - over.sum() + 1))
    return np.where(all_ >= LEAST_TEXTS, np.sign(odds) * np.maximum(0.0, np.abs(odds) - LEAST_ODDS), 0.0)


def fit(at: np.ndarray, row: np.ndarray, value: np.ndarray, grade: np.ndarray, levels: int, size: int = FEATURES, ridge: float = RIDGE, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch gradient steps with per-weight rates (Adam).

    ``at``, ``row`` and ``value`` list the features of each row. Thresholds are a first one and
    positive gaps.
    """
    n = len(grade)
    used, at = np.unique(at, return_inverse=True)
    w, cut = np.zeros(len(used)), np.concatenate([[1.0], np.zeros(levels - 2)])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cut), np.zeros_like(cut)]
    for t in range(1, rounds + 1):
        theta = cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        z = np.bincount(row, weights=w[at] * value, minlength=n)
        up, low = sigmoid(edge[grade + 1] - z), sigmoid(edge[grade] - z)
        up, low = np.where(grade == levels - 1, 1.0, up), np.where(grade == 0, 0.0, low)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        dz = (du - dl) / n  # of the loss by z
        gw = np.bincount(at, weights=dz[row] * value, minlength=len(used)) + 2 * ridge * w
        gt = np.array([-(du[grade == k].sum() - dl[grade == k + 1].sum()) / n for k in range(levels - 1)])
        gc = np.concatenate([[gt.sum()], [gt[k:].sum() * np.exp(cut[k]) for k in range(1, levels - 1)]])
        for k, (x, g) in enumerate(((w, gw), (cut, gc))):
            m, v = state[2 * k], state[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        np.clip(cut[1:], -5, 3, out=cut[1:])
    full = np.zeros(size)
    full[used] = w
    return full, cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])


def grade_chances(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade = k) of each row."""
    below = np.concatenate([np.zeros((len(z), 1)), sigmoid(theta[None, :] - z[:, None]), np.ones((len(z), 1))], axis=1)
    return np.diff(below, axis=1)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", levels: int = 3, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """The model of a bounded sample of labelled rows; None if there is nothing to learn from.

    The sample is a share of the label ids by hash, so it doesn't depend on partitions, and its ids
    and grades are few enough to be broadcast to the scan of the texts. A text with several labels
    has the highest of them.
    """
    known = labels.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("grade").cast("int").alias("grade"))
    share = min(1.0, sample_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))

    @in_batches
    def run(batch):
        found = [features(x) for x in texts(batch.column(1))]
        return {"grade": batch.column(0), "f": pa.array([a for a, _ in found], pa.list_(pa.int32())), "x": pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))}

    def learn(t):
        f, grade = t["f"].combine_chunks(), t["grade"].to_numpy()
        sizes = np.diff(f.offsets.to_numpy())
        grade = np.clip(grade, 0, levels - 1)
        at, row, value = f.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), t["x"].combine_chunks().flatten().to_numpy().astype(np.float64)
        scale = contrast(at, row, grade)
        kept = scale[at] != 0
        at, row, value = at[kept], row[kept], value[kept]
        w, theta = fit(at, row, value * scale[at], grade, levels)
        w *= scale
        return pa.table({"w": pa.array([w], pa.list_(pa.float64())), "theta": pa.array([theta], pa.list_(pa.float64()))})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    fitted = rows.select("grade", "text").mapInArrow(run, "grade int, f array<int>, x array<float>").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "w array<double>, theta array<double>").first()
    return (np.array(fitted.w), np.array(fitted.theta)) if fitted else None


def grade_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", levels: int = 3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, severity, grade, p_toxic, toxic) of every row of ``docs``.

    ``severity`` is the expected grade, ``grade`` the likeliest, ``toxic`` whether a grade over 0
    has a chance of at least a half. ``labels`` has the id and a ``grade`` from 0 to levels - 1;
    rows with a null in either don't count. A null or empty text has no features and is graded by
    the thresholds alone. Without any labelled text every severity is 0. Repeated rows stay; only
    the named columns are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col, id_col, levels, sample_rows))

    @in_batches
    def run(batch):
        if model.value is None:
            p = np.tile([1.0] + [0.0] * (levels - 1), (batch.num_rows, 1))
        else:
            w, theta = model.value
            p = grade_chances(np.array([w[a] @ v for a, v in map(features, texts(batch.column(1)))]), theta)
        over = 1 - p[:, 0]
        return {"id": batch.column(0), "severity": pa.array(p @ np.arange(levels)), "grade": pa.array(p.argmax(axis=1).astype(np.int32)), "p_toxic": pa.array(over), "toxic": pa.array(over >= 0.5)}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)
