"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

#: Documents learned from per label, and the most lines one of them may have.
PER_LABEL = 1500
MOST_LINES = 400
#: Gradient steps of the line model and of the field.
STEPS = 300
_L2 = 1e-3

# Classes of bytes: lower case, upper case, digit, blank, sentence mark, other ASCII mark, part of another character.
_CLASSES = 7
_CLASS_OF = np.full(256, 6, np.uint8)
_CLASS_OF[:128] = 5
_CLASS_OF[ord("a") : ord("z") + 1] = 0
_CLASS_OF[ord("A") : ord("Z") + 1] = 1
_CLASS_OF[ord("0") : ord("9") + 1] = 2
_CLASS_OF[[ord(c) for c in " \t\r\v\f"]] = 3
_CLASS_OF[[ord(c) for c in ".,;:?'\"()-"]] = 4
#: Features of one line; each line also sees those of the line before and after it.
OWN = _CLASSES + 6
FEATURES = 3 * OWN + 3


@dataclass
class LineField:
    weights: np.ndarray  # of the label good over bad, per feature
    moves: np.ndarray  # 2 x 2, from label to label
    slope: float
    offset: float

    def score(self, share: np.ndarray) -> np.ndarray:
        """Document score from the length-weighted share of good lines."""
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.offset)))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and weight (bytes) of every line of some texts, and the number of lines of each text."""
    split = [t.split(b"\n") for t in texts]
    counts = np.array([len(lines) for lines in split], np.int64)
    lines = [line for each in split for line in each]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer(b"".join(lines), np.uint8)
    owner = np.repeat(np.arange(len(lines)) * _CLASSES, lengths)
    kinds = np.bincount(owner + _CLASS_OF[flat], minlength=len(lines) * _CLASSES).reshape(-1, _CLASSES).astype(np.float32)
    own = np.zeros((len(lines), OWN), np.float32)
    size = np.maximum(lengths, 1)
    own[:, :_CLASSES] = kinds / size[:, None]
    own[:, _CLASSES] = np.log1p(lengths) / 8
    own[:, _CLASSES + 1] = np.minimum(size / (kinds[:, 3] + 1), 40) / 20  # bytes a word
    full = lengths > 0
    ends = np.cumsum(lengths)
    if full.any():
        own[full, _CLASSES + 2] = _CLASS_OF[flat[ends[full] - 1]] == 4
        own[full, _CLASSES + 3] = _CLASS_OF[flat[ends[full] - lengths[full]]] == 1
    own[:, _CLASSES + 4] = ~full
    own[:, _CLASSES + 5] = np.minimum(kinds[:, 5] / (kinds[:, 3] + 1), 4) / 4  # marks a word
    x = np.zeros((len(lines), FEATURES), np.float32)
    first = np.zeros(len(lines), bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    last = np.roll(first, -1)
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = np.where(first[1:, None], 0, own[:-1])
    x[:-1, 2 * OWN : 3 * OWN] = np.where(last[:-1, None], 0, own[1:])
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return x, lengths + 1, counts


def marginals(field: LineField, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that each line is good, by forward and backward passes over each text."""
    gain = np.exp(np.clip(x @ field.weights, -30, 30)).tolist()
    (t00, t01), (t10, t11) = np.exp(field.moves).tolist()
    out = np.empty(len(gain))
    start = 0
    for n in counts.tolist():
        odds, r = [0.0] * n, 1.0
        for i in range(n):
            r = gain[start + i] * ((t01 + t11 * r) / (t00 + t10 * r) if i else 1.0)
            odds[i] = r
        s = 1.0
        for i in range(n - 1, -1, -1):
            o = odds[i] * s
            out[start + i] = o / (1 + o)
            s = (t10 + t11 * gain[start + i] * s) / (t00 + t01 * gain[start + i] * s)
        start += n
    return out


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]]) -> LineField:
    """Learn from (label, line features, line weights) of documents.

    A line model learns from document labels first. Lines of bad documents that it takes for good ones are relabelled, as
    a bad document also has clean lines; the field then learns weights and moves from the line labels, and a
    logistic curve maps the good share of a document to its label.
    """
    field = LineField(np.zeros(FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    if not samples:
        return field
    label = np.array([y for y, *_ in samples])
    counts = np.array([len(w) for *_, w in samples])
    x = np.concatenate([f for _, f, _ in samples]).astype(np.float64)
    weight = np.concatenate([w for *_, w in samples]).astype(np.float64)
    of_line = np.repeat(label, counts)
    even = weight * np.where(of_line == 1, 1 / max(1.0, weight[of_line == 1].sum()), 1 / max(1.0, weight[of_line == 0].sum()))
    w = np.zeros(FEATURES)
    for g in _ascent(w):
        p = 1 / (1 + np.exp(-x @ w))
        g[:] = x.T @ (even * (of_line - p)) - _L2 * w
    line = np.where((of_line == 0) & (x @ w > 0), 1, of_line)
    if len(set(line.tolist())) < 2:
        line = of_line
    _learn_field(field, x, line, counts)
    share = _shares(marginals(field, x, counts), weight, counts)
    logit = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    curve = np.array([1.0, 0.0])
    for g in _ascent(curve):
        miss = label - 1 / (1 + np.exp(-(curve[0] * logit + curve[1])))
        miss = miss * np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
        g[:] = [miss @ logit - _L2 * curve[0], miss.sum()]
    field.slope, field.offset = max(float(curve[0]), 1e-3), float(curve[1])
    return field


def _ascent(w: np.ndarray, steps: int = STEPS, rate: float = 0.1) -> Iterator[np.ndarray]:
    """Adam: the caller fills the gradient that is handed out, then `w` moves."""
    g, m, v = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        yield g
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)


def _learn_field(field: LineField, x: np.ndarray, line: np.ndarray, counts: np.ndarray) -> None:
    """Gradient of the conditional likelihood; documents advance together, one line at a time."""
    deep, docs = int(counts.max()), len(counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.minimum(begin[:, None] + np.arange(deep), len(x) - 1)
    live = np.arange(deep) < counts[:, None]
    y = np.where(live, line[at], 0)
    pairs = live[:, 1:]
    seen = np.array([[(pairs & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], np.float64)
    w = np.concatenate([field.weights, field.moves.ravel()])
    total = len(x)
    for g in _ascent(w):
        moves = np.exp(w[-4:].reshape(2, 2))
        emit = np.ones((docs, deep, 2))
        emit[:, :, 1] = np.exp(np.clip(x @ w[:-4], -30, 30))[at]
        ahead, behind = np.empty((docs, deep, 2)), np.ones((docs, deep, 2))
        ahead[:, 0] = emit[:, 0]
        for i in range(1, deep):
            a = (ahead[:, i - 1] @ moves) * emit[:, i]
            ahead[:, i] = a / a.sum(axis=1, keepdims=True)
        for i in range(deep - 2, -1, -1):
            b = (behind[:, i + 1] * emit[:, i + 1]) @ moves.T
            behind[:, i] = np.where(live[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        good = ahead * behind
        good = good[:, :, 1] / good.sum(axis=2)
        joint = ahead[:, :-1, :, None] * moves * (emit * behind)[:, 1:, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        expected = (joint * pairs[:, :, None, None]).sum(axis=(0, 1))
        g[:-4] = (x.T @ (line - good[live])) / total - _L2 * w[:-4]
        g[-4:] = ((seen - expected) / total).ravel() - _L2 * w[-4:]
    field.weights, field.moves = w[:-4].copy(), w[-4:].reshape(2, 2).copy()


def _shares(good: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)


def learning_sample(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, id_col: str, text_col: str, folder: str) -> DataFrame:
    """(id, label, text) of up to PER_LABEL labelled documents per label with MOST_LINES lines at most, in hash order.

    Ranking sees ids and labels only. The rows kept number 2 * PER_LABEL at most.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("quality").cast("int").alias("label")
    )
    short = docs.filter((fold != held_fold) & (F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit("\n")) < MOST_LINES))
    ranked = short.select(F.col(id_col).cast("long").alias("id")).distinct().join(known, F.col("id") == F.col("_id"))
    by_hash = W.partitionBy("label").orderBy("draw", "id")
    ranked = ranked.withColumn("draw", F.xxhash64("id")).withColumn("place", F.row_number().over(by_hash))
    chosen = store.staged(ranked.filter(F.col("place") <= PER_LABEL).select("_id", "label"), folder, "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "label", "text")  # 2 * PER_LABEL rows


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            x, weight, _ = line_features([text])
            out.append((x.astype("<f4").tobytes(), weight.astype("<i8").tobytes()))
        xs, ws = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(xs, pa.binary()), pa.array(ws, pa.binary())], ["id", "label", "x", "weight"]
        )


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted.

    Lines are described by their own shape and that of the lines around them; the field labels each good or
    bad, and the marginals, weighted by line length, give the document's good share and from it the score. It is learned
    on the driver from a bounded sample (see `learning_sample`) of labelled documents whose crc32(id) mod `folds` is
    not `held_fold`, as line features. `labels` has doc_id and quality; of several labels of a document the larger holds.

    Whole texts are scored, NULL and empty ones as one empty line. Without any labels every score is 0.5. NULL ids hash as the
    empty text. Repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    sample = learning_sample(docs, labels, folds, held_fold, id_col, text_col, folder)
    found = sample.mapInArrow(_described, "id long, label int, x binary, weight binary").collect()
    field = fit([
        (r["label"], np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES), np.frombuffer(r["weight"], "<i8"))
        for r in sorted(found, key=lambda r: (r["id"], r["label"], bytes(r["x"])))
    ])
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (fold == held_fold).alias("held_out"),
        F.coalesce(text_col, F.lit("")).cast("binary").alias("text"),
    )
    scored = rows.mapInArrow(_scorer(spark.sparkContext.broadcast(field)), "id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for whole in batches:
            for batch in common.pieces(whole, 2, 2_000_000):
                x, weight, counts = line_features(batch.column(2).to_pylist())
                scores = field.score(_shares(marginals(field, x, counts), weight.astype(np.float64), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["id", "held_out", "score"]
                )

    return score
