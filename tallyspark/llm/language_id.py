"""Language identification with a blended-spectrum string kernel, Nyström landmarks and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

UNDETERMINED = "und"
#: Lengths of the character n-grams whose presence is compared, and the hash buckets that stand for them.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
#: Texts learned from per language, and those of them that serve as landmarks.
PER_LANGUAGE = 200
LANDMARKS_PER_LANGUAGE = 24
RIDGE = 1e-2
#: Steepness with which regression values become probabilities.
SHARPNESS = 4.0
_ROWS = 128


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # presence of every bucket in each landmark, scaled to norm 1
    weights: np.ndarray  # landmarks x languages

    def scores(self, presence: np.ndarray) -> np.ndarray:
        """Probability of each language for rows of presence (0 or 1)."""
        norms = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
        values = (presence @ self.landmarks.T / norms) @ self.weights
        values = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
        return values / values.sum(axis=1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def set_presence(text: str, row: np.ndarray) -> None:
    """Mark the buckets of all n-grams of a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.zeros(len(points) + 1, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code = code[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        if not len(code):
            return
        if n in ORDERS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
            row[mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)] = 1


def fit(samples: DataFrame, seed_col: str = "draw") -> LanguageModel:
    """Learn from (lang, draw, packed), a bounded sample; see `learning_sample`."""
    rows = sorted((r["lang"], r[seed_col], bytes(r["packed"])) for r in samples.collect())
    languages = sorted({lang for lang, *_ in rows})
    if not languages:
        return LanguageModel([], np.zeros((1, BUCKETS), np.float32), np.zeros((1, 0), np.float32))
    x = np.stack([np.unpackbits(np.frombuffer(p, np.uint8)) for *_, p in rows]).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    y = np.array([[1.0 if lang == wanted else -1.0 for wanted in languages] for lang, *_ in rows])
    seen: dict[str, int] = {}
    chosen = []
    for i, (lang, *_) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= LANDMARKS_PER_LANGUAGE:
            chosen.append(i)
    landmarks = x[chosen]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    sound = values > 1e-6 * values.max()
    root = vectors[:, sound] / np.sqrt(values[sound])  # landmark kernel to the power -1/2
    z = (x @ landmarks.T).astype(np.float64) @ root
    solved = np.linalg.solve(z.T @ z + RIDGE * len(rows) * np.eye(z.shape[1]), z.T @ y)
    return LanguageModel(languages, landmarks, (root @ solved).astype(np.float32))


def learning_sample(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str, folder: str) -> DataFrame:
    """Up to PER_LANGUAGE rows of every language in hash order, as packed presence bits of the whole texts.

    Ranking sees ids and languages only; the rows chosen number PER_LANGUAGE per language at most.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    ranked = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang")).withColumn(
        "draw", F.xxhash64("id")
    )
    by_hash = W.partitionBy("lang").orderBy("draw", "id")
    chosen = ranked.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= PER_LANGUAGE)
    chosen = store.staged(chosen.select("id", "lang", "draw").distinct(), folder, "chosen")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))
    few = chosen.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), "draw")
    texts = named.join(F.broadcast(few) if chosen.count() <= 100_000 else few, same)
    return texts.select("lang", "draw", "text").mapInArrow(_packed, "lang string, draw long, packed binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for text in batch.column(2).to_pylist():
            row = np.zeros(BUCKETS, np.uint8)
            if text:
                set_presence(text, row)
            bits.append(np.packbits(row).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["lang", "draw", "packed"])


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2
) -> DataFrame:
    """One row per row of `docs`: id, held_out, lang_pred, score.

    The kernel of two texts counts the character n-grams (1 to 3, lower-cased, hashed to 16,384 buckets) present in
    both, scaled to 1 for a text with itself. Landmarks from every language give Nyström features, and one ridge
    regression per language learns on a bounded sample of rows with a language whose crc32(id) mod `folds` is not
    `held_fold`. Whole texts are scored in batches by two matrix products.

    `und` with score 1 where the text is NULL or has no letter, `und` with score 0 where nothing could be learned; ids
    that are NULL hash as the empty text. Ties between languages go to the first in code point order. Repeated rows are
    each scored alike; other columns are ignored.
    """
    folder = common.scratch(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    model = fit(learning_sample(docs, fold != held_fold, id_col, text_col, lang_col, folder))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold == held_fold).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scorer(shared), "id long, held_out boolean, lang_pred string, score double")
    return scored.withColumnRenamed("id", id_col)


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        presence = np.empty((_ROWS, BUCKETS), np.float32)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = batch.column(2).to_pylist()
                lettered = [i for i, t in enumerate(texts) if has_letter(t)]
                languages, scores = [UNDETERMINED] * len(texts), [1.0] * len(texts)
                if lettered and model.languages:
                    presence[: len(lettered)] = 0
                    for k, i in enumerate(lettered):
                        set_presence(texts[i], presence[k])
                    found = model.scores(presence[: len(lettered)])
                    for i, p in zip(lettered, found):
                        languages[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
                elif lettered:
                    for i in lettered:
                        scores[i] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                    ["id", "held_out", "lang_pred", "score"],
                )

    return score
