"""Language identification by a string kernel.

The kernel of two texts counts the byte n-grams of lengths 1 to 3 (a blended spectrum) that are
present in both, over the root of the product of the two counts; n-grams that no landmark has
count for neither. Nyström landmarks stand for
the training texts, and one ridge regression for each language against the others is solved in the
landmarks' space. A batch of texts is scored by two matrix products: presence by landmarks'
presence, and kernel by weights.

Texts are folded first: A-Z as a-z, and each byte that is no letter of ASCII and no part of a longer
UTF-8 sequence as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanmark.llm.common import fresh, materialise, numbered
from gleanmark.llm.textvec import chunks, flat

GRAMS = 3
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: a code below 2 ** 25 for every n-gram, and the row it is in. A length's
    codes begin with a one, so that lengths don't meet."""
    folded = _FOLD[data].astype(np.int32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = folded
    for n in range(1, GRAMS + 1):
        if n > 1:
            code = (code[:-1] << 8) | folded[n - 1 :]
        if len(code) <= 0:
            return
        inside = row[: len(code)] == row[n - 1 :]
        yield code[inside] + (1 << 8 * n), row[: len(code)][inside]


def text_grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct n-gram codes of each text, by row."""
    data, offsets = flat(column)
    for r in range(len(column)):
        part = data[offsets[r] : offsets[r + 1]]
        found = [np.unique(c) for c, _ in grams(part, np.array([0, len(part)]))]
        yield r, np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # the landmarks' n-grams, sorted
    presence: np.ndarray  # n-grams by landmarks
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks by languages

    def place(self) -> np.ndarray:
        """A table from codes to places among the landmarks' n-grams, -1 for others."""
        table = np.full(1 << (8 * GRAMS + 1), -1, np.int32)
        table[self.codes] = np.arange(len(self.codes))
        return table

    def predict(self, counts: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language places and scores of texts, from their counts of n-grams and presence matrix."""
        kernel = present @ self.presence / np.sqrt(np.maximum(counts, 1)[:, None] * np.maximum(self.sizes, 1)[None, :])
        value = kernel @ self.weights
        odds = np.exp(4 * (value - value.max(axis=1, keepdims=True)))
        best = value.argmax(axis=1)
        return best, (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(best)), best]


def fit(docs: DataFrame, eligible: Column, per_language: int = 400, landmarks: int = 48, ridge: float = 1e-3, most_rows: int = 8000) -> Model | None:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang): ``per_language`` rows of each non-null
    lang among the ``eligible``, first by a hash of doc_id, and ``most_rows`` of them in all, as many of each
    language as there are. ``landmarks`` of them a language, and fewer where there are many languages, are
    landmarks. The sample's distinct n-grams, whole texts', reach the driver. None if no row can be learned from;
    rows that repeat count as often as they stand there. All n-grams of the landmarks are features.
    """
    row = fresh(docs, "row")
    usable = numbered(docs, row).where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Numbers alone are ranked, and each task passes on its own first rows only; then the texts are fetched.
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), row)
    chosen = usable.select("lang", "doc_id", row).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    picked = materialise(chosen.orderBy("place", "lang").limit(most_rows).select(row), "sample")
    ranked = usable.join(F.broadcast(picked), row, "left_semi").select("lang", "text", F.xxhash64("doc_id").alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes.tolist() for _, codes in text_grams(batch["text"])]
            yield pa.record_batch([batch["lang"], batch["draw"], pa.array(found, pa.list_(pa.int32()))], names=["lang", "draw", "grams"])

    rows = sorted(((r["lang"], r["draw"], np.array(r["grams"], np.int32)) for r in ranked.mapInArrow(run, "lang string, draw long, grams array<int>").collect()), key=lambda r: r[:2])
    rows = [r for r in rows if len(r[2])]
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    each = max(1, min(landmarks, most_rows // (8 * len(languages))))
    marks = [r for lang in languages for r in [x for x in rows if x[0] == lang][:each]]
    codes = np.unique(np.concatenate([r[2] for r in marks]))
    presence = np.zeros((len(codes), len(marks)), np.float32)
    for m, r in enumerate(marks):
        presence[np.searchsorted(codes, r[2][np.isin(r[2], codes)]), m] = 1
    model = Model(languages, codes, presence, presence.sum(axis=0), np.zeros((len(marks), len(languages)), np.float32))
    kernel = np.zeros((len(rows), len(marks)))
    for i, r in enumerate(rows):
        present = np.zeros(len(codes), np.float32)
        present[np.searchsorted(codes, r[2][np.isin(r[2], codes)])] = 1
        kernel[i] = present @ presence / np.sqrt(max(present.sum(), 1) * np.maximum(model.sizes, 1))
    between = presence.T @ presence / np.sqrt(np.maximum(np.outer(model.sizes, model.sizes), 1))
    goal = np.array([[1.0 if r[0] == lang else -1.0 for lang in languages] for r in rows])
    system = kernel.T @ kernel + ridge * len(rows) * between + 1e-8 * len(rows) * np.eye(len(marks))
    model.weights = np.linalg.solve(system, kernel.T @ goal).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text's language (``lang_pred``) and ``score`` (0 to 1) for each row of ``docs``.

    Only the text decides. A null text or one without a letter is ``und`` with score 0, and so is
    every text if there is no model. Whole texts are read; rows that repeat get the same answer.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return plain.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = pa.array([*model.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.place()
        for batch in batches:
            text = batch["text"]
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for start, end in chunks(text, 1 << 20):
                data, offsets = flat(text.slice(start, end - start))
                best, score = [], []
                # At most 256 texts a matrix, so that its size doesn't follow the texts'.
                for a in range(0, end - start, 256):
                    o = offsets[a : min(a + 256, end - start) + 1]
                    counts, present = np.zeros(len(o) - 1), np.zeros((len(o) - 1, len(own.codes)), np.float32)
                    for code, row in grams(data[o[0] : o[-1]], o - o[0]):
                        at = table[code]
                        known = at >= 0
                        present[row[known], at[known]] = 1
                    counts = present.sum(axis=1)
                    b, s = own.predict(counts, present)
                    best.append(b)
                    score.append(s)
                some = letters[start:end]
                best = np.where(some, np.concatenate(best), len(own.languages))
                yield pa.record_batch([batch["doc_id"].slice(start, end - start), names.take(pa.array(best)), pa.array(np.where(some, np.concatenate(score), 0.0).astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Documents that no model may learn from: the CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
