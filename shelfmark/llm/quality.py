"""Quality scores learnt from preference pairs (Bradley-Terry) over character-class features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import held_out, text_bytes, word_hashes

#: Labelled documents that learning reads of each label, at most; the ids with the least hashes.
LABELLED_PER_CLASS = 4000
#: Preference pairs drawn from them.
PAIRS = 40_000
#: Pairs whose feature differences the driver holds at once.
PAIRS_AT_ONCE = 4_000
PENALTY = 1e-3
ROUNDS = 25
#: The score that the chosen quantile of the raw scores is mapped to.
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    """Class of every byte: letters, digits, blanks, kinds of marks, parts of longer characters."""
    kind = np.full(256, 12, np.int64)  # control characters and whatever is not named below
    groups = ["", "", "", " \t", "\n\r", ".", ",;:", "!?", "'\"()-", "#$%&*+=<>@^~/\\_`", "|", "[]{}"]
    for i, marks in enumerate(groups):
        kind[[ord(c) for c in marks]] = i
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    kind[0x80:0xC0], kind[0xC0:] = 13, 14
    return kind


CLASSES = _classes()
KINDS = 15
WIDTH = KINDS * KINDS + 7
NOT_BLANK = np.where(np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), 0, np.arange(256)).astype(np.uint8)


def features(column: pa.Array) -> np.ndarray:
    """One row per text: shares of pairs of neighbouring byte classes, and a few word statistics."""
    data, places = text_bytes(column)
    words_of, first = word_hashes(data, places, NOT_BLANK)
    out = np.zeros((len(column), WIDTH))
    for i in range(len(column)):
        kinds = CLASSES[data[places[i] : places[i + 1]]]
        if not len(kinds):
            continue
        pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        blank = (kinds == 3) | (kinds == 4)
        words = max(1, int(first[i + 1] - first[i]))
        lines = int(np.count_nonzero(kinds == 4)) + 1
        hashes = words_of[first[i] : first[i + 1]]
        out[i, :-7] = np.sqrt(pairs / len(kinds))
        out[i, -7:] = (
            np.count_nonzero(hashes[1:] == hashes[:-1]) / words, np.count_nonzero(hashes[2:] == hashes[:-2]) / words,
            len(np.unique(hashes)) / words,
            np.log1p(words), np.log1p(np.count_nonzero(~blank) / words), np.log1p(words / lines),
            np.count_nonzero(kinds >= 13) / len(kinds),
        )
    return out


@dataclass(frozen=True)
class Model:
    """A linear raw score; ``least`` is the raw score at the chosen quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    least: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1; the chosen quantile of the raw scores lies at ``THRESHOLD``."""
        raw = ((x - self.mean) / self.scale * self.weights).sum(axis=1) - self.least
        return np.round(1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30))), 9)


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Model:
    """Weights by penalised logistic loss on feature differences of (better, worse) pairs.

    The quantile that becomes the threshold is the one with the best mean recall of the two
    labels among the raw scores of the sample. With no pair to learn from, every text scores
    ``THRESHOLD`` alike.
    """
    width = x.shape[1]
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    draw = np.random.default_rng(seed)
    left, right = draw.choice(better, PAIRS), draw.choice(worse, PAIRS)
    weights = np.zeros(width)
    for _ in range(ROUNDS):  # Newton steps; the penalty keeps separable pairs finite
        slope, bend = -PENALTY * weights, PENALTY * np.eye(width)
        for at in range(0, PAIRS, PAIRS_AT_ONCE):
            difference = z[left[at : at + PAIRS_AT_ONCE]] - z[right[at : at + PAIRS_AT_ONCE]]
            wins = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
            slope += difference.T @ (1 - wins) / PAIRS
            bend += (difference * (wins * (1 - wins))[:, None]).T @ difference / PAIRS
        step = np.linalg.solve(bend, slope)
        weights = weights + step * min(1.0, 5.0 / max(1e-9, float(np.linalg.norm(step))))
        if float(np.abs(step).max()) < 1e-8:
            break
    raw = z @ weights
    order = np.argsort(raw, kind="stable")
    lost = np.concatenate([[0], np.cumsum(good[order])]) / len(better)
    caught = np.concatenate([[0], np.cumsum(~good[order])]) / len(worse)
    at = int(np.argmax(caught - lost))
    ordered = raw[order]
    low, high = ordered[max(0, at - 1)], ordered[min(at, len(ordered) - 1)]
    return Model(mean, scale, weights, float((low + high) / 2))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, per_class: int = LABELLED_PER_CLASS) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Rows without id, without label or with a label other than 0 and 1 are not used. An id with
    several labels is used with each, and one with several rows with one of their texts.
    """
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"), modulus)).distinct()
    drawn = [
        known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for label in (0, 1)
    ]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Of several rows of one id the one with the least text hash, so that the sample is bounded in rows.
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    sample = texts.join(drawn[0].unionByName(drawn[1]), "doc_id").groupBy("doc_id", "quality").agg(least.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"],
            )

    kinds = {name: field.dataType.simpleString() for name, field in zip(sample.columns, sample.schema.fields)}
    rows = sample.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x array<double>").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, WIDTH)), np.zeros(0, bool))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    good = np.array(rows.column("quality").to_pylist()) == 1
    order = np.lexsort((*x.T[::16], good, np.array([str(v) for v in rows.column("doc_id").to_pylist()])))
    return fit(x[order], good[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ``score`` and ``predicted`` (1 from ``THRESHOLD`` on) of every whole text.

    A null text counts as empty; an empty text is scored like any other. Repeated rows score
    alike; columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``THRESHOLD``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(features(batch.column(at).fill_null(""))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
