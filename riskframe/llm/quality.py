"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's terms are trigrams of character classes (so they hold for any language and vocabulary) and
buckets of how much its words and lines repeat. Terms are weighted by log frequency and inverse
document frequency and projected on the leading singular directions of a bounded labelled sample
(``SAMPLE`` documents of each class). The labelled vectors are broadcast (their size is fixed by the
bound); every document's cosine with every one of them is computed exactly in blocks, and its
``NEIGHBOURS`` nearest vote with their labels, weighted by similarity.

Rows: null text counts as empty; an empty text has no terms, so all neighbours are equally far and
its score is the sample's share of label 1. Repeated rows get equal scores. A null doc_id is never
learned from and is not held out. Columns other than doc_id and text are ignored. Without any
usable label every score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_fold, labelled_ids, pieces, utf8_buffers

#: Labelled documents of each class that the model keeps at most.
SAMPLE = 2_000
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
#: Documents whose cosines are computed at once.
BLOCK = 512
#: Character classes: 0 a-z, 1 A-Z, 2 digit, 3 blank, 4 line end, 5 full stop, 6 comma, 7 ! and ?,
#: 8 quotes and brackets, 9 other marks, 10 letters beyond ASCII, 11 control characters.
CLASSES = 12
REPEATS = 10
TERMS = CLASSES ** 3 + 4 * REPEATS


def _byte_classes() -> np.ndarray:
    c = np.full(256, 10, np.uint16)
    c[:128] = 9
    c[:32], c[127] = 11, 11
    c[ord("a"):ord("z") + 1], c[ord("A"):ord("Z") + 1], c[ord("0"):ord("9") + 1] = 0, 1, 2
    for i, marks in ((3, " \t"), (4, "\n\r"), (5, "."), (6, ","), (7, "!?"), (8, "'\"()[]{}")):
        c[[ord(x) for x in marks]] = i
    return c


BYTE_CLASS = _byte_classes()
CONTINUATION = (np.arange(256) & 0xC0) == 0x80


def _share_bucket(share: float) -> int:
    return min(REPEATS - 1, int(share * REPEATS))


def features(column) -> np.ndarray:
    """Term counts (documents x TERMS) of whole texts."""
    data, offsets = utf8_buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    for i, text in enumerate(column.to_pylist()):
        part = data[offsets[i]:offsets[i + 1]]
        if not len(part):
            continue
        c = BYTE_CLASS[part[~CONTINUATION[part]]].astype(np.int64)
        if len(c) > 2:
            grams = c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:]
            out[i, :CLASSES ** 3] = np.bincount(grams, minlength=CLASSES ** 3)
        words = text.split()
        lines = text.split("\n")
        if words:
            # each share is one term, as heavy as a frequent trigram
            weight, base = max(4, len(words)), CLASSES ** 3
            out[i, base + _share_bucket(1 - len(set(words)) / len(words))] = weight
            out[i, base + REPEATS + _share_bucket(sum(map(str.__eq__, words, words[1:])) / len(words))] = weight
            out[i, base + 2 * REPEATS + _share_bucket(1 - len(set(lines)) / len(lines))] = weight
            halves = words[len(words) // 2:]
            out[i, base + 3 * REPEATS + _share_bucket(len(set(halves) & set(words[:len(words) // 2])) / max(1, len(set(halves))))] = weight
    return out


def fit(sample: DataFrame) -> dict:
    """The model of a bounded sample (text, y): weights, directions, unit vectors and labels."""
    def run(batches):
        for b in pieces(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "x": pa.array(list(x), pa.list_(pa.float32()))})

    got = sample.select("text", "y").mapInArrow(run, "y int, x array<float>").toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    if not len(y):
        return {"y": y}
    x = np.stack([np.asarray(v.values if hasattr(v, "values") else v, np.float32) for v in got.column("x")])
    order = np.lexsort((y, *x.T[::-1][-64:]))  # the same sample gives the same model, whatever its order
    x, y = x[order], y[order]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    w = _unit(np.log1p(x) * idf)
    # right singular directions from the Gram matrix of the terms
    values, vectors = np.linalg.eigh((w.T @ w).astype(np.float64))
    directions = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    return {"y": y, "idf": idf.astype(np.float32), "directions": directions, "vectors": _unit(w @ directions)}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def vote(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of term counts ``x``."""
    y = model["y"]
    if not len(y):
        return np.full(len(x), 0.5)
    out = np.full(len(x), y.mean())
    k = min(NEIGHBOURS, len(y))
    for at in range(0, len(x), BLOCK):
        block = x[at:at + BLOCK]
        some = block.any(axis=1)
        v = _unit(_unit(np.log1p(block) * model["idf"]) @ model["directions"])
        cosine = v @ model["vectors"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 1e-3, 1).astype(float) ** SHARPNESS
        score = (weight * y[near]).sum(1) / weight.sum(1)
        out[at:at + BLOCK][some] = score[some]
    return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> dict:
    """Fit on labelled documents outside the held-out fold."""
    ids = labelled_ids(docs, labels, label, per_class)
    return fit(docs.join(F.broadcast(ids), "doc_id").select("text", "y"))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3,
                  per_class: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(base, labels, label, per_class))

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"),
                                              "score": pa.array(vote(model.value, features(b.column("text"))), pa.float64())})

    return base.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
