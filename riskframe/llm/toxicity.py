"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from
document labels alone.

A sentence's score is a logistic function of the telling words it holds; a document is toxic unless
every sentence is innocent: 1 - prod(1 - p); a sentence without telling words is innocent. Telling words are found on a bounded labelled sample
(``SAMPLE`` documents of each class): words of at least ``LEAST`` documents whose shares of the two
classes differ by more than ``TELLING`` standard errors, at most ``WORDS``. Weights are learned by
gradient steps on the document likelihood, so no sentence label is needed, and the model then points
at the offending sentences.

Sentences end at . ! ? or a line end and are cut every ``LONG`` words, so a text without any stop is
scored in pieces, not dropped. Words are lower-cased and freed of ASCII marks at both ends; the first
letters of a longer word (``STEMS``) count as a word of their own, so inflected forms share evidence.

Rows: null text counts as empty; a text without words scores 0. Repeated rows get equal scores. A
null doc_id is never learned from and is not held out. Columns other than doc_id and text are
ignored. Without labels of both classes nothing is telling and every score is 0. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_fold, labelled_ids, materialize

#: Labelled documents of each class that the model sees at most.
SAMPLE = 3_000
LEAST = 4
TELLING = 6.0
WORDS = 4_096
LONG = 40
STEMS = (4, 5, 6)
#: Spellings whose telling words a worker remembers.
CACHE = 100_000
STEPS = 300
PENALTY = 1e-3
END = re.compile(r"[.!?\n]+")
MARKS = string.punctuation


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points."""
    out, at = [], 0
    for stop in (*(m.end() for m in END.finditer(text)), len(text)):
        if stop > at:
            words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[at:stop])] if stop - at > 2 * LONG else []
            if len(words) > LONG:
                cuts = [at + words[i][0] for i in range(LONG, len(words), LONG)]
                out += list(zip([at, *cuts], [*cuts, stop], strict=True))
            else:
                out.append((at, stop))
        at = stop
    return out


def spellings(text: str) -> set[str]:
    """Distinct lower-cased words of the text's sentences: a stop ends a word too."""
    return set(END.sub(" ", text.lower()).split())


def forms(spelling: str) -> list[str]:
    """A spelling's word and its stems (marked by *)."""
    word = spelling.strip(MARKS)
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)] if word else []


class TellingWords(dict):
    """Spelling -> numbers of its telling words; forgets all when ``CACHE`` spellings are known."""

    def __init__(self, words: list[str]):
        self.number = {w: i for i, w in enumerate(words)}

    def __missing__(self, spelling: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = self[spelling] = tuple(self.number[f] for f in forms(spelling) if f in self.number)
        return found

    def hits(self, text: str) -> list[tuple[int, int, list[int]]]:
        """(start, end, telling words) of the sentences that hold any."""
        if not any(self[w] for w in spellings(text)):
            return []
        out = []
        for start, end in sentences(text):
            found = {i for w in spellings(text[start:end]) for i in self[w]}
            if found:
                out.append((start, end, sorted(found)))
        return out


def telling_words(sample: DataFrame) -> list[str]:
    """Words of a sample (text, y) whose shares of documents differ between the classes."""
    def words(frames):
        for f in frames:
            for y, text in zip(f["y"], f["text"], strict=True):
                found = {x for w in spellings(text or "") for x in forms(w)}
                if found:
                    yield pd.DataFrame({"y": np.int32(y), "word": list(found)})

    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(size) < 2:
        return []
    counts = (sample.select("y", "text").mapInPandas(words, "y int, word string").groupBy("word")
              .agg(F.sum(F.col("y").cast("double")).alias("pos"), F.sum(1.0 - F.col("y")).alias("neg")))
    p, q = F.col("pos") / size[1], F.col("neg") / size[0]
    pooled = (F.col("pos") + F.col("neg") + 1) / (size[0] + size[1] + 2)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / size[0] + 1 / size[1]))
    top = counts.where(F.col("pos") + F.col("neg") >= LEAST).withColumn("z", z).where(F.abs("z") >= TELLING)
    return sorted(r["word"] for r in top.orderBy(F.abs("z").desc(), "word").limit(WORDS).collect())


def learn(hits: list[list[list[int]]], y: np.ndarray, n_words: int) -> tuple[np.ndarray, float]:
    """Word weights and bias by Adam on the noisy-or likelihood of the documents.

    ``hits[d]`` lists the telling words of each sentence of document d that has any; the other
    sentences are innocent, so a text's length alone says nothing.
    """
    flat = [(d, s) for d, doc in enumerate(hits) for s in doc]
    doc = np.array([d for d, _ in flat], np.int64)
    row = np.concatenate([np.full(len(s), i) for i, (_, s) in enumerate(flat)]).astype(np.int64) if flat else np.zeros(0, np.int64)
    col = np.concatenate([np.asarray(s) for _, s in flat]).astype(np.int64) if flat else np.zeros(0, np.int64)
    x = np.concatenate([np.full(n_words, 2.0), [-9.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    log1m = lambda z: -np.logaddexp(0, z)  # log(1 - sigmoid(z))
    for step in range(1, STEPS + 1):
        w, b = x[:-1], x[-1]
        z = b + np.bincount(row, w[col], minlength=len(flat))
        innocent = np.bincount(doc, log1m(z), minlength=len(hits))  # log(1 - P)
        innocent = np.minimum(innocent, -1e-12)
        # d loss / d innocent, with loss = -y log(1 - exp(innocent)) - (1 - y) innocent
        g = np.where(y == 1, np.exp(innocent) / -np.expm1(innocent), -1.0)
        s = lambda t: 1 / (1 + np.exp(-t))
        dz = g[doc] * -s(z)
        grad = np.concatenate([np.bincount(col, dz[row], minlength=n_words), [dz.sum()]])
        grad = grad / len(hits) + PENALTY * np.concatenate([w, [0]]) / 10
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        x = x - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> dict:
    """{"words", "weights", "bias"} of the labelled documents outside the held-out fold."""
    ids = labelled_ids(docs, labels, label, per_class)
    sample = materialize(docs.join(F.broadcast(ids), "doc_id").select("text", "y"))
    words = telling_words(sample)
    if not words:
        return {"words": [], "weights": np.zeros(0), "bias": -50.0}

    def run(frames):
        known = TellingWords(words)
        for f in frames:
            out = [known.hits(t or "") for t in f["text"]]
            yield pd.DataFrame({"y": f["y"].astype("int32"), "hits": [[h[2] for h in hits] for hits in out]})

    got = sample.mapInPandas(run, "y int, hits array<array<int>>").collect()
    got.sort(key=lambda r: (r["y"], r["hits"]))
    weights, bias = learn([r["hits"] for r in got], np.array([r["y"] for r in got]), len(words))
    return {"words": words, "weights": weights, "bias": bias}


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5,
                   per_class: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` but clashing ones, with held_out, score, predicted and ``offending``:
    (start, end, score) in code points of each sentence that alone reaches the threshold."""
    docs = bounded_batches(docs).drop("held_out", "score", "predicted", "offending", "found")
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels, label, per_class))

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        known = TellingWords(m["words"])
        for texts in batches:
            yield scored(texts, m, known)

    def scored(texts, m, known):
        scores, found = [], []
        for text in texts:
            hits = known.hits(text or "")
            z = [m["bias"] + m["weights"][h[2]].sum() for h in hits]
            scores.append(-np.expm1(-float(np.logaddexp(0, z).sum())))
            p = 1 / (1 + np.exp(-np.array(z)))
            found.append([{"start": h[0], "end": h[1], "score": float(s)} for h, s in zip(hits, p, strict=True) if s >= threshold])
        return pd.DataFrame({"score": np.clip(scores, 0.0, 1.0), "offending": found})

    return (docs.withColumn("found", judge(F.col("text").cast("string"))).select(
        *docs.columns, in_fold(F.col("doc_id")).alias("held_out"), F.col("found.score").alias("score"),
        (F.col("found.score") >= threshold).cast("int").alias("predicted"), F.col("found.offending").alias("offending")))
