"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases level by level. Runs of one symbol become one symbol.
Deterministic coin tossing compares each symbol's name with its left neighbour's (lowest differing
bit) until names are tiny; a phrase starts where the tiny name is a local maximum. A boundary thus
depends on a few symbols around it only, and a phrase's new name is a hash of its symbols, so equal
substrings get the same phrases and names wherever they stand, but for a few at their ends. Phrases
of level 1, 2, 3 hold about 3, 8 and 24 code points.

A fingerprint keeps, of the names of levels ``FIRST`` to ``LAST``, the smallest hash of each of ``BINS``
bins (16 bits each, as hex). Its likeness to another is the share of bins, of those filled in either,
that are equal: it estimates how much of the texts' phrases is shared.

Whole batches of texts are parsed at once with array operations; a text's end always ends a phrase.

Rows: null text counts as empty; an empty text has an empty fingerprint, alike (1) to an empty one
only. Repeated rows have equal fingerprints. Null ids come after all others; rows of one id follow by
descending hash of the text. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, bounded_batches, mix64, shuffle_partitions

BINS = 64
FIRST, LAST = 2, 4
#: Rounds of coin tossing: 64-bit names, then at most 128, 14, 8, 6 values.
ROUNDS = 4
#: Code points parsed at once, about.
BATCH = 400_000
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LOW_BIT = np.array([(i & -i).bit_length() - 1 if i else 0 for i in range(256)], np.uint8)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((MULTIPLIER, INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def _differing_bit(v: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of nonzero 64-bit values."""
    return (np.frexp((v & (~v + np.uint64(1))).astype(np.float64))[1] - 1).astype(np.uint8)


def _tiny_names(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Names of a few values, different for neighbours; ``first`` marks the texts' first symbols."""
    x = np.empty_like(names)
    x[1:] = names[1:] ^ names[:-1]
    x[:1], x[first] = 1, 1
    x[x == 0] = 1
    bit = _differing_bit(x)
    label = (2 * bit + ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        v = np.empty_like(label)
        v[1:] = label[1:] ^ label[:-1]
        v[:1], v[first] = 1, 1
        bit = LOW_BIT[v]
        label = 2 * bit + ((label >> bit) & 1)
    return label


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (phrase names, positions of the texts' first phrases) of symbols and first positions."""
    n = len(names)
    start = np.empty(n, bool)
    start[1:] = names[1:] != names[:-1]
    start[first] = True
    if not start.all():  # runs of one symbol become one
        at = np.flatnonzero(start)
        runs = np.diff(at, append=n)
        first = np.searchsorted(at, first)
        names = names[at]
        long = runs > 1
        names[long] = mix64(names[long] * np.uint64(MULTIPLIER) + runs[long].astype(np.uint64))
        n = len(names)
    label = _tiny_names(names, first).astype(np.int8)
    top = np.zeros(n, bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    # the symbols at a text's ends have no neighbour there: its first one starts a phrase, its last none
    last = np.append(first[1:], n) - 1
    top[last] = False
    inner = first[first < n - 1] + 1
    top[inner] = False
    top[first] = True
    at = np.flatnonzero(top)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(names) * power[:n], dtype=np.uint64, out=sums[1:])
    ends = np.append(at[1:], n)
    phrase = mix64((sums[ends] - sums[at]) * inverse[at] + (ends - at).astype(np.uint64))
    return phrase, np.searchsorted(at, first)


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts x BINS) int32; -1 where a bin is empty."""
    out = np.full((len(texts), BINS), -1, np.int32)
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= BATCH):
            total += len(texts[end])
            end += 1
        some = [i for i in range(at, end) if texts[i]]
        if some:
            out[some] = _batch([texts[i] for i in some])
        at = end
    return out


def _batch(texts: list[str]) -> np.ndarray:
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum([0, *map(len, texts[:-1])])
    low = np.full(len(texts) * BINS, MASK64, np.uint64)
    for level in range(1, LAST + 1):
        names, first = parse(names, first)
        if level >= FIRST:
            h = mix64(names ^ np.uint64(level * MULTIPLIER & MASK64))
            owner = np.repeat(np.arange(len(texts)), np.diff(first, append=len(names)))
            slot = owner * BINS + (h >> np.uint64(58)).astype(np.int64)
            h = h & np.uint64((1 << 58) - 1)
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
            which = slot[order][starts]
            low[which] = np.minimum(low[which], np.minimum.reduceat(h[order], starts))
    return np.where(low == np.uint64(MASK64), np.int32(-1), (low & np.uint64(0xFFFF)).astype(np.int32)).reshape(-1, BINS)


def to_text(prints: np.ndarray) -> list[str]:
    """Four hex digits a bin, ---- for an empty one; nothing for an empty text."""
    blank = prints < 0
    raw = np.where(blank, 0, prints).astype(">u2").tobytes().hex()
    out = [raw[i:i + 4 * BINS] for i in range(0, len(raw), 4 * BINS)]
    for i in np.flatnonzero(blank.any(axis=1)).tolist():
        out[i] = "" if blank[i].all() else "".join("----" if b else out[i][4 * j:4 * j + 4] for j, b in enumerate(blank[i]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those filled in either; 1 for two empty texts."""
    either = ((a >= 0) | (b >= 0)).sum(1)
    same = ((a == b) & (a >= 0)).sum(1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


class Buckets:
    """Ranges of rows ordered by (doc_id, hash of the text), null ids lowest, of about equal counts.

    ``quantiles`` of the ids are the ranges' starts. An id that several quantiles fall on holds that
    many ranges, cut by the hash; so do the null ids, by their ``nulls`` share of ``n``.
    """

    def __init__(self, quantiles: list[int], nulls: int):
        ids, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        widths = dict(zip(ids.tolist(), times.tolist(), strict=True))
        for i in ids[times > 1].tolist():  # what follows a divided id is a range of its own
            if i < np.iinfo(np.int64).max:
                widths.setdefault(i + 1, 1)
        self.nulls = max(1, nulls)
        self.starts = np.array(sorted(widths), np.int64)
        self.widths = np.array([1] + [widths[i] for i in self.starts.tolist()], np.uint64)
        self.firsts = self.nulls + np.cumsum(self.widths) - self.widths

    def of(self, doc: pd.Series, h: pd.Series) -> np.ndarray:
        known = doc.notna().to_numpy()
        place = np.searchsorted(self.starts, doc.fillna(0).astype("int64").to_numpy(), "right")
        width = np.where(known, self.widths[place], np.uint64(self.nulls))
        first = np.where(known, self.firsts[place], 0).astype(np.int64)
        high = (h.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return first + ((high * width) >> np.uint64(32)).astype(np.int64)


def with_next(docs: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work`` over rows in order of descending doc_id, each followed by the next row's text.

    Rows are dealt to buckets of ids whose bounds are quantiles, one exchange in all; an id of many rows
    is dealt to several by the hash of the text. The first row of each bucket also goes, once, to the end
    of the bucket before it (and that of the first to the last), so each bucket is worked on alone.
    ``work`` gets lists of (doc_id, text) whose last row only follows.
    """
    spark = docs.sparkSession
    base = (bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .withColumn("h", F.xxhash64("text")))
    n = 4 * shuffle_partitions(spark)
    probs = [i / n for i in range(1, n)]
    seen = base.agg(F.percentile_approx("doc_id", probs, 50 * n).alias("q"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("known")).first()
    buckets = Buckets(seen["q"] or [], -(-n * (seen["rows"] - seen["known"]) // max(1, seen["rows"])))

    @F.pandas_udf("long")
    def bucket(doc: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(buckets.of(doc, h))

    placed = base.withColumn("bucket", bucket("doc_id", "h"))
    tops = {r["bucket"]: r["top"] for r in placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()}
    filled = sorted(tops, reverse=True)
    # a row for each bucket, at most about twice n: safe to broadcast
    firsts = spark.createDataFrame([(filled[i - 1], tops[b]["doc_id"], tops[b]["h"]) for i, b in enumerate(filled)], "bucket long, top_id long, top_h long")
    followers = (base.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h")))
                 .groupBy("bucket", "doc_id", "h").agg(F.max("text").alias("text")))
    columns = ["bucket", "follows", "doc_id", "h", "text"]
    dealt = (placed.withColumn("follows", F.lit(False)).select(*columns).unionByName(followers.withColumn("follows", F.lit(True)).select(*columns))
             .repartition("bucket").sortWithinPartitions("bucket", "follows", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
             .drop("h"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for f in frames:
            for follows, doc, text in zip(f["follows"].tolist(), f["doc_id"].array, f["text"], strict=True):
                rows.append((doc, text))
                size += len(text)
                if len(rows) > 1 and (follows or size > BATCH):
                    yield work(rows)
                    rows, size = ([], 0) if follows else (rows[-1:], len(text))

    return dealt.mapInPandas(run, schema)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every
    row of ``docs`` (doc_id, text)."""
    def work(rows: list[tuple]) -> pd.DataFrame:
        texts = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        prints = fingerprints(texts + changed)
        own, following, other = prints[:len(changed)], prints[1:len(texts)], prints[len(texts):]
        return pd.DataFrame({
            "doc_id": pd.array([d for d, _ in rows[:-1]], "Int64"), "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": to_text(own), "edited_fingerprint": to_text(other),
            "near_edited": likeness(own, other), "near_next": likeness(own, following)})

    return with_next(docs, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
