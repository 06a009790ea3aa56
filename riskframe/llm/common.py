"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words of the contracts: maximal runs of anything but these six characters.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table under the shared checkpoint folder and read it back.

    Cuts the lineage at a table that outlives its executors: what follows reads fixed rows, so
    two uses of it always agree and a lost executor costs one task, not the whole history.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(docs: DataFrame, rows: int = 512) -> DataFrame:
    """``docs``, its session set to hand Python at most ``rows`` whole texts at a time.

    Arrow batches are counted in rows; Spark's default of 10,000 would hold a GB of texts of 100 KB.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return docs


def in_fold(doc_id, folds: int = 5):
    """Held-out rows: crc32 of the id as text is divisible by ``folds`` (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y) of at most ``per_class`` training documents of each class, in hash order of the id.

    Only ids outside the held-out fold whose labels are 0 or 1 and agree take part. The bound is
    what makes the result safe to broadcast.
    """
    y = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
         .where(~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2"))
         .where("y = y2").drop("y2"))
    known = docs.select("doc_id").join(y, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("y") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        yield b.slice(at)


def _utf8(column) -> pa.Array:
    """The column as one contiguous large_string array whose offsets start at 0; nulls are empty."""
    parts = [column] if isinstance(column, pa.Array) else column.chunks
    empty = pa.array([], pa.large_string())
    return pa.concat_arrays([*(p.cast(pa.large_string()).fill_null("") for p in parts), empty, empty])


def utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls count as empty."""
    a = _utf8(column)
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bitmap(df: DataFrame, key, bits: int = 24) -> np.ndarray:
    """Bitmap of the hashed ``key`` column: 2^bits bits whatever the number of rows.

    A prefilter only: set bits may be false positives, clear bits never are. Spark builds it
    (a group-by whose result has at most 2^(bits-6) rows); the driver gets those words.
    """
    h = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(h.alias("h")).selectExpr("cast(shiftright(h, 6) as int) as word",
                                               "shiftleft(1L, cast(h & 63 as int)) as bit")
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        out[r["word"]] = r["bit"]
    return out.view(np.uint64)


def bitmap_has(words, h):
    """Whether the hashes ``h`` (the same xxhash64 as in ``bitmap``) may be in the bitmap."""
    bits = 6 + int(len(words)).bit_length() - 1
    h = h.astype(np.int64) & np.int64((1 << bits) - 1)
    return (words[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of ``edges`` (src, dst) with the smallest node that links reach.

    Smallest-neighbour labels with pointer jumping, one written table a round; a round is a join
    and a partial minimum, so a node with very many links is never gathered in one task. Only the
    number of changed rows reaches the driver. Stops when no label changes.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                       .where("src <> dst").distinct())
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m"))
                         .select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        seen = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("m"))
        low = labels.join(seen, labels["node"] == seen["src"]).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(low.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")))
        if new.where("label <> old").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
