"""Best-fit packing with certified bins.

Documents become token pieces (ids and an end id; only those longer than a sequence are cut).
Pieces are dealt to tasks, each packs its share by best-fit decreasing and compares its number of
bins with a lower bound from dual-feasible functions. A share that meets its bound is certified and
keeps all bins but its emptiest one; a share with a gap also gives up every bin with room for its
shortest piece. The pieces given up meet in fewer, larger shares and are packed again, until one
share holds what is left or, beyond ``POOL`` pieces a share, the last round ends.

Rows: null text counts as empty (its one token is the end id). Repeated rows and doc_ids are packed
each for itself; a null doc_id stays null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shuffle_partitions
from .tokens import TokenIds

SEQUENCE = 4096
END = 1
#: Most pieces that one task packs at once.
POOL = 200_000
#: Fewest pieces that are worth a share of their own in the first round.
SHARE = 2_000
ROUNDS = 4

_loaded: dict[str, TokenIds] = {}


def token_pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, in pieces of at most ``sequence`` tokens.

    ``vocabulary``: path of the tokenizer file, readable on every executor.
    """
    def run(frames):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if vocabulary not in _loaded:
            _loaded[vocabulary] = TokenIds(vocabulary)
        ids_of, end, step = _loaded[vocabulary].ids, np.array([END], "<u4").tobytes(), 4 * sequence
        for f in frames:
            out = []
            for doc, text in zip(f["doc_id"].array, f["text"], strict=True):
                ids = ids_of(text or "") + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(count: np.ndarray, sequence: int = SEQUENCE) -> int:
    """Least bins that any packing of ``count[n]`` pieces of each length n needs, by dual-feasible functions.

    For each threshold k: a length over sequence - k counts a whole bin, one under k counts nothing,
    any other its share (k = 0 is the volume bound); the largest bound holds.
    """
    total = count.astype(np.int64) * np.arange(sequence + 1)
    upto_n, upto_len = np.cumsum(count), np.cumsum(total)
    k = np.arange(sequence // 2 + 1)
    large = upto_n[-1] - upto_n[sequence - k]
    middle = upto_len[sequence - k] - np.concatenate([[0], upto_len])[k]
    return int(np.max(large + -(-middle // sequence)))


def best_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order, and the free room of each bin."""
    by_room: dict[int, list[int]] = {}
    rooms, free = 0, []  # bit r of rooms: some bin has r free tokens
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            b, r = len(free), sequence
            free.append(sequence)
        bins[i], offsets[i] = b, sequence - r
        free[b] = left = r - n
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def packing_bound(pieces: DataFrame, sequence: int = SEQUENCE) -> int:
    """The lower bound over all pieces; the driver gets one count per length (at most ``sequence``)."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    return lower_bound(np.array([counts.get(i, 0) for i in range(sequence + 1)]), sequence)


def _share_packer(last: bool, sequence: int):
    """Packs one share by best-fit decreasing; ``open`` marks the pieces given up for the next round.

    A share at its bound gives up its emptiest bin only (what is left over when volumes don't divide
    evenly); one with a gap gives up every bin that could still take its shortest piece.
    """
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = f["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, sequence)
        certified = len(free) <= lower_bound(np.bincount(lengths, minlength=sequence + 1), sequence)
        open_bin = np.zeros(len(free), bool)
        if not last:
            open_bin = (np.arange(len(free)) == free.argmax()) if certified else free >= lengths.min()
        f = f.assign(bin=bins, offset=offsets, open=open_bin[bins])
        return f[["doc_id", "piece", "start", "length", "ids_crc32", "share", "bin", "offset", "open"]]

    return run


def pack(pieces: DataFrame, sequence: int = SEQUENCE, pool: int = POOL, share: int = SHARE) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    A sequence_id holds the round, share and bin (8, 24 and 32 bits); whole pieces count as round 100.
    """
    spark, columns = pieces.sparkSession, ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, share long, bin long, offset long, open boolean"
    pieces = materialize(pieces.select(*columns))
    done = [pieces.where(F.col("length") == sequence).select(
        *columns, (F.lit(100 << 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.where(F.col("length") < sequence)
    for round_ in range(ROUNDS + 1):
        n = left.count()
        if n == 0:
            break
        # at first as many shares as tasks; what is open meets in ever fewer shares of about ``pool`` pieces
        least = -(-n // pool)
        shares = least if round_ == ROUNDS else max(least, 1, min(n // share, shuffle_partitions(spark)) >> (3 * round_))
        last = shares == 1 or round_ == ROUNDS
        dealt = F.pmod(F.xxhash64(F.lit(round_), F.monotonically_increasing_id()), F.lit(shares))
        packed = materialize(left.select(*columns).withColumn("share", dealt).groupBy("share").applyInPandas(_share_packer(last, sequence), schema))
        number = F.lit(round_ << 56) + F.shiftleft("share", 32) + F.col("bin")
        done.append(packed.where("not open").select(*columns, number.alias("sequence_id"), "offset"))
        left = packed.where("open")
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
