"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source gets a target; a source's documents lie in blocks (by a hash of the
row), and its target is met by whole passes over all blocks, then by blocks in a permuted order,
then by documents of one last block. The drawn blocks of all sources are dealt to output shards by
a tree: a node draws, from its exact source quotas, those of its left half as a multivariate
hypergeometric sample, so every shard's mix is a fair sample and quotas add up exactly. A shard takes
disjoint runs of each source's permuted block list and shuffles its rows locally. The number of shards
and partitions follows from the words drawn, the number of a source's blocks is bounded.

All draws come from hashes of a seed, so reruns agree. One row per source and its shard bounds reach
the driver, never documents or blocks. Rows of a hot source are spread over its blocks (about
``BLOCK`` documents each).

``with_sizes`` counts words; ``mix`` needs doc_id, source and size and carries any further columns along.

Rows: null text has size 0; rows of size 0 are dealt like others and add no words. A null source is
one source, last in order. Repeated rows are separate documents. Result columns replace columns of
the same name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, materialize

#: Documents of a block, about, and the most blocks of a source (larger sources have larger blocks).
BLOCK = 2_000
MOST_BLOCKS = 100_000
#: Fewest shards, words of a shard and of a partition, about.
LEAST_SHARDS = 16
SHARD_WORDS = 64_000_000
PART_WORDS = 16_000_000
#: Words of a last block's room that are filled by the best sum of documents.
CLOSE = 20_000
WEIGHTS = (3, 1, 2)


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the words of the whole text."""
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD_REGEX), F.lit(0))
    return docs.withColumn("size", F.coalesce(F.size(words), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, n, source_size, target) of each source of ``sizes`` (source, size).

    Targets share ``share`` of all sizes by weight (repeating over sources by code point, null
    last), none above ``most`` times its source: sources reach their limits in the order of limit per
    weight, so one ordered pass finds the level of all others.
    """
    s = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    parts = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / parts).withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    # the first source under its limit sets the level of all that follow it
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return s.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight"))) \
        .select("source", "n", "source_size", "target")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) block counts that add up to ``quotas``, by the splitting tree."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        name = hashlib.blake2b(f"{seed}/{lo}/{hi}".encode(), digest_size=8).digest()
        rng = np.random.default_rng(int.from_bytes(name, "little"))
        take = round(int(have.sum()) * (mid - lo) / (hi - lo))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if len(have) else have
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _fill(units: pd.DataFrame) -> pd.DataFrame:
    """The units of one block (bounded) whose words fill its room: in permuted order up to the last
    ``CLOSE`` words of room, then the best sum of the others."""
    units = units.sort_values(["__row", "__id"], kind="stable").reset_index(drop=True)
    words, room = units["words"].to_numpy(np.int64), int(units["__room"].iloc[0])
    first = int(np.searchsorted(np.cumsum(words), max(0, room - CLOSE), "right"))
    left = room - int(words[:first].sum())
    # reach[i]: bit s tells whether some of the first i further units hold s words
    sums, reach, mask = words[first:].tolist(), [1], (1 << (left + 1)) - 1
    for w in sums:
        reach.append((reach[-1] | reach[-1] << w) & mask if w <= left else reach[-1])
    at, taken = reach[-1].bit_length() - 1, np.zeros(len(words), bool)
    taken[:first] = True
    for i in range(len(sums) - 1, -1, -1):
        if not reach[i] >> at & 1:
            taken[first + i] = True
            at -= sums[i]
    return units.loc[taken, ["__si", "__row", "__id"]]


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, source, size, ...) with source_size, target and ``draws``.

    ``draws`` has a (shard, place) for each time that the mix takes the row; ``place`` orders a shard.
    Parameters: shards (from the words drawn unless given), seed, share, most, weights, block.
    """
    return _mix(docs, **how)[0]


def _mix(docs: DataFrame, shards: int | None = None, seed: int = 7, share: float = 1.5, most: float = 2.0,
         weights=WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, int, float]:
    """(the result of ``mix``, number of shards, words drawn)"""
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "draws")
    names = docs.columns
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size"))
    known = source_targets(sizes, share, most, weights).collect()
    known.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    words = sum(r["target"] for r in known)
    shards = shards or max(LEAST_SHARDS, math.ceil(words / SHARD_WORDS))
    if not known:
        return docs.selectExpr("*", "0L as source_size", "0D as target", "cast(array() as array<struct<shard:int,place:long>>) as draws"), shards, words
    passes = [int(r["target"] // r["source_size"]) if r["source_size"] else 0 for r in known]
    plan = spark.createDataFrame([(i, r["source"], r["source_size"], r["target"], min(-(-r["n"] // block), MOST_BLOCKS), passes[i]) for i, r in enumerate(known)],
                                 "__si int, __name string, source_size long, target double, __blocks long, __passes int")

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with their source's plan, a hash of their own and their block."""
        return (rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["__name"])).drop("__name")
                .withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
                .withColumn("__row", F.xxhash64(F.lit(seed), "__id", "size")).withColumn("__block", F.pmod("__row", "__blocks")))

    # blocks in permuted order: whole ones up to the rest of the target, then one in part
    narrow = placed(sizes)
    blocks = narrow.groupBy("__si", "__block").agg(F.sum("size").alias("words"), F.first("__passes").alias("__passes"),
                                                   F.first("target").alias("t"), F.first("source_size").alias("s"))
    blocks = blocks.withColumn("perm", F.xxhash64(F.lit(seed + 1), "__si", "__block")).withColumn("rest", F.expr("t - __passes * s"))
    order = Window.partitionBy("__si").orderBy("perm", "__block")  # at most MOST_BLOCKS rows
    blocks = materialize(
        blocks.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("__whole", F.expr("upto <= rest")).withColumn("__room", F.expr("if(upto > rest, greatest(rest - upto + words, 0D), 0D)"))
        .withColumn("__at", F.row_number().over(order) - 1)
        .select("__si", "__block", "__passes", "__whole", "__room", "__at"))

    # in the last block (one a source): documents in permuted order, the last of them so that the room is
    # filled best; repeated rows of one id and size go together
    units = narrow.join(blocks.where("__room > 0").select("__si", "__block", "__room"), ["__si", "__block"]) \
        .groupBy("__si", "__row", "__id", "__room").agg(F.sum("size").alias("words"))
    chosen = materialize(units.groupBy("__si").applyInPandas(_fill, "__si int, __row long, __id long").withColumn("__in", F.lit(True)))

    # the tree's quotas: drawn blocks of each source, the last partial one counted whole
    counted = {r["__si"]: r for r in blocks.groupBy("__si").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("__whole or __room > 0")).alias("drawn")).collect()}
    quotas = np.array([passes[i] * counted[i]["n"] + counted[i]["drawn"] for i in range(len(known))])
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    runs = spark.createDataFrame([(i, counted[i]["drawn"], [0, *ends[:, i].tolist()]) for i in range(len(known))], "__si int, __drawn long, ends array<long>")
    # places of a source's run, dealt to shards; a block's copies stand side by side
    dealt = (runs.select("__si", F.posexplode(F.expr("arrays_zip(slice(ends, 1, size(ends) - 1), slice(ends, 2, size(ends) - 1))")).alias("shard", "run"))
             .select("__si", "shard", F.col("run")["0"].alias("lo"), F.col("run")["1"].alias("hi")).where("lo < hi")
             .select("__si", "shard", F.explode(F.expr("sequence(lo, hi - 1)")).alias("at")))
    times = blocks.join(F.broadcast(runs.select("__si", "__drawn")), "__si").withColumn("more", F.expr("cast(__at < __drawn as int)")) \
        .withColumn("first", F.expr("if(__at < __drawn, __at * (__passes + 1), __drawn * (__passes + 1) + (__at - __drawn) * __passes)")) \
        .where("__passes + more > 0").select("__si", "__block", "first", F.explode(F.expr("sequence(0, __passes + more - 1)")).alias("copy"))
    shards_of = times.withColumn("at", F.col("first") + F.col("copy")).join(dealt, ["__si", "at"]) \
        .groupBy("__si", "__block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("__copies"))
    blocks = materialize(blocks.join(shards_of, ["__si", "__block"], "left").select("__si", "__block", "__whole", "__copies"))

    drawn = (placed(docs).join(blocks, ["__si", "__block"]).join(chosen, ["__si", "__row", "__id"], "left")
             .withColumn("__times", F.expr("__passes + cast(__whole or coalesce(__in, false) as int)")))
    draws = F.expr(f"transform(slice(coalesce(__copies, array()), 1, __times), c -> struct(c.shard as shard, xxhash64({seed + 2}, c.copy, __row) as place))")
    return drawn.withColumn("draws", draws).select(*names, "source_size", "target", "draws"), shards, words


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each drawn row, once per draw, with its shard, shuffled inside the shard.

    A shard's rows lie in one partition, or in several of about ``PART_WORDS`` words by a hash of the
    row. A row is sent once for each of its shards, with the places of its copies, which are spread
    out behind the exchange.
    """
    drawn, shards, words = _mix(docs, **how)
    parts = max(1, math.ceil(words / shards / PART_WORDS))
    own = [c for c in docs.columns if c not in ("shard", "place")]
    sent = drawn.select(*own, "draws", F.explode(F.array_distinct("draws.shard")).alias("shard")) \
        .withColumn("draws", F.expr("transform(filter(draws, d -> d.shard = shard), d -> d.place)"))
    part = F.col("shard") * parts + F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)).cast("int")
    dealt = sent.repartitionById(shards * parts, part)
    return dealt.select(*own, "shard", F.explode("draws").alias("place")).sortWithinPartitions("shard", "place")
