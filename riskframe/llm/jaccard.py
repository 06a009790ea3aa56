"""N-gram Jaccard join by multiple-global-order prefix filtering.

Two shingle sets x, y with Jaccard >= t must, under ANY total order of all shingles, share one of
their first |s| - ceil(t |s|) + 1 shingles. This operator uses two orders. Both put shingles of
many documents last (counts of all documents, hashed into a table of fixed size) and break equal
classes by a hash of their own, so a passage that thousands of documents share hardly ever is in
a prefix. Pairs that share a prefix shingle under the first order AND under the second one are
verified exactly on the whole sets, which are written with their second prefix in front.

A prefix shingle of very many documents is hot: its rows are spread by a salt, and what all of them
have to know (their hub, whether they lie in several components) is aggregated first and joined back.

Only one set of equal ones takes part (its copies follow it), and links are found in two steps so
that a group of thousands of near copies costs no pair per two members: first every set is checked
against one hub of each prefix shingle and size class (the set of the commonest shingles, as an
original is among its copies), then only sets of different components of those links are paired.
Pairs must also pass a bound from parity sketches: sets whose sketches differ in
d bits differ in at least d shingles. A sketch of fixed size goes with the prefixes; long sets have
a second one of about as many bits as shingles, compared before their texts are fetched. Every link between different components is found, so the components are
exact; links inside a component change nothing and are not listed.

Rows: null text has no words. A document without words has no shingles and links with nothing.
A null doc_id takes no part: its component_id is null. Repeated rows are kept, each with its row.
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, bitmap_has, bounded_batches, components, materialize, mix64, pieces
from .shingles import shingle_sets

ORDER_SEEDS = (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)
SKETCH_BITS = 22
BLOCK_BITS = 16
#: Partial count tables that one task adds up.
FAN_IN = 128
#: Bits of a set's parity sketch, and the most bits of the sketch of a long set.
PARITY_BITS = 512
MOST_PARITY_BITS = 1 << 22
#: Shingles of about this many documents (by their hashed count) or more are hot; a power of two.
HOT = 1 << 10
SALTS = 64


def _set_name(s: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefix_length(n, percent: int):
    """n - ceil(t n) + 1"""
    return n - (percent * n + 99) // 100 + 1


def _parity(s: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Bit i: whether an odd number of shingles hash to i; as 64-bit words."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fine_parity(s: np.ndarray) -> np.ndarray | None:
    """Sketch of a long set: the least power of two of bits that is not below its size."""
    return _parity(s, min(MOST_PARITY_BITS, 1 << (len(s) - 1).bit_length())) if len(s) > PARITY_BITS else None


SCANNED = "doc_id long, sig long, n long, parity array<long>, fine array<long>, block int, counts binary"


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, sig, n, parity, fine) for every document, then one compressed count block each (block, counts)."""
        counts, waiting, n = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

        def count() -> None:
            slots, times = np.unique(np.concatenate(waiting), return_counts=True)
            counts[slots] += times.astype(np.uint32)

        for b in pieces(batches):
            sets = shingle_sets(b.column("text"), k)
            waiting += [(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32) for s in sets]
            n += sum(map(len, sets))
            if n > 1 << 20:
                count()
                waiting, n = [], 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "sig": pa.array([_set_name(s) for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "parity": pa.array([_parity(s) for s in sets], pa.list_(pa.int64())),
                "fine": pa.array([_fine_parity(s) for s in sets], pa.list_(pa.int64())),
                "block": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary())})
        if waiting:
            count()
            waiting.clear()
        pa.default_memory_pool().release_unused()
        rows = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(np.split(counts, 1 << (SKETCH_BITS - BLOCK_BITS)))
                if part.any()]
        if rows:
            null, no_words = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": null, "sig": null, "n": null, "parity": no_words, "fine": no_words,
                                              "block": pa.array([r[0] for r in rows], pa.int32()),
                                              "counts": pa.array([r[1] for r in rows], pa.binary())})
    return run


def _order_classes(scanned: DataFrame) -> np.ndarray:
    """Class of each hashed shingle slot by the documents that hold it, over all documents.

    The tables of all scan tasks are added up FAN_IN at a time, so no task holds more than that
    many blocks; the driver gets one table of 2^SKETCH_BITS small numbers.
    """
    def add(key, group):
        total = np.zeros(1 << BLOCK_BITS, np.uint32)
        for c in group.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    blocks = scanned.where("block is not null").select("block", "part", "counts")
    tasks = blocks.agg(F.max("part")).first()[0]
    while True:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part") \
            .applyInArrow(add, "block int, part long, counts binary")
        if tasks is None or tasks < FAN_IN:
            break
        tasks //= FAN_IN
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in blocks.toLocalIterator():
        lo = r["block"] << BLOCK_BITS
        total[lo:lo + (1 << BLOCK_BITS)] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    # half powers of two: slots of one scale differ only by the order's hash
    return np.minimum(63, np.floor(2 * np.log2(np.maximum(total, 1)))).astype(np.uint8)


def _slot_classes(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]


def _keys(s: np.ndarray, c: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles of the classes ``c`` under an order."""
    return c.astype(np.uint64) << np.uint64(58) | mix64(s ^ np.uint64(ORDER_SEEDS[order])) >> np.uint64(6)


def _rows(sets, sigs, classes, order, percent, hot) -> pa.RecordBatch:
    """(token, sig, n << 36 | hot << 35 | position << 7 | commonness) of the prefixes: each set's first
    shingles under an order, in that order (all of a tie at its end)."""
    tokens, owner, size = [], [], []
    hot_class = 2 * (hot.bit_length() - 1)
    for s, sig in zip(sets, sigs, strict=True):
        if not len(s):
            continue
        c = _slot_classes(s, classes)
        key = _keys(s, c, order)
        p = _prefix_length(len(s), percent)
        at = np.flatnonzero(key <= np.partition(key, p - 1)[p - 1])
        at = at[np.argsort(key[at], kind="stable")]
        tokens.append(s[at])
        owner.append(np.full(len(at), sig, np.int64))
        size.append((len(s) << 36) + ((c[at] >= hot_class).astype(np.int64) << 35) + (np.arange(len(at), dtype=np.int64) << 7)
                    + int(2 * c.mean()))
    cat = lambda x, t: np.concatenate(x).view(t) if x else np.zeros(0, t)
    return pa.RecordBatch.from_pydict({"token": pa.array(cat(tokens, np.int64)), "sig": pa.array(cat(owner, np.int64)),
                                       "place": pa.array(cat(size, np.int64))})


def _second_first(s: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The set with its prefix under the second order in front (equal keys by shingle, so the order is total)."""
    if not len(s):
        return s
    key, p = _keys(s, _slot_classes(s, classes), 1), _prefix_length(len(s), percent)
    return s[np.lexsort((s, key))] if p < len(s) else s


def _shared(prefixes: DataFrame) -> DataFrame:
    """Prefix rows whose shingle is in the prefix of another set too: (token, sig, n, pos, common, hot), each once.

    Rows of a hot shingle are spread over tasks and all stay: other documents hold it, or its slot."""
    w = Window.partitionBy("token", "salt")
    hot = F.expr("shiftright(place, 35) & 1 = 1")
    salt = F.when(hot, F.pmod(F.xxhash64("sig"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int")
    return materialize(
        prefixes.withColumn("salt", salt).withColumn("lo", F.min("sig").over(w)).withColumn("hi", F.max("sig").over(w))
        .where((F.col("salt") > 0) | (F.col("lo") != F.col("hi")))
        .dropDuplicates(["token", "salt", "sig"])
        .selectExpr("token", "sig", "cast(shiftright(place, 36) as int) as n", "cast(shiftright(place, 7) & 268435455 as int) as pos",
                    "cast(place & 127 as int) as common", "salt > 0 as hot"))


def _with_token_values(rows: DataFrame, keys: list[str], **values) -> DataFrame:
    """``rows`` with aggregates over the rows of equal ``keys``: by a window, those of hot shingles by
    partial aggregates that are joined back, so that no task gathers a hot shingle's rows."""
    w = Window.partitionBy(*keys)
    cold = rows.where("not hot").withColumns({name: value.over(w) for name, value in values.items()})
    hot = rows.where("hot")
    return cold.unionByName(hot.join(hot.groupBy(*keys).agg(*[value.alias(name) for name, value in values.items()]), keys))


def _fits(na, nb, pos_a, pos_b, percent: int):
    """Whether sets of these sizes that share the shingles at these positions can reach the threshold:
    at most least(pos) + 1 common ones lie up to there, at most the rest of the shorter one after."""
    room = F.least(pos_a, pos_b) + 1 + F.least(na - pos_a - 1, nb - pos_b - 1)
    needed = F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9)
    return (100 * na >= percent * nb) & (100 * nb >= percent * na) & (room >= needed)


def _alike(parity_a, parity_b, na, nb, percent: int):
    """Whether sets of these sketches and sizes can reach the threshold: their symmetric difference is
    at least the number of differing bits."""
    differ = sum((F.bit_count(parity_a[i].bitwiseXOR(parity_b[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _finely_alike(pairs: DataFrame, fines: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) that the sketches of long sets don't exclude.

    The larger sketch is folded to the size of the smaller one: sizes that can link are less than
    a factor of two apart, and so are their sketches.
    """
    def half(x):
        k = F.size(x) / 2
        return F.zip_with(F.slice(x, F.lit(1), k.cast("int")), F.slice(x, (k + 1).cast("int"), k.cast("int")),
                          lambda p, q: p.bitwiseXOR(q))

    a, b = (fines.select(F.col("sig").alias(c), F.col("n").alias(n), F.col("fine").alias(f))
            for c, n, f in (("src", "na", "fa"), ("dst", "nb", "fb")))
    fold = lambda x, y: F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(fold("fa", "fb"), fold("fb", "fa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                         F.lit(0), lambda total, x: total + x)
    alike = (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))
    return pairs.join(a, "src", "left").join(b, "dst", "left").where(F.coalesce(alike, F.lit(True))).select("src", "dst")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) among candidate pairs (src, dst): those that share a shingle of their prefixes under
    the second order too (the sets' first shingles), by exact overlap of the whole sets."""
    sets = sets.dropDuplicates(["sig"])
    a = sets.select(F.col("sig").alias("src"), F.col("s").alias("sa"))
    b = sets.select(F.col("sig").alias("dst"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    prefix = lambda s: F.slice(s, F.lit(1), (F.size(s) - F.floor((percent * F.size(s) + 99) / 100) + 1).cast("int"))
    return (pairs.join(a, "src").join(b, "dst").where(F.arrays_overlap(prefix("sa"), prefix("sb")))
            .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("src", "dst"))


def _relabel(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``column`` replaced by its node's label where it has one."""
    names = labels.select(F.col("node").alias(column), F.col("label").alias("__label"))
    return df.join(names, column, "left").withColumn(column, F.coalesce("__label", column)).drop("__label")


def _cross_pairs(rows: DataFrame, labels: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of sets of different components that share a prefix shingle and whose sizes,
    prefix positions and parity sketches leave room for the threshold."""
    r = (_with_token_values(_relabel(rows.withColumn("label", F.col("sig")), "label", labels), ["token"],
                            lo=F.min("label"), hi=F.max("label")).where("lo <> hi")
         .select("token", "sig", "label", "n", "pos")).join(parities, "sig")
    a, b = r.alias("a"), r.alias("b")
    fits = _fits(F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos"), percent)
    fits = fits & _alike(F.col("a.parity"), F.col("b.parity"), F.col("a.n"), F.col("b.n"), percent)
    return (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.sig") < F.col("b.sig"))
                   & (F.col("a.label") != F.col("b.label")) & fits)
            .select(F.col("a.sig").alias("src"), F.col("b.sig").alias("dst")).distinct())


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Rows link when 100 * |intersection| >= ``percent`` * |union| of their sets of ``words``-word
    shingles (A-Z lower-cased); component_id is the smallest doc_id that links reach. Shingles of about
    ``hot`` documents (a power of two) or more have their rows spread by a salt; the result does not depend on it.
    """
    spark = docs.sparkSession
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialize(base.mapInArrow(_scan(words), SCANNED)
                          .withColumn("part", F.spark_partition_id().cast("long")))
    rows = scanned.where("sig is not null").select("doc_id", "sig", "n")
    reps = rows.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    parities = scanned.where("n > 0").groupBy("sig").agg(F.first("parity").alias("parity"))
    fines = scanned.where(F.col("n") > PARITY_BITS).groupBy("sig").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    classes = spark.sparkContext.broadcast(_order_classes(scanned))

    def first_order(batches):
        for b in pieces(batches):
            sets = shingle_sets(b.column("text"), words)
            yield _rows(sets, [_set_name(s) for s in sets], classes.value, 0, percent, hot)

    schema = "token long, sig long, place long"
    first = _shared(base.where("doc_id is not null").mapInArrow(first_order, schema))

    def whole_sets(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """(sig, s): the whole sets of the documents in ``pairs`` that are not in ``known`` yet.

        Written as the texts are read, without a shuffle; a few further sets may be among them
        (false positives of the bitmap), and a set once for each repeated row."""
        named = pairs.select(F.col("src").alias("sig")).union(pairs.select("dst")).distinct()
        if known is not None:
            named = named.join(known.select("sig"), "sig", "left_anti")
        words_of = spark.sparkContext.broadcast(bitmap(named.join(reps, "sig"), "rep", 26))

        def run(batches):
            for b in batches:
                keep = bitmap_has(words_of.value, b.column("h").to_numpy())
                for c in pieces([b.filter(pa.array(keep))]):
                    sets = shingle_sets(c.column("text"), words)
                    yield pa.RecordBatch.from_pydict({
                        "sig": pa.array([_set_name(s) for s in sets], pa.int64()),
                        "s": pa.array([_second_first(s, classes.value, percent).view(np.int64) for s in sets], pa.list_(pa.int64()))})

        return materialize(base.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "sig long, s array<long>"))

    # first step: one hub for each prefix shingle and size class
    size_class = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))
    stars = (_with_token_values(first.withColumn("class", size_class), ["token", "class"], hub=F.max(F.struct("common", "sig", "n", "pos")))
             .where("hub.sig <> sig")
             .where(_fits(F.col("hub.n"), F.col("n"), F.col("hub.pos"), F.col("pos"), percent))
             .select(F.col("hub.sig").alias("src"), F.col("sig").alias("dst"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct())
    a, b = (parities.select(F.col("sig").alias(c), F.col("parity").alias(p)) for c, p in (("src", "pa"), ("dst", "pb")))
    stars = stars.join(a, "src").join(b, "dst").where(_alike(F.col("pa"), F.col("pb"), F.col("na"), F.col("nb"), percent)).select("src", "dst")
    stars = materialize(_finely_alike(stars, fines, percent))
    sets = whole_sets(stars)
    links = materialize(_verified(stars, sets, percent))
    labels = components(links)

    # second step: pairs of different components, by both orders
    def second_order(batches):
        for b in batches:
            lists = b.column("s")
            flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            yield _rows([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], b.column("sig").to_numpy(),
                        classes.value, 1, percent, hot)

    pairs = materialize(_finely_alike(_cross_pairs(first, labels, parities, percent), fines, percent))
    sets = sets.unionByName(whole_sets(pairs, sets))

    def of_pairs(pairs: DataFrame) -> DataFrame:
        return sets.join(pairs.select(F.col("src").alias("sig")).union(pairs.select("dst")).distinct(), "sig", "left_semi")

    second = _shared(of_pairs(pairs).select("sig", "s").mapInArrow(second_order, schema))
    pairs = materialize(pairs.join(_cross_pairs(second, labels, parities, percent), ["src", "dst"], "left_semi"))
    more = _verified(pairs, of_pairs(pairs), percent)
    # a link of the second step joins two components of the first
    top = components(_relabel(_relabel(more, "src", labels), "dst", labels))
    group = _relabel(_relabel(reps.withColumn("group", F.col("sig")), "group", labels), "group", top)
    least = group.groupBy("group").agg(F.min("rep").alias("component"))
    named = group.join(least, "group").select("sig", "component")
    return (rows.join(named, "sig", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component")))
                    .otherwise(F.col("doc_id")).alias("component_id")))
