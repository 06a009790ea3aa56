"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector's bucket in a table is the cell floor((a.v + b) / w) of a few random Gaussian directions.
Largest inner products become nearest points by one more coordinate, sqrt(max norm^2 - |v|^2) (0 for
queries), which p-stable hashing is made for. A query visits, in each table, its own cell and then
perturbed cells in the order of their estimated success: the sum of squared distances from its
projections to the cells' borders. The best perturbations are found exactly by extending the best
prefixes one direction at a time.

Tables grow with the data (more directions, so that a cell keeps about ``CELL`` vectors), and the
number of visited cells is set on a bounded sample of queries: the fewest that reach ``TARGET``
recall against an exact search of all vectors for those queries. Where no number of cells within reach
does, as with vectors of very unequal norms or very many cells, every query is searched exactly in all
vectors, blocks of queries against shares of vectors. Candidates of a cell are reranked by
exact double products, a block of queries against a block of vectors; each task keeps the best k
of each query. Equal vectors are indexed once with their smallest k + 1 ids (no others can be among
the k nearest), so a vector of very many rows makes no large cell. The vectors of each cell are counted,
and a cell of more than ``PIECE`` (a tight cluster) is split over several shares by a hash of the id;
queries that visit it go to all of them. Queries that found fewer than k
visit every cell of the first table, which is an exact search.

Rows: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Rows with a null vec_id take no part; repeated rows of an id and vector count once. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TABLES = 2
#: Vectors of a cell, about.
CELL = 96
#: Cells along one direction, about: widths are this share of a projection's spread.
WIDTH = 1.0
#: Largest shift of a cell along one direction.
REACH = 6
TARGET = 0.96
#: Queries on which the number of visited cells is set.
TUNING = 128
MOST_PROBES = 20_000
BLOCK = 1024
#: Vectors of a task's share of a table, about.
SHARE = 20_000
#: Vectors of a cell that stay in one share, about.
PIECE = SHARE // 8


class Hashes:
    """The tables' directions, offsets and width for vectors of ``dim`` (+ 1) coordinates."""

    def __init__(self, dim: int, n: int, norm: float, mean_square: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.norm = norm
        self.width = max(1e-30, WIDTH * float(np.sqrt(max(mean_square, 1e-300))))
        self.m = max(1, round(np.log(max(1, n / CELL)) / np.log(4)))
        self.a = rng.normal(size=(TABLES, dim + 1, self.m))
        self.b = rng.uniform(0, self.width, (TABLES, self.m))

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(tables, rows, directions) in cell widths."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm ** 2 - (x * x).sum(1)))
        p = np.einsum("nd,tdm->tnm", np.column_stack([x, last]), self.a)
        return (p + self.b[:, None]) / self.width

    def cells(self, projected: np.ndarray) -> np.ndarray:
        """One 64-bit name per (table, row)."""
        return self.name(np.floor(projected).astype(np.int64))

    def name(self, cell: np.ndarray) -> np.ndarray:
        h = np.zeros(cell.shape[:-1], np.uint64)
        for i in range(self.m):
            h = (h ^ cell[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)

    def probes(self, projected: np.ndarray, count: int) -> np.ndarray:
        """Names (rows, <= count) of one table's cells in estimated success order (rows, directions)."""
        n, shifts = len(projected), np.arange(-REACH, REACH + 1)
        low = projected - np.floor(projected)
        cost, cell = np.zeros((n, 1)), np.floor(projected).astype(np.int64)[:, None, :]
        for i in range(self.m):
            # squared distance to the border of the cell that many steps away
            step = np.where(shifts > 0, shifts - low[:, i, None], np.where(shifts < 0, low[:, i, None] - shifts - 1, 0)) ** 2
            both = (cost[:, :, None] + step[:, None, :]).reshape(n, -1)
            keep = min(count, both.shape[1])
            best = np.argpartition(both, keep - 1, axis=1)[:, :keep] if keep < both.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
            cost = np.take_along_axis(both, best, 1)
            cell = np.take_along_axis(cell, (best // len(shifts))[:, :, None], 1)
            cell[:, :, i] += shifts[best % len(shifts)]
        return np.take_along_axis(self.name(cell), np.argsort(cost, axis=1, kind="stable"), 1)


def _matrix(column) -> np.ndarray:
    a = column if isinstance(column, pa.Array) else column.combine_chunks()
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1).astype(np.float64) if len(a) else np.zeros((0, 0))


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(F.coalesce(fine, F.lit(False)))
    return good


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row: larger score first, then smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    good = _usable(vectors, vector)
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("m"),
                                                    F.avg(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("a")).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    most = max(dims, key=lambda r: (r["n"], r["d"]))
    dim, n = most["d"], most["n"]
    good = good.where(F.size("v") == dim)
    h = Hashes(dim, n, float(np.sqrt(most["m"])), most["a"])
    shares = max(1, -(-n // SHARE))

    # equal vectors once, with all ids that can be needed
    distinct = materialize(
        good.dropDuplicates(["vec_id", "v"]).groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("key", F.xxhash64("v")))
    many = good.join(distinct.where("n > 1").select("key"), F.xxhash64(F.col("v")) == F.col("key"), "left_semi").dropDuplicates(["vec_id", "v"])
    place = Window.partitionBy("v").orderBy("vec_id")
    lists = (many.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)
             .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    index = materialize(distinct.where("n = 1").select("v", F.array("first").alias("ids")).unionByName(lists))
    asked = good.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("qid")))

    probes = _tuned(queries, index, h, k)
    pieces = _pieces(index, h)
    parts = max(1, -(-queries.count() // SHARE))

    def place_vectors(batches):
        for b in batches:
            cells = h.cells(h.project(_matrix(b.column("v")), False))
            first = np.array([i[0].as_py() for i in b.column("ids")], np.int64)
            for t in range(TABLES):
                yield pa.RecordBatch.from_pydict({"share": pa.array(_share(cells[t], t, shares, _salts(cells[t], first, *pieces[t]))), "cell": pa.array(cells[t]),
                                                  "ids": b.column("ids"), "v": b.column("v")})

    def place_queries(visits: int, tables: int):
        def run(batches):
            for b in batches:
                x = _matrix(b.column("v"))
                for at in range(0, len(x), 64):
                    p = h.project(x[at:at + 64], True)
                    out = {"share": [], "qid": [], "cells": [], "v": []}
                    for t in range(tables):
                        names = h.probes(p[t], visits)
                        for i in range(len(names)):
                            visited, salts = _all_salts(names[i], *pieces[t])
                            where = _share(visited, t, shares, salts)
                            for s in np.unique(where):
                                out["share"].append(s)
                                out["qid"].append(b.column("qid")[at + i].as_py())
                                out["cells"].append(np.unique(visited[where == s]))
                                out["v"].append(x[at + i])
                    yield pa.RecordBatch.from_pydict({"share": pa.array(out["share"], pa.int64()), "qid": pa.array(out["qid"], pa.int64()),
                                                      "cells": pa.array(out["cells"], pa.list_(pa.int64())),
                                                      "v": pa.array(out["v"], pa.list_(pa.float64()))})
        return run

    placed = index.mapInArrow(place_vectors, "share long, cell long, ids array<long>, v array<double>")
    schema_q = "share long, qid long, cells array<long>, v array<double>"

    def rerank(everything: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _rerank(left, right, k, everything)
        return run

    found_schema = "qid long, vec_id long, score double"

    def reranked(asking: DataFrame, placed: DataFrame, everything: bool) -> DataFrame:
        # a task holds one share of the vectors and one part of the queries
        some = asking.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts))).groupBy("share", "part")
        every_part = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return some.cogroup(every_part.groupBy("share", "part")).applyInArrow(rerank(everything), found_schema)

    if probes is None:
        found, short = spark.createDataFrame([], found_schema), queries.select("v", "qid")
    else:
        found = materialize(reranked(queries.mapInArrow(place_queries(probes, TABLES), schema_q), placed, False))
        some = found.groupBy("qid").agg(F.count_distinct("vec_id").alias("c"))
        total = index.agg(F.sum(F.size("ids"))).first()[0]
        short = queries.join(some, "qid", "left").where(F.coalesce("c", F.lit(0)) < min(k + 1, total)).select("v", "qid")
    # the first table holds every vector once: all its shares are an exact search
    everywhere = short.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(
        F.col("share").cast("long").alias("share"), "qid", F.expr("cast(array() as array<long>)").alias("cells"), "v")
    rest = reranked(everywhere, placed.where(F.col("share") < shares), True)
    both = found.unionByName(rest).dropDuplicates(["qid", "vec_id"])
    same = asked.select("vec_id", "v").withColumnRenamed("vec_id", "query_id").join(queries, "v").select("query_id", "qid")
    rows = same.join(both, "qid").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x.view(np.uint64) ^ (x.view(np.uint64) >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def _share(cells: np.ndarray, table: int, shares: int, salts: np.ndarray) -> np.ndarray:
    """The task share of a cell's piece; each table has its own range of shares. Pieces lie in shares that follow each other."""
    return table * shares + (((cells.view(np.uint64) >> np.uint64(33)) + salts.astype(np.uint64)) % np.uint64(shares)).astype(np.int64)


def _pieces(index: DataFrame, h: Hashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each table the sorted cells of more than ``PIECE`` vectors, and into how many pieces each is split."""
    def cells(batches):
        for b in batches:
            found = h.cells(h.project(_matrix(b.column("v")), False))
            for t in range(TABLES):
                yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(found[t]), t)), "cell": pa.array(found[t])})

    large = index.mapInArrow(cells, "t long, cell long").groupBy("t", "cell").count().where(F.col("count") > PIECE).orderBy("t", "cell").collect()
    return [(np.array([r["cell"] for r in large if r["t"] == t], np.int64),
             np.array([-(-r["count"] // PIECE) for r in large if r["t"] == t], np.int64)) for t in range(TABLES)]


def _counts(cells: np.ndarray, large: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of pieces of each cell."""
    if not len(large):
        return np.ones(len(cells), np.int64)
    at = np.minimum(np.searchsorted(large, cells), len(large) - 1)
    return np.where(large[at] == cells, counts[at], 1)


def _salts(cells: np.ndarray, ids: np.ndarray, large: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The piece of its cell that each vector belongs to."""
    return (_mixed(ids) % _counts(cells, large, counts).astype(np.uint64)).astype(np.int64)


def _all_salts(cells: np.ndarray, large: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, pieces): all pieces of each cell."""
    n = _counts(cells, large, counts)
    return np.repeat(cells, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _rerank(queries: pa.Table, vectors: pa.Table, k: int, everything: bool) -> pa.Table:
    """Exact products of a share's queries with the vectors of the cells they visit; the best of each query.

    One id more than k is kept, for a query's own row.
    """
    empty = pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not vectors.num_rows:
        return empty
    q, x = _matrix(queries.column("v")), _matrix(vectors.column("v"))
    cells = vectors.column("cell").to_numpy()
    order = np.argsort(cells, kind="stable")
    names, starts = np.unique(cells[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    top_i = np.full((len(q), k + 1), np.iinfo(np.int64).max)
    top_s = np.full((len(q), k + 1), -np.inf)
    first = np.array([i[0].as_py() for i in vectors.column("ids")], np.int64)
    if everything:
        visits = {0: np.arange(len(q))}
        starts, ends = np.array([0]), np.array([len(order)])
    else:
        lists = queries.column("cells").combine_chunks()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        at = np.searchsorted(names, flat)
        hit = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == flat)
        flat, owner = at[hit], owner[hit]
        by = np.argsort(flat, kind="stable")
        cell_of, cuts = np.unique(flat[by], return_index=True)
        visits = dict(zip(cell_of.tolist(), np.split(owner[by], cuts[1:]), strict=True)) if len(cell_of) else {}
    for c, who in visits.items():
        rows = order[starts[c]:ends[c]]
        for qa in range(0, len(who), BLOCK):
            w = who[qa:qa + BLOCK]
            for xa in range(0, len(rows), BLOCK):
                r = rows[xa:xa + BLOCK]
                s = _products(q[w], x[r])
                s[s < top_s[w, -1:]] = -np.inf  # can't enter any more
                keep = min(k + 1, len(r))
                ids = np.broadcast_to(first[r], s.shape)
                if keep < len(r):
                    edge = np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                    if (np.isfinite(edge) & ((-s <= edge[:, None]).sum(1) > keep)).any():  # ties at the edge
                        pi, ps = _best(ids, s, keep)
                    else:
                        part = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                        pi, ps = np.take_along_axis(ids, part, 1), np.take_along_axis(s, part, 1)
                else:
                    pi, ps = ids, s
                top_i[w], top_s[w] = _best(np.concatenate([top_i[w], pi], 1), np.concatenate([top_s[w], ps], 1), k + 1)
    # equal vectors stand for all their ids
    more = {f: i.as_py() for f, i in zip(first.tolist(), vectors.column("ids"), strict=True) if len(i) > 1}
    qids = queries.column("qid").to_numpy()
    out_q, out_i, out_s = [], [], []
    for row in range(len(q)):
        for i, s in zip(top_i[row].tolist(), top_s[row].tolist(), strict=True):
            if np.isfinite(s):
                for one in more.get(i, (i,)):
                    out_q.append(qids[row])
                    out_i.append(one)
                    out_s.append(s)
    return pa.table({"qid": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_i, pa.int64()), "score": pa.array(out_s, pa.float64())})


def _tuned(queries: DataFrame, index: DataFrame, h: Hashes, k: int) -> int | None:
    """Visited cells per table at which a sample of queries reaches the target recall; None if none does.

    The sample is bounded; every vector is compared with it, exactly, and each task returns the best
    k of each sampled query with their cells.
    """
    rows = queries.orderBy(F.xxhash64("qid"), "qid").limit(TUNING).collect()
    if not rows:
        return 1
    q = np.array([r["v"] for r in rows])
    qid = np.array([r["qid"] for r in rows])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_i, top_s = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
        top_c = np.zeros((len(q), k, TABLES), np.int64)
        for b in batches:
            x = _matrix(b.column("v"))
            first = np.array([i[0].as_py() for i in b.column("ids")], np.int64)
            cells = h.cells(h.project(x, False)).T
            for at in range(0, len(x), BLOCK):
                s = _products(q, x[at:at + BLOCK])
                ids = np.concatenate([top_i, np.broadcast_to(first[at:at + BLOCK], s.shape)], 1)
                c = np.concatenate([top_c, np.broadcast_to(cells[None, at:at + BLOCK], (*s.shape, TABLES))], 1)
                s = np.concatenate([top_s, np.where(first[None, at:at + BLOCK] == qid[:, None], -np.inf, s)], 1)
                order = np.lexsort((ids, -s), axis=1)[:, :k]
                top_i, top_s, top_c = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1), np.take_along_axis(c, order[:, :, None], 1)
        who, col = np.nonzero(np.isfinite(top_s))
        yield pa.RecordBatch.from_pydict({"q": pa.array(who, pa.int64()), "i": pa.array(top_i[who, col]), "s": pa.array(top_s[who, col]),
                                          "c": pa.array(list(top_c[who, col]), pa.list_(pa.int64()))})

    near = index.mapInArrow(exact, "q long, i long, s double, c array<long>")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "i"))).where(F.col("r") <= k)
    found = best.select("q", "c").toPandas()
    if not len(found):
        return 1
    p, count = h.project(q, True), min(MOST_PROBES, (2 * REACH + 1) ** h.m)
    rank = np.full(len(found), np.inf)
    cells = np.stack(found["c"].to_numpy())
    for i in range(len(q)):
        mine = np.flatnonzero(found["q"].to_numpy() == i)
        for t in range(TABLES):
            names = h.probes(p[t][i:i + 1], count)[0]
            at = {c: r for r, c in reversed(list(enumerate(names.tolist())))}
            for j in mine:
                rank[j] = min(rank[j], at.get(int(cells[j][t]), np.inf))
    rank.sort()
    at = rank[min(len(rank) - 1, int(np.ceil(TARGET * len(rank))) - 1)]
    return int(at) + 1 if np.isfinite(at) else None
