"""Exact k nearest neighbours of sparse vectors without negative values, by an inverted index.

A row is ``(key, entries)`` with ``entries`` an array of ``(_i, v)`` in the order of ``_i``; no vector is made dense.
With N the sum of squares (of values, for Manhattan) and O what two rows share (the sum of products, of the smaller
values), a squared distance is N(q) + N(x) - 2 O(q, x).

A query first gets a bound on its k-th distance: rows that share nothing with it are ordered by N alone, so the k rows
of smallest N are always candidates, and the largest values of its strongest dimensions give better ones. Its
dimensions are then gone through from the rarest on, and only as long as what is left of the query, by the largest
value of each dimension and by its own remaining weight, could still bring an unseen row below the bound. Postings of
the dimensions visited are filtered by the same bound row by row, and what is left is compared in full. The work grows
with the postings visited. Postings of a frequent dimension are cut into blocks of bounded size.

On few and frequent dimensions the bound rules out little, and pairs that are written out one by one would fill the
disks. Where queries would meet more than ``VISITED`` postings each, the index is used inside tasks instead: equal rows
are taken once, both sides are cut into blocks of bounded size, and a task returns the nearest rows of its block for
each of its queries, never pairs. By Manhattan distance a matrix product over cells of the frequent dimensions, zero being
one, gives lower bounds there, and only what they leave is compared.

Squared distances that agree at twelve decimals count as equal, and the smaller key comes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studysift.operators import neighbours as nb
from studysift.operators.storage import stored

METRICS = ("euclidean", "manhattan", "minkowski")
STRONGEST = 4  # dimensions of a query whose largest postings give its first bound
POSTINGS = 4096  # of one dimension in a task
VISITED = 500  # postings a query may meet on average before both sides are compared in blocks
BLOCK_ROWS = 32_768
ASKED_ROWS = 65_536  # queries of a block
BLOCK_ENTRIES = 2_000_000
TILE_ROWS = 128  # queries multiplied at once
HEAD = 1024  # rows of a block that give a query its first limit there
SLACK = 1e-9
CUTS = ((0.4, 4), (0.2, 2), (0.0, 1))  # a dimension with values in this share of a block is cut so often for lower bounds
MOST_CODES = 1024  # columns of the matrix product that gives them
MOST_WHOLE = 1024  # dimensions kept as whole columns


def sparse_entries(values: Column) -> Column:
    """``(_i, v)`` of the values of an array that are not zero."""
    pairs = F.transform(values, lambda v, i: F.struct(i.alias("_i"), v.alias("v")))
    return F.filter(pairs, lambda p: p["v"] != 0)


def _size(manhattan: bool) -> Column:
    return F.aggregate("entries", F.lit(0.0), lambda s, e: s + (e["v"] if manhattan else e["v"] * e["v"]))


def _shared(a: Column, b: Column, manhattan: bool) -> Column:
    return F.least(a, b) if manhattan else a * b


def bounds(asked: DataFrame, postings: DataFrame, least: DataFrame, k: int, manhattan: bool) -> DataFrame:
    """``(query, bound)``: an upper bound on the k-th squared distance of each query.

    ``asked`` is ``(query, i, q, nq)``, ``postings`` ``(i, id, x, nx, top)``, ``least`` the k rows of smallest size.
    """
    by_size = Window.partitionBy("i").orderBy(F.col("x").desc(), "id")
    champions = postings.withColumn("r", F.row_number().over(by_size)).where(F.col("r") <= k)
    tops = champions.where("r = 1").select("i", F.col("x").alias("top"))
    strong = Window.partitionBy("query").orderBy(_shared(F.col("q"), F.col("top"), manhattan).desc(), "i")
    strongest = asked.join(tops, "i").withColumn("s", F.row_number().over(strong)).where(F.col("s") <= STRONGEST)
    met = strongest.select("query", "i", "q", "nq").join(champions.select("i", "id", "x", "nx"), "i")
    part = F.sum(_shared(F.col("q"), F.col("x"), manhattan))
    tried = met.groupBy("query", "id", "nq", "nx").agg(part.alias("o"))
    tried = tried.select("query", "id", (F.col("nq") + F.col("nx") - 2 * F.col("o")).alias("d"))
    plain = _with_least(asked.select("query", "nq").distinct(), least)
    tried = tried.unionByName(plain.select("query", "id", (F.col("nq") + F.col("nx")).alias("d")))
    tried = tried.groupBy("query", "id").agg(F.min("d").alias("d"))
    order = Window.partitionBy("query").orderBy("d", "id")
    ranked = tried.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    # fewer rows than k: nothing can be ruled out
    bound = F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf"))
    return ranked.groupBy("query").agg(bound.alias("bound"))


def _with_least(queries: DataFrame, least: DataFrame) -> DataFrame:
    """Each query with the rows of smallest size, k at most, which reach it as one array."""
    rows = least.agg(F.collect_list(F.struct("id", "nx"))).scalar()
    return queries.withColumn("_l", rows).select(*queries.columns, F.inline("_l"))


def visits(asked: DataFrame, terms: DataFrame, bound: DataFrame, manhattan: bool) -> DataFrame:
    """``(query, i, nq, bound, rest, reach)``: the dimensions of each query that a near row could first be met in.

    ``terms`` is ``(i, n, top)``; ``rest`` is the size of the query from this dimension on, ``reach`` the most that a
    row can share with it.
    """
    rarest_last = Window.partitionBy("query").orderBy(F.col("n").desc(), F.col("i").desc())
    rest = rarest_last.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("q") if manhattan else F.col("q") * F.col("q")
    left = asked.join(terms, "i").select(
        "query", "i", "nq", F.sum(own).over(rest).alias("rest"),
        F.sum(_shared(F.col("q"), F.col("top"), manhattan)).over(rest).alias("reach"),
    )
    joined = left.join(bound, "query")
    # over all sizes a row may have, the least possible distance is nq - rest, and by the reach nq + nx - 2 reach
    return joined.where(F.col("nq") - F.col("rest") <= F.col("bound") + SLACK)


def candidates(visited: DataFrame, postings: DataFrame, terms: DataFrame, manhattan: bool) -> DataFrame:
    """Distinct ``(query, id)`` of visited postings that the bound does not rule out."""
    blocks = terms.select("i", F.ceil(F.col("n") / POSTINGS).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = postings.join(blocks, "i").select("i", block.alias("block"), "id", "nx")
    spread = visited.join(blocks, "i").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    share = F.least(F.col("rest"), F.col("nx")) if manhattan else F.sqrt(F.col("rest") * F.col("nx"))
    closest = F.col("nq") + F.col("nx") - 2 * F.least(share, F.col("reach"))
    met = spread.drop("blocks").join(dealt, ["i", "block"]).where(closest <= F.col("bound") + SLACK)
    return met.select("query", "id").distinct()


def compared(pairs: DataFrame, queries: DataFrame, train: DataFrame, manhattan: bool) -> DataFrame:
    """``(query, neighbour, d)``: squared distances (sums, for Manhattan) of pairs ``(query, id)``, to twelve decimals."""
    joined = pairs.join(queries.select("query", F.col("entries").alias("a"), "nq"), "query")
    joined = joined.join(train.select("id", F.col("entries").alias("b"), "nx"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for at in (2, 3):
                lists = batch.column(at)
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
                pair = np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes)
                places.append((pair << 32) | flat.field("_i").to_numpy(zero_copy_only=False).astype(np.int64))
                values.append(flat.field("v").to_numpy(zero_copy_only=False))
            both, left, right = np.intersect1d(*places, assume_unique=True, return_indices=True)
            a, b = values[0][left], values[1][right]
            shared = np.bincount(both >> 32, np.minimum(a, b) if manhattan else a * b, batch.num_rows)
            d = batch.column(4).to_numpy() + batch.column(5).to_numpy() - 2 * shared
            columns = [batch.column(0), batch.column(1), pa.array(np.maximum(np.round(d, 12), 0.0) + 0.0)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "neighbour", "d"])

    asked = joined.select("query", "id", "a", "b", "nq", "nx")
    return asked.mapInArrow(run, "query long, neighbour long, d double")


def _nearest_in_block(a: pd.DataFrame, b: pd.DataFrame, need: int, manhattan: bool) -> pd.DataFrame:
    """The ``need`` nearest rows ``(kind, id, i, v, nx)`` of one block for each query ``(query, i, v, nq)``."""
    if not len(a) or not len(b):
        return pd.DataFrame({"query": [], "kind": [], "id": [], "d": []})
    b = b.sort_values("id")
    kinds, ids, nx, n = b["kind"].to_numpy(), b["id"].to_numpy(), b["nx"].to_numpy(), len(b)
    dims, values = np.concatenate(b["i"].tolist()), np.concatenate(b["v"].tolist())
    rows = np.repeat(np.arange(n), [len(i) for i in b["i"]])
    if manhattan and n > max(HEAD, need) and _mostly_frequent(dims, n) and (np.concatenate([nx, a["nq"]]) < nb.LARGEST).all():
        found = _nearest_by_floors(a, nx, rows, dims, values, need)
        out = [(np.full(len(best), query), kinds[best], ids[best], gaps) for query, (best, gaps) in zip(a["query"], found)]
        return pd.DataFrame(dict(zip(("query", "kind", "id", "d"), map(np.concatenate, zip(*out)))))
    order = np.argsort(dims, kind="stable")
    dims, values, rows = dims[order], values[order], rows[order]
    starts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]]) if len(dims) else np.array([], int)
    postings, columns = {}, {}
    for start, end in zip(starts, np.r_[starts[1:], len(dims)]):
        at, x, place = rows[start:end], values[start:end], int(dims[start])
        if len(at) > n // 16:  # a frequent dimension is a whole column
            columns[place] = len(columns)
        postings[place] = at, x
    whole = np.zeros((len(columns), n))
    for place, column in columns.items():
        whole[column, postings[place][0]] = postings[place][1]
    out, part = [], np.empty(n)
    for r, (query, places, weights, nq) in enumerate(zip(a["query"], a["i"], a["v"], a["nq"])):
        if not manhattan and r % TILE_ROWS == 0:
            tile = np.zeros((min(TILE_ROWS, len(a) - r), len(columns)))
            for t, (i, v) in enumerate(zip(a["i"].iloc[r : r + TILE_ROWS], a["v"].iloc[r : r + TILE_ROWS])):
                for place, weight in zip(i.tolist(), v.tolist()):
                    if place in columns:
                        tile[t, columns[place]] = weight
            products = tile @ whole
        shared = np.zeros(n) if manhattan else products[r % TILE_ROWS]
        for place, weight in zip(places.tolist(), weights.tolist()):
            if place in columns:
                if manhattan:
                    shared += np.minimum(weight, whole[columns[place]], out=part)
            elif place in postings:
                at, x = postings[place]
                shared[at] += np.minimum(weight, x) if manhattan else weight * x
        d = nq + nx - 2 * shared
        if n > need:
            head = d[: max(HEAD, need)]
            near = np.flatnonzero(d <= np.partition(head, need - 1)[need - 1] + SLACK)
        else:
            near = np.arange(n)
        gaps = np.maximum(np.round(d[near], 12), 0.0) + 0.0
        # rows come by key, so a stable sort settles equal distances by it
        best = np.argsort(gaps, kind="stable")[:need]
        out.append((np.full(len(best), query), kinds[near[best]], ids[near[best]], gaps[best]))
    return pd.DataFrame(dict(zip(("query", "kind", "id", "d"), map(np.concatenate, zip(*out)))))


def _mostly_frequent(dims: np.ndarray, n: int) -> bool:
    """Whether nearly all values lie in dimensions that can be whole columns."""
    many = np.sort(np.unique(dims, return_counts=True)[1])[::-1][:MOST_WHOLE]
    return many[many > n // 64].sum() > 0.9 * len(dims)


def _nearest_by_floors(
    a: pd.DataFrame, nx: np.ndarray, rows: np.ndarray, dims: np.ndarray, values: np.ndarray, need: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``need`` nearest of n rows by Manhattan distance, and their distances, for each query.

    The rows are given by size and as values in the order of (rows, dimensions).
    """
    n = len(nx)
    known, place, many = np.unique(dims, return_inverse=True, return_counts=True)
    whole = np.argsort(-many, kind="stable")[:MOST_WHOLE]
    whole = whole[many[whole] > n // 64]  # a frequent dimension is a whole column, the most frequent one first
    column = np.full(len(known) + 1, -1)
    column[whole] = np.arange(len(whole))
    dense = np.zeros((n, len(whole)))
    at = column[place]
    dense[rows[at >= 0], at[at >= 0]] = values[at >= 0]
    order = np.argsort(place, kind="stable")
    starts = np.r_[0, np.cumsum(many)]
    # the first of them give the bounds, as many as there is room for
    times = np.array([next(c for share, c in CUTS if m >= share * n) for m in many[whole]], dtype=int)
    coded = int((2 * np.cumsum(times) <= MOST_CODES).sum())
    cuts = np.full((max(c for _, c in CUTS), coded), np.nan)
    cuts[0] = np.nextafter(0.0, 1.0)
    for j in range(coded):
        met = dense[dense[:, j] > 0, j]
        if times[j] > 1 and len(met):
            cuts[1 : times[j], j] = np.quantile(met, np.arange(1, times[j]) / times[j])
    floors = nb.Floors(dense[:, :coded], cuts, np.zeros(coded))
    for first in range(0, len(a), TILE_ROWS):
        part = a.iloc[first : first + TILE_ROWS]
        tile, rare = np.zeros((len(part), len(whole))), []
        for r, (i, v) in enumerate(zip(part["i"], part["v"])):
            here = np.minimum(np.searchsorted(known, i), len(known) - 1)
            here[known[here] != i] = len(known)
            met = column[here] >= 0
            tile[r, column[here[met]]] = v[met]
            rare.append([(p, x) for p, x in zip(here[~met].tolist(), v[~met].tolist()) if p < len(known)])
        low, error = floors.low(tile[:, :coded])
        single = tile[:, :coded].astype(np.float32)
        head = np.partition(low[:, : max(HEAD, need)], need - 1, axis=1)[:, need - 1]
        for r, nq in enumerate(part["nq"]):

            def gaps(some: np.ndarray) -> np.ndarray:
                shared = [np.minimum(dense.take(some[s : s + HEAD], axis=0), tile[r]).sum(axis=1) for s in range(0, len(some), HEAD)]
                shared = np.concatenate(shared)
                for p, x in rare[r]:
                    posted = order[starts[p] : starts[p + 1]]
                    place = np.minimum(np.searchsorted(rows[posted], some), len(posted) - 1)
                    shared += np.where(rows[posted[place]] == some, np.minimum(x, values[posted[place]]), 0.0)
                return nq + nx[some] - 2 * shared

            # of as many rows as are likely to hold a good limit, and always as many as are needed, the best give one
            tried = np.flatnonzero(low[r] <= head[r])
            tried = tried[np.argpartition(floors.plain(single[r], tried), need - 1)[:need]]
            limit = gaps(tried).max() + 2 * error[r] + SLACK
            near = np.flatnonzero(low[r] <= limit)
            near = near[floors.plain(single[r], near) <= limit]
            d = np.maximum(np.round(gaps(near), 12), 0.0) + 0.0
            # rows come by key, so a stable sort settles equal distances by it
            best = np.argsort(d, kind="stable")[:need]
            yield near[best], d[best]


def in_blocks(asking: DataFrame, known: DataFrame, need: int, manhattan: bool) -> DataFrame:
    """``(query, neighbour, d)``: for each row of ``asking`` its ``need`` nearest rows and more, from blocks of both sides.

    Equal rows share their neighbours and stand for each other: a row is among the nearest only if fewer than ``need``
    distinct ones, by their smallest key, come before its own.
    """
    asking, known = asking.where("query IS NOT NULL"), known.where("id IS NOT NULL")
    by_key = Window.partitionBy("entries").orderBy("id")
    counted = known.groupBy("entries", "id").agg(F.min("nx").alias("nx"), F.count(F.lit(1)).alias("c"))
    first = counted.withColumn("r", F.row_number().over(by_key)).where(F.col("r") <= need)
    copies = F.collect_list(F.struct("id", "c")).alias("copies")
    kinds = first.groupBy("entries").agg(F.min("id").alias("id"), F.min("nx").alias("nx"), copies)
    # a key may come with several rows, so kinds have numbers of their own
    kinds = stored(kinds.select("id", "nx", "entries", "copies", F.monotonically_increasing_id().alias("kind")), "kinds")
    asked = asking.groupBy("entries").agg(F.min("nq").alias("nq"))
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "asked-kinds")

    def blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> int:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).alias("e")).first()
        return max(1, math.ceil(size["n"] / most), math.ceil(size["e"] / BLOCK_ENTRIES))

    # small tables too give every core work
    cores = asked.sparkSession.sparkContext.defaultParallelism
    slices, parts = max(blocks(asked, ASKED_ROWS), min(cores, blocks(asked, 512)), min(2 * cores, blocks(asked, 4096))), blocks(kinds)
    flat = (F.col("entries._i").alias("i"), F.col("entries.v").alias("v"))
    left = asked.select(
        "query", *flat, "nq", F.pmod(F.xxhash64("query"), F.lit(slices)).alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    right = kinds.select(
        "id", "kind", *flat, "nx", F.pmod(F.xxhash64("kind"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
    )
    compare = partial(_nearest_in_block, need=need, manhattan=manhattan)
    # by number: blocks are small to move and long to compare, so partitions are not to be put together by their size
    left, right = (side.repartition(min(2000, 2 * slices * parts), "slice", "part") for side in (left, right))
    pairs = left.groupBy("slice", "part").cogroup(right.groupBy("slice", "part")).applyInPandas(
        lambda a, b: compare(a, b), "query LONG, kind LONG, id LONG, d DOUBLE"
    )
    best = Window.partitionBy("query").orderBy("d", "id")
    near = stored(pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= need).drop("r", "id"), "near-kinds")
    near = near.join(kinds.select("kind", F.explode("copies").alias("s")), "kind")
    near = near.select(F.col("query").alias("as"), "d", F.col("s.id").alias("neighbour"), F.explode(F.array_repeat(F.lit(0), F.col("s.c").cast("int"))))
    members = asking.join(asked.select("entries", F.col("query").alias("as")), "entries").select("query", "as")
    return members.join(near, "as").select("query", "neighbour", "d")


def k_nearest_sparse(
    train: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", metric: str = "euclidean", exclude_self: bool = False
) -> DataFrame:
    """``(query, neighbour, distance, rank)``: the k nearest training rows of each query, by (distance, key)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    manhattan = metric == "manhattan"
    need = k + 1 if exclude_self else k
    size = _size(manhattan)
    known = stored(train.select(F.col(key).cast("long").alias("id"), "entries", size.alias("nx")), "sparse-rows")
    asking = stored(queries.select(F.col(key).cast("long").alias("query"), "entries", size.alias("nq")), "sparse-queries")
    postings = known.select("id", "nx", F.inline("entries")).withColumnsRenamed({"_i": "i", "v": "x"})
    asked = asking.select("query", "nq", F.inline("entries")).withColumnsRenamed({"_i": "i", "v": "q"})
    terms = stored(postings.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")), "sparse-terms")
    least = stored(known.orderBy("nx", "id").limit(need).select("id", "nx"), "smallest-rows")
    empty = asking.select("query", "nq", F.lit(-1).alias("i"), F.lit(0.0).alias("q"))
    bound = stored(bounds(asked.unionByName(empty.select(*asked.columns)), postings, least, need, manhattan), "bounds")
    visited = visits(asked, terms, bound, manhattan)
    met = visited.select("i").join(terms.select("i", "n"), "i").agg(F.sum("n")).first()[0] or 0
    if met > VISITED * asking.count():
        near = in_blocks(asking, known, need, manhattan)
        near = near.where("query <> neighbour") if exclude_self else near
    else:
        always = _with_least(asking.select("query"), least).select("query", "id")
        pairs = candidates(visited, postings, terms, manhattan).unionByName(always).distinct()
        if exclude_self:
            pairs = pairs.where("query <> id")
        near = compared(pairs, asking, known, manhattan)
    best = Window.partitionBy("query").orderBy("d", "neighbour")
    ranked = near.withColumn("rank", F.row_number().over(best))
    distance = F.col("d") if manhattan else F.sqrt("d")
    return ranked.where(F.col("rank") <= k).select("query", "neighbour", distance.alias("distance"), "rank")
