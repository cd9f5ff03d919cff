"""k nearest neighbours, exact and approximate, and their vote.

Training vectors are grouped around pivots. From the distances to the pivots each query gets a bound on its k-th
distance, and by the triangle inequality only the cells within that bound can hold a neighbour. Small cells share a
block, a crowded cell is cut into blocks of bounded size and so are the queries, which makes every task bounded whatever
the data looks like. Each task returns its k best per query, never all pairs. Inside a task distances are first formed
fast, by a matrix product or in single precision; what may be among the k best within their error is compared in full.
For Manhattan distance the product gives a lower bound: each dimension is cut into a few cells, and it sums the
differences of the values that lie in different ones.

The approximate form looks only into buckets of vectors that fall on the same sides of random hyperplanes, in several
tables of such buckets. A bucket that is too large takes further hyperplanes until it is not; vectors that no plane
tells apart are dealt into blocks, and a query visits all blocks of its bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studysift.operators.storage import stored

MAX_PIVOTS = 256
BLOCK_VALUES = 2_000_000
TILE_ROWS = 32  # queries compared at once
STRIP = 2048  # rows in such a step
HEAD = 2048  # rows of a block that give a query its first limit there
CELLS = 4  # of a dimension, for lower bounds of Manhattan distances
CODED_ROWS = 128  # queries whose lower bounds are formed at once
LARGEST = 1e30  # sums of a row beyond this, or that are no numbers, leave single precision
FLOATS = T.ArrayType(T.FloatType())
METRICS = ("euclidean", "manhattan", "minkowski")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between rows of a and rows of b, formed from plain differences so equal vectors are at 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, BLOCK_VALUES // max(1, b.size))
    for at in range(0, len(a), step):
        gap = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.abs(gap).sum(axis=2) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=2))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _best_in_block(a: pd.DataFrame, b: pd.DataFrame, k: int, metric: str, exclude_self: bool) -> pd.DataFrame:
    """The k nearest rows ``(_id, _v)`` of one block for each query ``(_q, _v)`` that visits it."""
    if not len(a) or not len(b):
        return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
    b = b.sort_values("_id")
    ids, vectors, asked, v = b["_id"].to_numpy(), _matrix(b["_v"]), a["_q"].to_numpy(), _matrix(a["_v"])
    # rows come by key, so those of a query's own key are together; a key that is null is no one's own
    own = np.searchsorted(ids, asked, "left"), np.where(asked == asked, np.searchsorted(ids, asked, "right"), 0)
    n, out = len(b), []
    bounded = Floors(vectors) if metric == "manhattan" and n > max(HEAD, k) else None
    ready = None if bounded and bounded.holds else _prepared(vectors, metric)
    step = TILE_ROWS if ready else CODED_ROWS
    for at in range(0, len(v), step):
        tile, mine = v[at : at + step], [own[0][at : at + step], own[1][at : at + step]]
        if ready or not moderate(tile):
            ready = ready or _prepared(vectors, metric)
            chosen = _near_rough(tile, ready, k, metric, mine if exclude_self else None, n)
        else:
            chosen = bounded.near(tile, k, mine if exclude_self else None)
        for r, near in enumerate(chosen):
            d = _distances(tile[r : r + 1], vectors[near], metric)[0]
            if exclude_self:
                d[ids[near] == asked[at + r]] = np.inf
            # a stable sort over ascending keys settles equal distances by key
            best = np.argsort(d, kind="stable")[:k]
            out.append((np.repeat(asked[at + r], len(best)), ids[near[best]], d[best]))
    pairs = pd.DataFrame(dict(zip(("query", "neighbour", "distance"), map(np.concatenate, zip(*out)))))
    return pairs[np.isfinite(pairs["distance"])]


def _near_rough(
    tile: np.ndarray, ready: tuple[np.ndarray, np.ndarray, float], k: int, metric: str, own: list[np.ndarray] | None, n: int
) -> Iterator[np.ndarray]:
    """The rows that may be among the k nearest of each query, by distances within their error; ``own`` is left out."""
    rough, error = _rough(tile, ready, metric)
    if own:
        for r, (start, end) in enumerate(zip(*own)):
            rough[r, start:end] = np.inf
    first = np.partition(rough[:, : max(HEAD, k)], k - 1, axis=1)[:, k - 1] if n > k else np.full(len(tile), np.inf)
    for r, limit in enumerate(first + 2 * error):
        # what is not a number is compared in full
        near = np.flatnonzero(~(rough[r] > limit))
        if len(near) > k:
            near = near[~(rough[r, near] > np.partition(rough[r, near], k - 1)[k - 1] + 2 * error[r])]
        yield near


def moderate(rows: np.ndarray) -> bool:
    """Whether sums over the rows keep well inside single precision."""
    return bool((np.abs(rows).sum(axis=1) < LARGEST).all())


class Floors:
    """Lower bounds of Manhattan distances to the rows of a block, for many queries by one matrix product.

    Each dimension is cut at quantiles of the block, or at ``cuts``, rising and filled up with what is no number. Values
    in different cells are on known sides of each other, so their difference is a sum of products of what each side knows
    alone; values in the same cell count as equal.
    """

    def __init__(self, b: np.ndarray, cuts: np.ndarray | None = None, middle: np.ndarray | None = None):
        self.holds = moderate(b)
        if self.holds:
            self.cuts = np.quantile(b, np.arange(1, CELLS) / CELLS, axis=0) if cuts is None else cuts
            self.used = [np.flatnonzero(~np.isnan(c)) for c in self.cuts]
            self.middle = np.median(b, axis=0) if middle is None else middle
            self.rows = (b - self.middle).astype(np.float32)
            self.largest = np.abs(self.rows).sum(axis=1).max()
            self.columns = np.ascontiguousarray(self._codes(b, self.rows, "known").T)
            self.ones = np.ones(b.shape[1], dtype=np.float32)

    def _codes(self, v: np.ndarray, z: np.ndarray, side: str) -> np.ndarray:
        cell = np.zeros(v.shape, np.int8)
        for cut in self.cuts:
            cell += v >= cut
        above = [(cell[:, u] >= m).astype(np.float32) for m, u in enumerate(self.used, 1)]
        beside = [-z[:, u] * ((cell[:, u] == m) | (cell[:, u] == m - 1)) for m, u in enumerate(self.used, 1)]
        alone, one = (z * (cell >= 1)).sum(axis=1, keepdims=True), np.ones((len(v), 1), dtype=np.float32)
        parts = [*above, *beside, alone, one] if side == "asked" else [*beside, *above, one, alone]
        return np.concatenate(parts, axis=1, dtype=np.float32)

    def low(self, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds for rows of a tile, and how far off those of a row may be."""
        z = (tile - self.middle).astype(np.float32)
        error = (self.columns.shape[0] + 8) * 2.5e-7 * (np.abs(z).sum(axis=1) + self.largest)
        return self._codes(tile, z, "asked") @ self.columns, error

    def near(self, tile: np.ndarray, k: int, own: list[np.ndarray] | None) -> Iterator[np.ndarray]:
        """The rows that may be among the k nearest of each query; rows from ``own`` start to end are left out."""
        z = (tile - self.middle).astype(np.float32)
        low, error = self.low(tile)
        if own:
            for r, (start, end) in enumerate(zip(*own)):
                low[r, start:end] = np.inf
        head = np.partition(low[:, : max(HEAD, k)], k - 1, axis=1)[:, k - 1]
        for r, floor in enumerate(low):
            # as many rows as are likely to hold a good limit, and always k of them
            limit = self._kth(z[r], np.flatnonzero(floor <= head[r]), floor, k)[1] + 2 * error[r]
            near = np.flatnonzero(floor <= limit)
            d, limit = self._kth(z[r], near, floor, k)
            yield near[d <= limit + 2 * error[r]]

    def plain(self, z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances to some rows in single precision."""
        gap = self.rows.take(at, axis=0)
        gap -= z
        np.abs(gap, out=gap)
        return gap @ self.ones

    def _kth(self, z: np.ndarray, at: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """The same but for rows left out, and the k-th smallest of them."""
        d = self.plain(z, at)
        d[np.isinf(floor[at])] = np.inf
        return d, np.partition(d, k - 1)[k - 1]


def _prepared(b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, float]:
    """What :func:`_rough` needs of the rows it is asked for again and again: columns, a sum per row and the largest size."""
    if metric != "manhattan":
        sizes = (b * b).sum(axis=1)
        return np.ascontiguousarray(b.T), sizes, sizes.max()
    return np.ascontiguousarray(b.T.astype(np.float32)), b.sum(axis=1).astype(np.float32), np.abs(b).sum(axis=1).max()


def _rough(a: np.ndarray, ready: tuple[np.ndarray, np.ndarray, float], metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances (squared ones but for Manhattan) between rows of a and prepared rows, and how far off those of a row may be."""
    columns, sums, largest = ready
    width = a.shape[1]
    if metric != "manhattan":
        own = (a * a).sum(axis=1)
        return own[:, None] + sums[None, :] - 2.0 * (a @ columns), (width + 8) * 1e-15 * (own + largest)
    # |x - y| is twice the larger one less both
    out = np.zeros((len(a), len(sums)), dtype=np.float32)
    left, larger = a.T.astype(np.float32), np.empty((len(a), STRIP), dtype=np.float32)
    for at in range(0, len(sums), STRIP):
        some = out[:, at : at + STRIP]
        one = larger[:, : some.shape[1]]
        for x, y in zip(left, columns[:, at : at + STRIP]):
            some += np.maximum(x[:, None], y[None, :], out=one)
        some *= 2
        some -= a.sum(axis=1).astype(np.float32)[:, None] + sums[None, at : at + STRIP]
    return out, (width + 8) * 2.5e-7 * (np.abs(a).sum(axis=1) + largest)


def k_nearest(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    key: str,
    vector: str,
    metric: str = "euclidean",
    exclude_self: bool = False,
    pivots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``(query, neighbour, distance, rank)``: the k nearest training rows of each query, by (distance, key).

    ``vector`` is an array of doubles without nulls. Minkowski means its usual power of 2. Only the pivots, their
    radii and k gaps per cell (all bounded) come to the driver.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    # single precision stays so on its way
    kind = "array<float>" if train.schema[vector].dataType == queries.schema[vector].dataType == FLOATS else "array<double>"
    train = train.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast(kind).alias("_v"))
    queries = queries.select(F.col(key).cast("long").alias("_q"), F.col(vector).cast(kind).alias("_v"))
    pivots = pivots or min(MAX_PIVOTS, max(1, math.isqrt(train.count()) // 2))
    picked = train.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(pivots).collect()
    if not picked:
        return train.sparkSession.createDataFrame([], "query LONG, neighbour LONG, distance DOUBLE, rank INT")
    centres = np.array([row["_v"] for row in picked], dtype=float)
    block_rows = block_rows or max(64, BLOCK_VALUES // centres.shape[1])

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["_v"]), centres, metric)
                yield pdf.assign(_cell=d.argmin(axis=1).astype("int32"), _gap=d.min(axis=1))

    celled = train.mapInPandas(to_cells, f"_id LONG, _v {kind}, _cell INT, _gap DOUBLE")
    need = k + 1 if exclude_self else k
    sizes = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_gap").alias("r")).collect()
    closest = (
        celled.select("_cell", "_gap")
        .withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy("_gap")))
        .where(F.col("_r") <= need)
        .collect()
    )
    count, radius = np.zeros(len(centres), dtype=int), np.full(len(centres), -np.inf)
    for row in sizes:
        count[row["_cell"]], radius[row["_cell"]] = row["n"], row["r"]
    near_cell = np.array([row["_cell"] for row in closest])
    near_gap = np.array([row["_gap"] for row in closest])
    # cells are put together as long as a block holds them
    blocks, home, filled = [], np.zeros(len(centres), dtype="int32"), 0
    for cell in np.argsort(_distances(centres[:1], centres, metric)[0], kind="stable"):
        if not blocks or filled + count[cell] > block_rows:
            blocks.append(1)
            filled = 0
        filled += count[cell]
        blocks[-1] = math.ceil(filled / block_rows)
        home[cell] = len(blocks) - 1
    n_queries = queries.count()
    # queries of small tables too are dealt to every core
    slices = max(1, math.ceil(n_queries / block_rows), min(queries.sparkSession.sparkContext.defaultParallelism, n_queries // 1024))

    def to_reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["_v"]), centres, metric)
                # the k-th smallest sum of two sides bounds the k-th distance; the factor absorbs rounding
                reach = d[:, near_cell] + near_gap
                at = min(need, reach.shape[1]) - 1
                bound = np.partition(reach, at, axis=1)[:, at] if reach.shape[1] >= need else np.full(len(d), np.inf)
                hit = (count > 0) & (d - radius <= bound[:, None] * (1 + 1e-9) + 1e-9)
                yield pdf.assign(_groups=[np.unique(home[h]) for h in hit])

    reached = (
        queries.mapInPandas(to_reach, f"_q LONG, _v {kind}, _groups ARRAY<INT>")
        .select("_q", "_v", F.explode("_groups").alias("_group"))
        .withColumn("_slice", F.pmod(F.xxhash64("_q"), F.lit(slices)).cast("int"))
    )
    n_blocks = F.get(F.array(*[F.lit(max(1, b)) for b in blocks]), F.col("_group"))
    left = reached.select(
        "_q", "_v", "_group", "_slice", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("_block")
    )
    grouped = celled.select("_id", "_v", F.get(F.array(*[F.lit(int(h)) for h in home]), F.col("_cell")).alias("_group"))
    right = grouped.withColumn("_block", F.pmod(F.xxhash64("_id"), n_blocks.cast("long")).cast("int")).select(
        "_id", "_v", "_group", "_block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")
    )

    compare = partial(_best_in_block, k=k, metric=metric, exclude_self=exclude_self)
    keys = ["_group", "_block", "_slice"]
    pairs = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(lambda a, b: compare(a, b), "query LONG, neighbour LONG, distance DOUBLE")
    )
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


TABLES = 16
BUCKET_ROWS = 512
SAMPLE_ROWS = 20_000
LEVELS = 40
STEP = 2


def k_nearest_approx(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    key: str,
    vector: str,
    metric: str = "euclidean",
    exclude_self: bool = False,
    tables: int = TABLES,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 42,
) -> DataFrame:
    """The same rows as :func:`k_nearest`, found in random-projection buckets; some true neighbours may be missed.

    Only the planes' offsets are fitted, as medians over about ``SAMPLE_ROWS`` training rows chosen by a hash; every
    row is indexed. A query whose buckets hold fewer than k rows in all is answered exactly.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    train = stored(train.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")), "vectors")
    queries = stored(queries.select(F.col(key).cast("long").alias("_q"), F.col(vector).cast("array<double>").alias("_v")), "asked")
    n = train.count()
    share = int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, n)))
    sample = train.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share).select("_v").limit(2 * SAMPLE_ROWS).collect()
    if not sample:
        return k_nearest(train.withColumnRenamed("_id", key), queries.withColumnRenamed("_q", key), k, key, "_v", metric, exclude_self)
    known = np.array([row["_v"] for row in sample], dtype=float)
    planes = np.random.default_rng(seed).normal(size=(tables * LEVELS, known.shape[1]))
    offsets = np.median(known @ planes.T, axis=0)
    bits = np.left_shift(np.int64(1), np.arange(LEVELS - 1, -1, -1, dtype=np.int64))

    def to_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                side = (_matrix(pdf["_v"]) @ planes.T > offsets).reshape(len(pdf), tables, LEVELS)
                yield pdf.drop(columns="_v").assign(_codes=list((side * bits).sum(axis=2)))

    def coded(rows: DataFrame, name: str) -> DataFrame:
        codes = rows.mapInPandas(to_codes, f"{name} LONG, _codes ARRAY<LONG>")
        return codes.select(name, F.posexplode("_codes").alias("_table", "_code")).withColumn("_depth", F.lit(first))

    first = min(LEVELS, max(0, math.floor(math.log2(max(1, n / bucket_rows)))))
    sides = {name: stored(coded(rows, name), "codes") for name, rows in (("_id", train), ("_q", queries))}
    bucket = ["_table", "_depth", "_prefix"]

    def prefixed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_prefix", F.expr(f"shiftright(_code, CAST({LEVELS} - _depth AS INT))"))

    def sizes() -> DataFrame:
        return prefixed(sides["_id"]).groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))

    for depth in range(first, LEVELS, STEP):
        crowded = stored(sizes().where((F.col("_n") > bucket_rows) & (F.col("_depth") == depth)).drop("_n"), "crowded")
        if crowded.isEmpty():
            break
        deeper = F.when(F.col("_more"), F.least(F.col("_depth") + STEP, F.lit(LEVELS))).otherwise(F.col("_depth"))
        for name, rows in sides.items():
            # at most one crowded bucket for each bucket_rows rows and table
            joined = prefixed(rows).join(crowded.withColumn("_more", F.lit(True)), bucket, "left")
            sides[name] = stored(joined.select(name, "_table", "_code", deeper.alias("_depth")), "codes")

    blocks = sizes().select(*bucket, F.ceil(F.col("_n") / bucket_rows).alias("_blocks"))
    block = F.pmod(F.xxhash64("_id"), F.col("_blocks"))
    right = prefixed(sides["_id"]).join(blocks, bucket).select("_id", *bucket, block.alias("_block")).join(train, "_id")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    left = prefixed(sides["_q"]).join(blocks, bucket).select("_q", *bucket, every.alias("_block")).join(queries, "_q")
    keys = [*bucket, "_block"]
    compare = partial(_best_in_block, k=k, metric=metric, exclude_self=exclude_self)
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: compare(a, b), "query LONG, neighbour LONG, distance DOUBLE"
    )
    pairs = stored(pairs.dropDuplicates(["query", "neighbour"]), "near-pairs")
    found = pairs.groupBy("query").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(k, n - exclude_self))
    short = queries.join(found, queries["_q"] == found["query"], "left_anti")
    if not short.isEmpty():
        rest = k_nearest(train.withColumnRenamed("_id", key), short.withColumnRenamed("_q", key), k, key, "_v", metric, exclude_self)
        pairs = pairs.unionByName(rest.drop("rank")).dropDuplicates(["query", "neighbour"])
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame, weights: str = "uniform") -> DataFrame:
    """``(query, label, share)``: the class with the largest vote and its share; the smallest class on ties.

    ``labels`` is ``(neighbour, label)``. With ``distance`` a vote weighs 1/d, and neighbours at distance 0, where
    there are any, vote alone.
    """
    shares = vote_shares(neighbours, labels, weights)
    best = F.max_by(F.struct("label", "share"), F.struct(F.round("share", 9), -F.col("label")))
    return shares.groupBy("query").agg(best.alias("b")).select("query", "b.*")


def vote_shares(neighbours: DataFrame, labels: DataFrame, weights: str = "uniform") -> DataFrame:
    """``(query, label, share)`` for every class among a query's neighbours."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    named = neighbours.join(labels, "neighbour")
    own = Window.partitionBy("query")
    if weights == "uniform":
        weighed = named.withColumn("_w", F.lit(1.0))
    else:
        exact = F.min("distance").over(own) == 0
        inverse = F.try_divide(F.lit(1.0), F.col("distance"))
        weighed = named.withColumn("_w", F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(inverse))
    by_class = weighed.groupBy("query", "label").agg(F.sum("_w").alias("_w"))
    return by_class.select("query", "label", (F.col("_w") / F.sum("_w").over(own)).alias("share"))
