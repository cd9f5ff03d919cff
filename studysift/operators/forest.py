"""A random forest of deep trees that is whole nowhere: rows and subtrees stay with the tasks.

A deep forest has about as many nodes as its trees have rows, more than a driver holds. Here rows are binned once (one
byte a value, cut as the library does) and every tree draws its bag by a hash of the row, so that a seed gives one model
whatever the layout. While a node has more rows than a task should take, its split comes from counts that the tasks add
up; the driver knows only these top nodes. The rows of every smaller node meet in one task, which grows the whole subtree
and writes it down. To predict, rows go down the top and then meet the subtrees they came to, packed by node.

Splits, leaves and votes follow the library: the best cut of a random subset of features at each node, no split without
gain, two leaves that come to the same class are one, and a tree votes with the weighted class shares of its leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studysift.operators.storage import stored

BINS = 32
SAMPLE_ROWS = 10_000
SAMPLE_VALUES = 4_000_000
GROUP_VALUES = 20_000_000  # of the rows whose subtree one task grows
PACK_VALUES = 4_000_000
HISTOGRAM = 1_000_000  # counts held at once while a level is grown in a task
TOP_HISTOGRAM = 8_000_000  # counts of the top nodes of one pass
PART_ROWS = 16_384


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    least: int  # rows of a child
    impurity: str
    weights: tuple[float, float]  # of the classes
    seed: int
    width: int

    @property
    def subset(self) -> int:
        return math.ceil(math.sqrt(self.width))


@dataclass
class Tree:
    """Children (-1 for none), feature and last bin to the left, and rows of each class; node 0 is the root."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    rows: np.ndarray

    def walk(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The node that each of some rows of ``x`` comes to."""
        at = np.zeros(len(rows), np.int64)
        going = np.flatnonzero(self.left[at] >= 0)
        while len(going):
            here = at[going]
            to_left = x[rows[going], self.feature[here]] <= self.cut[here]
            at[going] = np.where(to_left, self.left[here], self.right[here])
            going = going[self.left[at[going]] >= 0]
        return at

    def pack(self) -> tuple[bytes, ...]:
        kinds = (np.int32, np.int32, np.int32, np.uint8, np.int64)
        return tuple(np.ascontiguousarray(a, dtype=t).tobytes() for a, t in zip((self.left, self.right, self.feature, self.cut, self.rows), kinds))

    @staticmethod
    def unpack(left: bytes, right: bytes, feature: bytes, cut: bytes, rows: bytes) -> Tree:
        parts = [np.frombuffer(a, t) for a, t in ((left, np.int32), (right, np.int32), (feature, np.int32), (cut, np.uint8), (rows, np.int64))]
        return Tree(*parts[:4], parts[4].reshape(-1, 2))


def cuts_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Where the library cuts a feature: between all its values if they are few, else at equal weights."""
    known, place = np.unique(values, return_inverse=True)
    if len(known) <= BINS:
        return (known[:-1] + known[1:]) / 2
    weight = np.bincount(place, weights)
    sums, stride = np.cumsum(weight), weight.sum() / BINS
    cuts, target = [], stride
    for i in range(1, len(known)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            cuts.append((known[i - 1] + known[i]) / 2)
            target += stride
    return np.array(cuts[: BINS - 1])


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for j, known in enumerate(cuts):
        out[:, j] = np.searchsorted(known, values[:, j], "left")
    return out


def _impurity(rows: np.ndarray, s: Settings) -> np.ndarray:
    """The impurity of nodes times their weight, from the rows of each class in the last axis."""
    a, b = rows[..., 0] * s.weights[0], rows[..., 1] * s.weights[1]
    n = a + b
    if s.impurity == "gini":
        return n - np.divide(a * a + b * b, n, out=np.zeros_like(n), where=n > 0)
    return sum(sign * v * np.log2(v, out=np.zeros_like(v), where=v > 0) for sign, v in ((1, n), (-1, a), (-1, b)))


def best_splits(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether there is a split with gain, place of its feature, cut, rows to the left) of nodes.

    ``counts`` are rows by node, feature, bin and class.
    """
    left = counts.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    left = left[:, :, :-1, :]
    right = total - left
    gain = _impurity(total, s) - _impurity(left, s) - _impurity(right, s)
    enough = np.minimum(left.sum(axis=3), right.sum(axis=3)) >= s.least
    gain = np.where(enough, gain, -np.inf).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    nodes = np.arange(len(counts))
    place, cut = best // (BINS - 1), best % (BINS - 1)
    weight = (total[:, 0, 0, :] * s.weights).sum(axis=1)
    return gain[nodes, best] > 1e-12 * weight, place, cut, left[nodes, place, cut]


def _chosen(rng: np.random.Generator, nodes: int, s: Settings) -> np.ndarray:
    """The features that each of some nodes may be split by."""
    if s.subset >= s.width:
        return np.tile(np.arange(s.width), (nodes, 1))
    return np.sort(np.argpartition(rng.random((nodes, s.width), dtype=np.float32), s.subset, axis=1)[:, : s.subset], axis=1)


def _histogram(x: np.ndarray, y: np.ndarray, bag: np.ndarray, rows: np.ndarray, slot: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Rows by node, feature, bin and class of ``rows``, which lie in the nodes ``slot``."""
    n, f = chosen.shape
    place = (slot[:, None] * f + np.arange(f)) * BINS + x[rows[:, None], chosen[slot]]
    place = place * 2 + y[rows][:, None]
    counted = np.bincount(place.ravel(), np.repeat(bag[rows], f), n * f * BINS * 2)
    return np.rint(counted).astype(np.int64).reshape(n, f, BINS, 2)


def _open(rows: np.ndarray, s: Settings) -> np.ndarray:
    """Which nodes can be split further, from their rows of each class."""
    return (rows.min(axis=-1) > 0) & (rows.sum(axis=-1) >= 2 * s.least)


def grow(x: np.ndarray, y: np.ndarray, bag: np.ndarray, depth: int, s: Settings, rng: np.random.Generator) -> Tree:
    """The subtree over binned rows, ``depth`` levels at most, level by level and pruned."""
    first = np.rint(np.bincount(y, bag, 2)).astype(np.int64)
    left, right, feature, cut = ([np.full(1, v)] for v in (-1, -1, -1, 0))
    known, at, size = [first[None]], np.zeros(len(x), np.int64), 1
    start = 0  # of the last level
    for _ in range(depth):
        level = known[-1]
        active = np.flatnonzero(_open(level, s))
        if not len(active):
            break
        slot_of = np.full(len(level), -1)
        slot_of[active] = np.arange(len(active))
        rows = np.flatnonzero(at >= start)
        slot = slot_of[at[rows] - start]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        step = max(1, HISTOGRAM // (s.subset * BINS * 2))
        children = []
        for a in range(0, len(active), step):
            part = active[a : a + step]
            chosen = _chosen(rng, len(part), s)
            lo, hi = np.searchsorted(slot, (a, a + len(part)))
            mine, where = rows[lo:hi], slot[lo:hi] - a
            good, place, cuts, to_left = best_splits(_histogram(x, y, bag, mine, where, chosen), s)
            split = part[good]
            if not len(split):
                continue
            first_child = size + np.arange(len(split)) * 2
            left[-1][split], right[-1][split] = first_child, first_child + 1
            feature[-1][split], cut[-1][split] = chosen[good, place[good]], cuts[good]
            children.append(np.stack([to_left[good], level[split] - to_left[good]], axis=1).reshape(-1, 2))
            size += 2 * len(split)
            here = at[mine] - start
            goes = left[-1][here] >= 0
            mine, here = mine[goes], here[goes]
            to = x[mine, feature[-1][here]] <= cut[-1][here]
            at[mine] = np.where(to, left[-1][here], right[-1][here])
        if not children:
            break
        start += len(level)
        known.append(np.concatenate(children))
        for column, v in ((left, -1), (right, -1), (feature, -1), (cut, 0)):
            column.append(np.full(len(known[-1]), v))
    return pruned(Tree(*map(np.concatenate, (left, right, feature, cut, known))), s)


def pruned(tree: Tree, s: Settings, classes: dict[int, int | None] | None = None) -> Tree:
    """The tree without splits into two leaves of the same class, its nodes numbered anew from the root.

    ``classes`` gives the class of leaves that others continue, None where they are no leaves in the end; with it the
    numbers of the nodes are kept.
    """
    left, right = tree.left.copy(), tree.right.copy()
    named = (tree.rows[:, 1] * s.weights[1] > tree.rows[:, 0] * s.weights[0]).astype(int)
    mark = np.where(left < 0, named, -1)  # the class of what is a leaf
    for node, one in (classes or {}).items():
        mark[node] = -1 if one is None else one
    for i in range(len(left) - 1, -1, -1):  # children have larger numbers than their parent
        if left[i] >= 0 and mark[left[i]] >= 0 and mark[left[i]] == mark[right[i]]:
            left[i] = right[i] = -1
            mark[i] = named[i]
    if classes is not None:
        return replace(tree, left=left, right=right)
    level, kept = np.zeros(1, np.int64), []
    while len(level):
        kept.append(level)
        inner = level[left[level] >= 0]
        level = np.stack([left[inner], right[inner]], axis=1).ravel()
    kept = np.concatenate(kept)
    number = np.full(len(left) + 1, -1)
    number[kept] = np.arange(len(kept))
    return Tree(number[left[kept]], number[right[kept]], tree.feature[kept], tree.cut[kept], tree.rows[kept])


def _mixed(v: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed well."""
    v = v + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def bags(keys: np.ndarray, seed: int, trees: int) -> np.ndarray:
    """How often each row, by a hash of it, is in the bag of each tree: Poisson numbers of mean 1."""
    stream = _mixed(np.arange(trees, dtype=np.uint64) + _mixed(np.array([seed & (2**64 - 1)], dtype=np.uint64)))
    drawn = _mixed(keys.view(np.uint64)[:, None] ^ stream[None, :])
    return np.searchsorted(POISSON, (drawn >> np.uint64(11)) * 2.0**-53, "right").astype(np.uint8)


def _unpacked(pack: pd.Series, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(pack["x"], np.uint8).reshape(-1, s.width)
    return x, np.frombuffer(pack["y"], np.uint8), np.frombuffer(pack["bag"], np.uint8).reshape(len(x), -1)


def fit(train: DataFrame, n: int, s: Settings) -> DeepForest:
    """A forest over ``(doc_id, features, label)`` of ``n`` rows."""
    weight = F.when(F.col("label") == 1, s.weights[1]).otherwise(s.weights[0])
    sample_rows = max(1024, min(SAMPLE_ROWS, SAMPLE_VALUES // s.width))
    key = F.xxhash64("doc_id")
    share = min(1.0, 1.2 * sample_rows / max(1, n))
    sample = train.select(vector_to_array("features").alias("v"), weight.alias("w"), key.alias("h"))
    sample = sample.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("h").limit(sample_rows).collect()
    values, w = np.array([r["v"] for r in sample], dtype=float).reshape(-1, s.width), np.array([r["w"] for r in sample])
    cuts = [cuts_of(column, w) for column in values.T]

    def to_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, copies = None, 0
        for pdf in batches:
            step = max(1, PACK_VALUES // s.width)
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                keys = part["h"].to_numpy().astype(np.int64)
                extra = np.zeros(len(keys), np.uint64)
                for i, h in enumerate(keys.tolist()):  # rows of one key draw apart
                    last, copies = h, copies + 1 if h == last else 0
                    extra[i] = copies
                drawn = bags((keys.view(np.uint64) ^ (extra * np.uint64(0xD6E8FEB86659FD93))).view(np.int64), s.seed, s.trees)
                x = binned(np.array(part["v"].tolist(), dtype=float).reshape(-1, s.width), cuts)
                yield pd.DataFrame({"x": [x.tobytes()], "y": [part["y"].to_numpy().astype(np.uint8).tobytes()], "bag": [drawn.tobytes()]})

    rows = train.select(key.alias("h"), vector_to_array("features").alias("v"), F.col("label").alias("y"))
    rows = rows.repartition(max(1, math.ceil(n / PART_ROWS)), "h").sortWithinPartitions("h", "y", "v")
    packs = stored(rows.mapInPandas(to_packs, "x BINARY, y BINARY, bag BINARY"), "binned")
    trees, waiting = _grow_tops(packs, s)
    subtrees = _grow_subtrees(packs, trees, waiting, s)
    # what the pruning of the top needs: whether a subtree is a leaf, and its class
    ends = subtrees.where(F.octet_length("left") == 4).select("tree", "node", "rows").collect()
    classes = [dict.fromkeys(nodes) for nodes in waiting]
    for r in ends:
        a, b = np.frombuffer(r["rows"], np.int64) * s.weights
        classes[r["tree"]][r["node"]] = int(b > a)
    tops = [pruned(tree, s, known) for tree, known in zip(trees, classes)]
    return DeepForest(s, n, cuts, tops, [frozenset(nodes) for nodes in waiting], subtrees)


def _grow_tops(packs: DataFrame, s: Settings) -> tuple[list[Tree], list[dict[int, int]]]:
    """The top of every tree, and the nodes below which a task goes on, with their depth."""
    most = max(1, GROUP_VALUES // s.width)
    empty = np.zeros((1, 2), np.int64)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((s.trees, 2), np.int64)
        for pdf in batches:
            for _, pack in pdf.iterrows():
                _, y, bag = _unpacked(pack, s)
                total += np.stack([bag[y == c].sum(axis=0, dtype=np.int64) for c in (0, 1)], axis=1)
        yield pd.DataFrame({"tree": np.arange(s.trees), "a": total[:, 0], "b": total[:, 1]})

    found = packs.mapInPandas(sizes, "tree INT, a LONG, b LONG").groupBy("tree").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    trees = [Tree(np.full(1, -1), np.full(1, -1), np.full(1, -1), np.zeros(1, np.int64), empty.copy()) for _ in range(s.trees)]
    for r in found.collect():
        trees[r["tree"]].rows[0] = r["a"], r["b"]
    waiting: list[dict[int, int]] = [{} for _ in trees]
    large: dict[tuple[int, int], int] = {}

    def sort_out(tree: int, node: int, depth: int) -> None:
        rows = trees[tree].rows[node]
        if depth < s.depth and _open(rows, s):
            if rows.sum() > most:
                large[tree, node] = depth
            else:
                waiting[tree][node] = depth

    for t in range(s.trees):
        sort_out(t, 0, 0)
    at_once = max(1, TOP_HISTOGRAM // (s.subset * BINS * 2))
    while large:
        now = {at: large.pop(at) for at in list(large)[:at_once]}
        chosen = {(t, node): _chosen(np.random.default_rng([s.seed & 0xFFFFFFFF, t, node, 1]), 1, s)[0] for t, node in now}
        for (t, node), split in _top_splits(packs, trees, chosen, s).items():
            tree, (feature, cut, to_left) = trees[t], split
            size = len(tree.left)
            tree.left[node], tree.right[node], tree.feature[node], tree.cut[node] = size, size + 1, feature, cut
            grown = [np.append(column, [v, v]) for column, v in ((tree.left, -1), (tree.right, -1), (tree.feature, -1), (tree.cut, 0))]
            trees[t] = Tree(*grown, np.concatenate([tree.rows, [to_left, tree.rows[node] - to_left]]))
            for child in (size, size + 1):
                sort_out(t, child, now[t, node] + 1)
    return trees, waiting


def _top_splits(packs: DataFrame, trees: list[Tree], chosen: dict[tuple[int, int], np.ndarray], s: Settings) -> dict:
    """The split of each of some top nodes that has one: ``(tree, node): (feature, cut, rows to the left)``."""
    asked: dict[int, list[int]] = {}
    for t, node in chosen:
        asked.setdefault(t, []).append(node)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for _, pack in pdf.iterrows():
                x, y, bag = _unpacked(pack, s)
                for t, nodes in asked.items():
                    rows = np.flatnonzero(bag[:, t])
                    slot_of = np.full(len(trees[t].left), -1)
                    slot_of[nodes] = np.arange(len(nodes))
                    slot = slot_of[trees[t].walk(x, rows)]
                    rows, slot = rows[slot >= 0], slot[slot >= 0]
                    got = _histogram(x, y, bag[:, t], rows, slot, np.array([chosen[t, node] for node in nodes]))
                    sums[t] = sums[t] + got if t in sums else got
        for t, nodes in asked.items():
            if t in sums:
                yield pd.DataFrame({"tree": t, "node": nodes, "counts": [c.tobytes() for c in sums[t]]})

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).reshape(1, s.subset, BINS, 2)
        good, place, cut, to_left = best_splits(counts, s)
        t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        feature = int(chosen[t, node][place[0]])
        out = {"tree": t, "node": node, "feature": feature, "cut": cut, "a": to_left[:, 0], "b": to_left[:, 1]}
        return pd.DataFrame(out)[good]

    counted = packs.mapInPandas(count, "tree INT, node INT, counts BINARY").groupBy("tree", "node")
    found = counted.applyInPandas(lambda pdf: split(pdf), "tree INT, node INT, feature INT, cut INT, a LONG, b LONG")
    rows = sorted(found.collect())
    return {(r["tree"], r["node"]): (r["feature"], r["cut"], np.array([r["a"], r["b"]])) for r in rows}


NODES = "left BINARY, right BINARY, feature BINARY, cut BINARY, rows BINARY"


def _grow_subtrees(packs: DataFrame, trees: list[Tree], waiting: list[dict[int, int]], s: Settings) -> DataFrame:
    """``(tree, node, ...)``: what grows below the waiting nodes, each in one task."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, pack in pdf.iterrows():
                x, y, bag = _unpacked(pack, s)
                for t, tree in enumerate(trees):
                    rows = np.flatnonzero(bag[:, t])
                    out = [(t, node, rows[at]) for node, at in _by_node(tree.walk(x, rows)) if node in waiting[t]]
                    if out:
                        yield pd.DataFrame(
                            [(t, node, x[at].tobytes(), y[at].tobytes(), bag[at, t].tobytes()) for t, node, at in out],
                            columns=["tree", "node", "x", "y", "bag"],
                        )

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        x, y, bag = (np.frombuffer(b"".join(pdf[c]), np.uint8) for c in ("x", "y", "bag"))
        rng = np.random.default_rng([s.seed & 0xFFFFFFFF, t, node, 2])
        tree = grow(x.reshape(-1, s.width), y, bag, s.depth - waiting[t][node], s, rng)
        return pd.DataFrame([(t, node, *tree.pack())], columns=["tree", "node", *Tree.__dataclass_fields__])

    dealt = packs.mapInPandas(deal, "tree INT, node INT, x BINARY, y BINARY, bag BINARY").groupBy("tree", "node")
    return stored(dealt.applyInPandas(lambda pdf: below(pdf), f"tree INT, node INT, {NODES}"), "subtrees")


def _by_node(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each node with the places that hold it."""
    order = np.argsort(at, kind="stable")
    nodes, starts = np.unique(at[order], return_index=True)
    return zip(nodes.tolist(), np.split(order, starts[1:]))


@dataclass(frozen=True)
class DeepForest:
    """The tops of the trees and the table of the subtrees below them."""

    settings: Settings
    fitted_on: int
    cuts: list[np.ndarray]
    tops: list[Tree]
    waiting: list[frozenset[int]]
    subtrees: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``pred`` and ``proba`` of class 1."""
        s, cuts, tops, waiting = self.settings, self.cuts, self.tops, self.waiting
        rows = stored(df.withColumn("_row", F.monotonically_increasing_id()), "asked-rows")

        def to_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pack = TaskContext.get().partitionId() << 32
            for pdf in batches:
                step = max(1, PACK_VALUES // s.width)
                for a in range(0, len(pdf), step):
                    part = pdf.iloc[a : a + step]
                    x = binned(np.array(part["v"].tolist(), dtype=float).reshape(-1, s.width), cuts)
                    ids = part["_row"].to_numpy().astype(np.int64)
                    yield pd.DataFrame({"pack": [pack], "n": [len(ids)], "ids": [ids.tobytes()], "x": [x.tobytes()]})
                    pack += 1

        asked = rows.select("_row", vector_to_array("features").alias("v"))
        asked = stored(asked.mapInPandas(to_packs, "pack LONG, n INT, ids BINARY, x BINARY"), "asked-packs")

        def votes(nodes: np.ndarray, tree: Tree) -> bytes:
            weighed = tree.rows[nodes] * np.array(s.weights)
            return (weighed / weighed.sum(axis=1, keepdims=True)).tobytes()

        def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, pack in pdf.iterrows():
                    x = np.frombuffer(pack["x"], np.uint8).reshape(-1, s.width)
                    for t, top in enumerate(tops):
                        out = []
                        for node, at in _by_node(top.walk(x, np.arange(len(x)))):
                            more = node in waiting[t] and top.left[node] < 0
                            vote = None if more else votes(np.full(len(at), node), top)
                            out.append((pack["pack"], t, node, at.astype(np.int32).tobytes(), x[at].tobytes() if more else None, vote))
                        yield pd.DataFrame(out, columns=["pack", "tree", "node", "at", "x", "vote"])

        def further(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a):
                return pd.DataFrame(columns=["pack", "tree", "at", "vote"], dtype=object)
            tree = Tree.unpack(*b.iloc[0][list(Tree.__dataclass_fields__)])
            out = []
            for pack, t, at, x in zip(a["pack"], a["tree"], a["at"], a["x"]):
                x = np.frombuffer(x, np.uint8).reshape(-1, s.width)
                out.append((pack, t, at, votes(tree.walk(x, np.arange(len(x))), tree)))
            return pd.DataFrame(out, columns=["pack", "tree", "at", "vote"])

        met = stored(asked.mapInPandas(down, "pack LONG, tree INT, node INT, at BINARY, x BINARY, vote BINARY"), "asked-nodes")
        # where more rows are asked than were fitted on, a subtree meets them in several tasks
        slices = max(1, math.ceil(rows.count() / self.fitted_on))
        keys = ["tree", "node", "slice"]
        open_rows = met.where("vote IS NULL").withColumn("slice", F.pmod(F.xxhash64("pack"), F.lit(slices)).cast("int"))
        subtrees = self.subtrees.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        voted = open_rows.drop("vote").groupBy(*keys).cogroup(subtrees.groupBy(*keys)).applyInPandas(
            lambda a, b: further(a, b), "pack LONG, tree INT, at BINARY, vote BINARY"
        )
        voted = voted.unionByName(met.where("vote IS NOT NULL").select("pack", "tree", "at", "vote"))
        # the rows of a pack by their numbers meet the votes on them
        voted = voted.unionByName(asked.select("pack", F.lit(-1).alias("tree"), F.col("ids").alias("at"), F.lit(None).cast("binary").alias("vote")))

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.frombuffer(pdf.loc[pdf["tree"] < 0, "at"].iloc[0], np.int64)
            total = np.zeros((len(ids), 2))
            # added up in the order of the trees
            for at, vote in pdf[pdf["tree"] >= 0].sort_values("tree", kind="stable")[["at", "vote"]].itertuples(index=False):
                total[np.frombuffer(at, np.int32)] += np.frombuffer(vote, float).reshape(-1, 2)
            share = total / total.sum(axis=1, keepdims=True)
            return pd.DataFrame({"_row": ids, "pred": (share[:, 1] > share[:, 0]).astype(np.int32), "proba": share[:, 1]})

        scored = voted.groupBy("pack").applyInPandas(lambda pdf: summed(pdf), "_row LONG, pred INT, proba DOUBLE")
        return rows.join(scored, "_row").select(*df.columns, "pred", "proba")
