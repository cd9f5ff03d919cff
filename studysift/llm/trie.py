"""Conversation prefix tries as double arrays, one per prefix shard.

A node is a distinct sequence of first turns. The fingerprint of a prefix is the exclusive or of two 64-bit hashes of
each of its turns with its position, so it runs along a conversation as a running total and the parent's fingerprint is
that of the child without its last turn. Conversations with equal sequences are one from the start, with their number.

Nodes with more than ``SHARD_ROWS`` turns below them are upper nodes, shared by several shards; the root always is one.
Each sequence belongs to the shard of its first node that is not an upper node. Shards are dealt by hash into tasks of
about ``TASK_ROWS`` turns, and each task packs its part of the trie into the arrays BASE and CHECK over dense turn ids:
the child of state s by turn t stands at BASE[s] + t and has CHECK = s. Sequences are walked through the arrays to
count, and aggregates rise from child to CHECK. Upper nodes, however many sequences share them, are merged globally:
counts by a combine before the shuffle, sums over subtrees as running totals along one sequence for each node, to which
the shards add what their topmost node has.

Running totals along a conversation are taken within range-dealt parts and shifted by the totals of the parts before,
so a conversation may be longer than a task's share. The ids that end at a node are hashed in order from pieces made in
parallel.

Defined results: rows without a ``conv_id`` belong to no conversation; null turns come first; rows of one conversation
with the same turn number are ordered by a hash of role and text; a null role or text is empty; an empty table gives an
empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studysift.llm.common import small, stored

FAMILY = 20
BORROWED = 4
SHARD_ROWS = 20_000
TASK_ROWS = 100_000
STRETCH = 4096  # turns of one conversation that are joined under one key
WORD = r"[^\x20\x09-\x0D]+"
NODE = "depth long, f1 long, f2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, parent_conv_id long, top boolean"
NO_IDS = hashlib.sha256(b"").hexdigest()


def along(
    rows: DataFrame, order: Sequence[str], name: str, sums: dict[str, Column] = {}, xors: dict[str, Column] = {}
) -> DataFrame:
    """``rows`` with running sums and exclusive ors along each ``conv_id``; no task has to take a whole conversation."""
    ordered = [F.col(c).asc_nulls_first() for c in order]
    parts = rows.withColumns(sums | xors).repartitionByRange("conv_id", *ordered)
    parts = stored(parts.withColumn("part", F.spark_partition_id()), name)

    def total(k: str) -> Column:
        return F.sum(k) if k in sums else F.bit_xor(k)

    names = [*sums, *xors]
    whole = parts.groupBy("conv_id", "part").agg(*[total(k).alias(k) for k in names])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = whole.select("conv_id", "part", *[total(k).over(before).alias(f"{k}_shift") for k in names])
    # only what a conversation has in its second and later parts is shifted: at most one row per part
    shift = small(stored(shift.filter(F.col(f"{names[0]}_shift").isNotNull()), f"{name}_shift"), 60)
    here = Window.partitionBy("conv_id", "part").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    run = parts.select(*rows.columns, "part", *[total(k).over(here).alias(k) for k in names])
    run = run.join(shift, ["conv_id", "part"], "left")

    def shifted(k: str) -> Column:
        by = F.coalesce(f"{k}_shift", F.lit(0))
        return (F.col(k) + by if k in sums else F.col(k).bitwiseXOR(by)).alias(k)

    return run.select(*rows.columns, *[shifted(k) for k in names])


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(BORROWED))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, t1, t2, words)`` of every rebuilt turn, and ``(conv_id, turns)`` of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = along(turns, ["turn", "t1", "t2"], "turns", {"at": F.lit(1).cast("long")}).drop("turn")
    placed = stored(placed, "placed_turns")
    sizes = stored(placed.groupBy("conv_id").agg(F.count("*").alias("size")), "conversations")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = sizes.select("conv_id", "size", family.alias("first"), borrowed(F.col("conv_id")).alias("h"))
    heads = placed.filter((F.col("at") < BORROWED) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.select(F.col("conv_id").alias("first"), F.col("at").alias("depth"), "t1", "t2", "words")
    taken = convs.join(heads, "first").filter("depth <= h")
    lead = taken.groupBy("conv_id").agg(F.count("*").alias("lead"))
    own = placed.withColumn("h", borrowed(F.col("conv_id"))).filter("at > h")
    # the turns that a conversation takes, three at most, come along as one small row per conversation
    own = _along_stretches(own, lead, "at").select(
        "conv_id", (F.col("at") - F.col("h") + F.coalesce("lead", F.lit(0))).alias("depth"), "t1", "t2", "words"
    )
    length = F.coalesce("lead", F.lit(0)) + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    lengths = convs.join(lead, "conv_id", "left").select("conv_id", length.alias("turns"))
    return taken.select("conv_id", "depth", "t1", "t2", "words").unionByName(own), lengths


def _along_stretches(rows: DataFrame, facts: DataFrame, at: str) -> DataFrame:
    """Left join of rows with one row per conversation, a long conversation under several keys.

    ``facts`` may carry ``turns``, the length; without it they are copied for as many stretches as there are.
    """
    stretch = F.floor(F.col(at) / STRETCH)
    keyed = rows.withColumn("stretch", stretch)
    if "turns" in facts.columns:
        copies = facts.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("turns") / STRETCH))))
        return keyed.join(copies, ["conv_id", "stretch"], "left").drop("stretch")
    seen = keyed.select("conv_id", "stretch").distinct()
    return keyed.join(seen.join(facts, "conv_id"), ["conv_id", "stretch"], "left").drop("stretch")


def place(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the end state of sequences, each a run of ``codes``; state 0 is the root, codes count from 1.

    Level by level the distinct pairs of state and code become children. A state with one child puts it in the next
    free place; one with several looks for a gap that takes all of them and goes behind the last place otherwise.
    """
    base, check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
    check[0] = 0
    end, free = 1, 1
    state = np.zeros(len(sizes), np.int64)

    def room(n: int) -> None:
        nonlocal base, check
        if n > len(check):
            more = max(n, 2 * len(check)) - len(check)
            base = np.concatenate([base, np.zeros(more, np.int64)])
            check = np.concatenate([check, np.full(more, -1, np.int64)])

    for depth in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > depth)
        code = codes[starts[on] + depth]
        edges = np.unique(np.stack([state[on], code], axis=1), axis=0)
        parents, first, count = np.unique(edges[:, 0], return_index=True, return_counts=True)
        for parent, at, n in zip(parents[count > 1].tolist(), first[count > 1].tolist(), count[count > 1].tolist()):
            own = edges[at : at + n, 1]
            span = int(own[-1] - own[0])
            room(end + span + 2)
            tries = free + np.flatnonzero(check[free : min(end, free + 64)] < 0)
            spot = next((t for t in tries.tolist() if (check[t + own - own[0]] < 0).all()), end)
            base[parent] = spot - own[0]
            check[spot + own - own[0]] = parent
            end = max(end, spot + span + 1)
        single = parents[count == 1]
        room(end + len(single) + 1)
        gaps = free + np.flatnonzero(check[free:end] < 0)[: len(single)]
        spots = np.concatenate([gaps, np.arange(end, end + len(single) - len(gaps))])
        base[single] = spots - edges[first[count == 1], 1]
        check[spots] = single
        end += len(single) - len(gaps)
        if len(gaps) < len(single):
            free = end
        elif len(gaps):
            free = int(gaps[-1]) + 1
        state[on] = base[state[on]] + code
    return base[:end], check[:end], state


def _task_nodes(part: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the shards of one task, from rows with a shard's name ``r1, r2`` and their sequence's ``copies``."""
    part = part.sort_values(["conv_id", "depth"], ignore_index=True)
    conv = part["conv_id"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    sizes = np.diff(np.append(starts, len(conv)))
    # dense turn ids; a shard's topmost node is known by its fingerprint, as shards may begin at different depths
    first = np.zeros(len(conv), bool)
    first[starts] = True
    turn = np.stack([np.where(first, part["r1"], part["t1"]), np.where(first, part["r2"], part["t2"]), first], axis=1)
    _, at, code = np.unique(turn, axis=0, return_index=True, return_inverse=True)
    rank = np.empty(len(at), np.int64)  # in the order in which they are met, so that siblings stay close
    rank[np.argsort(at, kind="stable")] = np.arange(len(at))
    code = rank[code.reshape(-1)] + 1
    base, check, last = place(code, starts, sizes)

    copies, ids = part["copies"].to_numpy(), conv
    n_convs, least = np.zeros(len(check), np.int64), np.full(len(check), np.iinfo(np.int64).max)
    row_of = np.zeros(len(check), np.int64)
    state = np.zeros(len(starts), np.int64)
    levels: list[np.ndarray] = []
    for depth in range(int(sizes.max())):
        on = np.flatnonzero(sizes > depth)
        rows = starts[on] + depth
        to = base[state[on]] + code[rows]
        if (check[to] != state[on]).any():
            raise AssertionError("a child does not stand under its parent")
        np.add.at(n_convs, to, copies[rows])
        np.minimum.at(least, to, ids[rows])
        row_of[to] = rows
        state[on] = to
        levels.append(np.unique(to))
    used = np.concatenate(levels)
    n_children = np.bincount(check[used], minlength=len(check))
    leaves = np.zeros(len(check), np.int64)
    leaves[used] = n_children[used] == 0
    words = np.zeros(len(check), np.int64)
    words[used] = part["words"].to_numpy()[row_of[used]]
    saved = (n_convs - 1) * words
    for own in reversed(levels[1:]):
        np.add.at(leaves, check[own], leaves[own])
        np.add.at(saved, check[own], saved[own])
    shown = part.iloc[row_of[used]]
    parent = check[used]
    inner = parent != 0
    return pd.DataFrame(
        {
            "depth": shown["depth"].to_numpy(),
            "f1": shown["f1"].to_numpy(),
            "f2": shown["f2"].to_numpy(),
            "conv_id": least[used],
            "n_convs": n_convs[used],
            "n_children": n_children[used],
            "n_leaves": leaves[used],
            "saved_tokens": saved[used],
            "words": words[used],
            "parent_conv_id": pd.Series(np.where(inner, least[parent], 0), dtype="Int64").where(inner),
            "top": ~inner,
        }
    )


def ends_hashed(ends: DataFrame) -> DataFrame:
    """``(depth, f1, f2, ends_sha256)``: the ids of ``(depth, f1, f2, conv_id)`` in ascending order, joined and hashed."""
    key = ["depth", "f1", "f2"]
    order = [*key, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, firsts, texts = [], [], []
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for name, own in groupby(rows, key=itemgetter(0, 1, 2)):
                ids = [row[3] for row in own]
                names.append(name)
                firsts.append(ids[0])
                texts.append(",".join(map(str, ids)))
            columns = [pa.array([n[i] for n in names], pa.int64()) for i in range(3)]
            columns += [pa.array(firsts, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *name, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if name != held:
                    if held is not None:
                        done.append((*held, state.hexdigest()))
                    held, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
            yield _rows(done)
        if held is not None:
            yield _rows([(*held, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        columns = [pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[*key, "ends_sha256"])

    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = dealt.mapInArrow(pieces, "depth long, f1 long, f2 long, first long, ids string")
    gathered = joined.repartition(*key).sortWithinPartitions(*key, "first")
    return gathered.mapInArrow(hashed, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, lengths = rebuilt(conversations)
    key = ["depth", "f1", "f2"]
    h1, h2 = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "t1", "depth")
    rows = turns.withColumns({"h1": h1, "h2": h2})
    rows = along(rows, ["depth"], "rebuilt_turns", xors={"f1": F.col("h1"), "f2": F.col("h2")})
    rows = stored(rows, "prefixes")

    # sequences: conversations that end at the same node
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("f1", "f2"), "depth").alias("e"))
    ends = lengths.join(last, "conv_id", "left").select(
        "conv_id", F.col("turns").alias("depth"), F.coalesce("e.f1", F.lit(0)).alias("f1"), F.coalesce("e.f2", F.lit(0)).alias("f2")
    )
    ends = stored(ends, "ends")
    sequences = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    sequences = stored(sequences.select("conv_id", F.col("depth").alias("turns"), "copies"), "sequences")
    distinct = _along_stretches(rows, sequences, "depth").filter("copies IS NOT NULL")
    distinct = stored(distinct, "distinct_prefixes")

    # upper nodes, and where each sequence leaves them
    heavy = distinct.groupBy(*key).agg(F.sum(F.col("turns") - F.col("depth") + 1).alias("below"))
    heavy = small(stored(heavy.filter(F.col("below") > shard_rows).select(*key), "upper_nodes"), 40)
    inner = stored(distinct.join(heavy, key, "left_semi"), "upper_prefixes")
    down = inner.groupBy("conv_id").agg(F.max("depth").alias("upper"))
    tops = sequences.join(down, "conv_id", "left").select("conv_id", "turns", "copies", F.coalesce("upper", F.lit(0)).alias("upper"))
    tops = stored(tops, "sequence_tops")
    lower = _along_stretches(distinct.drop("turns", "copies"), tops, "depth").filter("depth > upper")
    lower = stored(lower, "lower_prefixes")
    topmost = lower.filter("depth = upper + 1").select("conv_id", F.col("f1").alias("r1"), F.col("f2").alias("r2"))

    tasks = max(1, -(-lower.count() // task_rows))
    roots = topmost.join(tops.select("conv_id", "turns"), "conv_id")
    dealt = _along_stretches(lower.drop("turns"), roots, "depth").drop("turns")
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("r1", "r2"), F.lit(tasks)))
    packed = dealt.groupBy("task").applyInPandas(_task_nodes, NODE)
    packed = stored(packed, "packed_nodes")

    # upper nodes: one row of each sequence per upper node, the root first
    at_root = tops.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f1"),
                          F.lit(0).cast("long").alias("f2"), F.lit(0).cast("long").alias("words"), "turns", "copies",
                          F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    shared = at_root.unionByName(inner.select(*at_root.columns))
    shared = stored(shared, "upper_rows")
    upper = shared.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("words").alias("words"),
        F.min(F.col("f1").bitwiseXOR(F.col("h1"))).alias("p1"), F.min(F.col("f2").bitwiseXOR(F.col("h2"))).alias("p2"),
    )
    upper = stored(upper, "upper_counts")
    top = packed.filter("top").drop("parent_conv_id")
    # a topmost node's parent is that of any of its sequences: its fingerprint without the last turn
    own_hash = lower.filter("depth = upper + 1").select(
        *key, F.col("f1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("f2").bitwiseXOR(F.col("h2")).alias("p2")
    )
    top = stored(top.join(own_hash.distinct(), key), "topmost_nodes")
    below = upper.filter("depth > 0").select("depth", "p1", "p2").unionByName(top.select("depth", "p1", "p2"))
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    upper = upper.join(children.agg(F.count("*").alias("n_children")), key, "left")
    upper = stored(upper.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "upper_children")

    # sums over subtrees: each node's own share is put on the row of its smallest conversation
    own = upper.select(*key, "conv_id", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    from_shards = top.groupBy("conv_id", (F.col("depth") - 1).alias("depth")).agg(
        F.sum("saved_tokens").alias("saved"), F.sum("n_leaves").alias("leaf")
    )
    gifts = own.select("conv_id", "depth", "saved", "leaf").unionByName(from_shards.select("conv_id", "depth", "saved", "leaf"))
    gifts = gifts.groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    shared = shared.select("conv_id", *key).join(gifts, ["conv_id", "depth"], "left")
    shared = shared.select("conv_id", *key, (-F.col("depth")).alias("rise"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "leaf")])
    rising = along(shared, ["rise"], "rising", {"saved_up": F.col("saved"), "leaf_up": F.col("leaf")})
    sums = rising.groupBy(*key).agg(F.sum("saved_up").alias("saved_tokens"), F.sum("leaf_up").alias("n_leaves"))
    upper = stored(upper.join(sums, key), "upper_sums")

    # parents of upper and of topmost nodes are upper nodes
    known = small(stored(upper.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id")), "parents"), 60)
    facts = ["conv_id", *key, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    high = upper.unionByName(top.drop("top")).join(known, ["depth", "p1", "p2"], "left").select(*facts)
    nodes = high.unionByName(packed.filter("NOT top").select(*facts))
    found = nodes.join(stored(ends_hashed(ends), "ends_hashed"), key, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
