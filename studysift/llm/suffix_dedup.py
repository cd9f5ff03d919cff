"""Repeated passages by the common-prefix interval tree of a sparse suffix array.

A passage of ``LENGTH`` bytes counts as repeated if it starts anywhere else too. Suffixes are taken at anchors only:
the positions where the hash of ``CORE`` bytes is the least within some passage, so equal passages share an anchor at
the same place; runs of one short unit rank last, for they would make an anchor of every unit. Anchors with a hash of their own are done with. Where one hash always comes with the same
surroundings, all passages through it are repeated, and no text is looked at. For the others the surroundings are
fetched and compared in groups of equal hash, each distinct one once: the suffixes are sorted, a stack scan over their
common prefixes yields the intervals of the tree, and within each interval a second scan over the sorted left sides
tests where the left extensions differ. What comes out are maximal repeats with all their occurrences.

A group of more than ``GROUP`` distinct surroundings is never gathered: its passages are split into those that reach
further right and those that reach further left of the anchor, which makes the shared core longer and the
surroundings shorter, so that equal ones are merged; and so on, down to single passages if need be, which equality
alone decides. Anchors are hashed within tasks; frequent ones are combined before they are shuffled, and the joins are
left to adaptive execution, which splits frequent keys.

Defined results: a null text is empty; shorter texts have no passage; repeated rows are occurrences of each other; a
null ``doc_id`` is carried along; an empty table gives an empty result. Texts of any length are read whole, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studysift.llm.common import stored, text_of
from studysift.llm.language_model import blocks

LENGTH = 200
CORE = 48
PERIOD = 16  # cores that repeat within so many bytes are anchors of last resort
REACH = LENGTH - CORE  # bytes a passage may begin before its anchor
GROUP = 1000
BROADCAST_BYTES = 64 << 20
LAST = np.uint64((1 << 64) - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# Anchors


def anchor_positions(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one run of bytes, and how far to its left and right passages have it.

    An anchor is the least hash of a passage, ties all. Its surroundings are the passages that have it as their least.
    """
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed, short = data.astype(np.uint64) + np.uint64(1), None
    factor, width = MULTIPLIER, 1
    while width < CORE - PERIOD:  # hash of twice as many bytes
        short = hashed
        hashed = hashed[:-width] * factor + hashed[width:]
        factor, width = np.uint64(int(factor) ** 2 & (1 << 64) - 1 | 1), 2 * width
    n = len(data) - CORE + 1
    periodic = np.zeros(n, bool)
    for shift in range(1, PERIOD + 1):
        again = hashed[: n + PERIOD - shift] == hashed[shift : n + PERIOD]
        if again.any():
            periodic |= again[:n] & again[PERIOD - shift :]
    hashed = hashed[:n] * MULTIPLIER + short[width : width + n]
    hashed ^= hashed >> np.uint64(29)
    hashed *= MULTIPLIER
    hashed ^= hashed >> np.uint64(32)
    hashed = hashed >> np.uint64(1) | periodic.astype(np.uint64) << np.uint64(63)
    least, width = hashed, 1
    while 2 * width <= REACH + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:])  # of the passage that starts here
    found = np.flatnonzero(_is_least(hashed, least))
    # Passages over an anchor start up to REACH before it; those with it as their least follow one another.
    padded = np.concatenate([np.full(REACH, LAST), least, np.full(REACH, LAST)])
    left, right = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    for at in range(0, len(found), 10_000):
        part = slice(at, at + 10_000)
        own = padded[found[part, None] + np.arange(REACH + 1)] == hashed[found[part], None]
        left[part] = REACH - own.argmax(axis=1)
        right[part] = LENGTH - own[:, ::-1].argmax(axis=1)
    return found, hashed[found], left, right


def _is_least(hashed: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each position, whether some passage over it has this hash as its least: the greatest of these leasts."""
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    most, width = padded, 1
    while 2 * width <= REACH + 1:
        most, width = np.maximum(most[:-width], most[width:]), 2 * width
    rest = REACH + 1 - width
    return np.maximum(most[: len(most) - rest], most[rest:]) == hashed


def anchors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id, text_key)`` of documents with anchors, and ``(row, core, around, place)`` of the anchors.

    ``core`` and ``around`` are the hashes of an anchor and of its surroundings; ``place`` holds its position and how far
    the surroundings reach to the left and to the right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        digest = xxhash.xxh64_intdigest
        row = TaskContext.get().partitionId() << 33
        for batch in blocks(batches, "text"):
            place, core, around = [], [], []
            for text in batch.column("text"):
                text = text.as_buffer()
                at, hashes, left, right = anchor_positions(np.frombuffer(text, np.uint8))
                view = memoryview(text)
                place.append((at << 20) | (left << 10) | right)
                core.append(hashes)
                spots = zip(at.tolist(), left.tolist(), right.tolist())
                around.append([digest(view[p - a : p + b], a) for p, a, b in spots])
            ends = np.concatenate([[0], np.cumsum([len(p) for p in place])]).astype(np.int32)
            lists = [
                np.concatenate(core).view(np.int64),
                np.array([u for one in around for u in one], np.uint64).view(np.int64),
                np.concatenate(place),
            ]
            columns = [pa.array(np.arange(row, row + len(batch))), batch.column("doc_id"), batch.column("text_key")]
            columns += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_key", *names])

    names = ["core", "around", "place"]
    schema = "row long, doc_id long, text_key long, " + ", ".join(f"{n} array<bigint>" for n in names)
    lists = stored(keyed(docs).mapInArrow(run, schema).filter("size(core) > 0"), "anchors")
    places = lists.select("row", F.explode(F.arrays_zip(*names)).alias("a")).select("row", "a.*")
    return lists.select("row", "doc_id", "text_key"), places


def position() -> Column:
    return F.shiftright("place", 20)


def to_left() -> Column:
    return F.shiftright("place", 10).bitwiseAND(F.lit(1023))


def to_right() -> Column:
    return F.col("place").bitwiseAND(F.lit(1023))


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, text)``, the text as bytes."""
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text")
    )


# The interval tree


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan: ``(length, first, last)`` of every interval of the tree; ``prefixes[i]`` joins i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(prefixes) + 1):
        here = prefixes[i] if i < len(prefixes) else -1
        first = i - 1
        while stack and stack[-1][0] > here:
            length, first = stack.pop()
            yield length, first, i - 1
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def maximal_repeats(members: list[tuple[bytes, bytes]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """``(left, right, occurrences)`` of the repeats through the anchor that no further byte on either side extends.

    A member is the text left of the anchor, read backwards, and the text from the anchor on.
    """
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    rights = [members[i][1] for i in order]
    for right, first, last in intervals([0] + [common(a, b) for a, b in zip(rights, rights[1:])]):
        inside = sorted(order[first : last + 1], key=lambda i: members[i][0])
        lefts = [members[i][0] for i in inside]
        if right + max(map(len, lefts)) < length:
            continue
        for left, low, high in intervals([0] + [common(a, b) for a, b in zip(lefts, lefts[1:])]):
            if left + right >= length:
                yield left, right, inside[low : high + 1]


def coverage(members: list[tuple[bytes, bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``(member, left, right)``: how far repeats through the anchor cover each member, none within another.

    As ``maximal_repeats``, with the left sides sorted once: within an interval a member's longest left extension is
    with a neighbour in that order, and it is the least common prefix between their places there.
    """
    if len(members) == 2:
        (left_a, right_a), (left_b, right_b) = members
        left, right = common(left_a, left_b), common(right_a, right_b)
        return [(0, left, right), (1, left, right)] if left + right >= length else []
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    rights = [members[i][1] for i in order]
    lefts_in_order = sorted(range(len(members)), key=lambda i: members[i][0])
    rank = np.empty(len(members), np.int64)
    rank[lefts_in_order] = np.arange(len(members))
    rank = rank[order]
    lefts = [members[i][0] for i in lefts_in_order]
    table = [np.array([common(a, b) for a, b in zip(lefts, lefts[1:])], np.int64)]
    while 2 ** len(table) < len(members):  # least of twice as many
        step = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    most = int(table[0].max())
    found = []
    for right, first, last in intervals([0] + [common(a, b) for a, b in zip(rights, rights[1:])]):
        if right + most < length:
            continue
        inside = np.sort(rank[first : last + 1])
        width = np.diff(inside)
        level = np.frexp(width)[1] - 1
        shared = np.zeros(len(width), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            shared[at] = np.minimum(table[k][inside[at]], table[k][inside[at + 1] - 2**k])
        left = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
        good = np.flatnonzero(left + right >= length)
        found += [(lefts_in_order[i], a, right) for i, a in zip(inside[good].tolist(), left[good].tolist())]
    kept, member, reach = [], -1, -1
    for i, left, right in sorted(found, key=lambda f: (f[0], -f[2], -f[1])):
        if i != member or left > reach:
            kept.append((i, left, right))
            member, reach = i, left
    return kept


def _tree(rows: DataFrame) -> DataFrame:
    """``(core, around, left, right)``: what the repeats of each group cover around its members."""

    def group(held: list[tuple]) -> list[tuple[int, int, int, int]]:
        once = list({row[:2]: row for row in held}.values())  # documents that are the same row give theirs again
        if len(once) < 2:
            return []
        found = coverage([(span[:left][::-1], span[left:]) for _, _, left, span in once])
        return [(*once[i][:2], left, right) for i, left, right in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for low, high, shared, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (low, high, shared) != key:
                    out += group(held)
                    key, held = (low, high, shared), []
                held.append(tuple(row))
            yield emit(out)
            out = []
        yield emit(group(held))

    def emit(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=["core", "around", "left", "right"])

    key = ["low", "high", "shared"]
    ordered = rows.repartition(*key).sortWithinPartitions(*key).select(*key, "core", "around", "left", "span")
    return ordered.mapInArrow(run, "core long, around long, left long, right long")


def covered_around(contexts: DataFrame, group: int = GROUP) -> DataFrame:
    """``(core, around, left, right)`` for surroundings ``(core, around, n, m, left, span)``, m of them with that core.

    ``low`` and ``high`` bound how far before the anchor the passages in question start, ``shared`` is a hash of the
    bytes that all of them have in common.
    """
    right = (F.octet_length("span") - F.col("left")).cast("long").alias("right")
    found = [contexts.filter("n > 1").select("core", "around", "left", right)]
    key = ["low", "high", "shared"]
    rows = contexts.select("*", F.lit(0).alias("low"), F.lit(REACH).alias("high"), F.col("core").alias("shared"))
    while True:
        found.append(_tree(rows.filter(F.col("m").between(2, group))))
        crowded = rows.filter(F.col("m") > group)
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, found).filter(f"left + right >= {LENGTH}")
        crowded = crowded.dropDuplicates(["core", "around", "low", "high"])
        middle = F.expr("(low + high) div 2").cast("int")
        halves = F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high")),
            F.struct((middle + 1).alias("low"), F.col("high").alias("high")),
        )
        split = crowded.withColumn("half", F.explode(halves))
        split = split.select("core", "around", "n", "left", "span", "half.low", "half.high")
        reach = F.least("left", "high").cast("long")
        split = split.filter(f"low <= left AND octet_length(span) - left >= {LENGTH} - high").select(
            "core",
            "around",
            "n",
            "low",
            "high",
            reach.alias("left"),
            F.expr(f"xxhash64(substring(span, CAST(left - low + 1 AS INT), {LENGTH} - high + low))").alias("shared"),
            F.expr(
                f"substring(span, CAST(left - least(left, high) + 1 AS INT), CAST(least(left, high) + {LENGTH} - low AS INT))"
            ).alias("span"),
        )
        split = stored(split, "split_groups").withColumn("same", F.xxhash64("span"))
        whole = [*key, "same", "left"]
        merged = stored(
            split.groupBy(*whole).agg(
                F.sum("n").alias("n"), F.min(F.struct("core", "around")).alias("first"), F.min("span").alias("span")
            ),
            "merged_groups",
        )
        several = split.drop("n", "span").join(merged.filter("n > 1").select(*whole, "span"), whole)
        found.append(several.select("core", "around", "left", right))
        sizes = merged.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1")
        rows = stored(
            merged.join(sizes, key).select("first.core", "first.around", "n", "m", "left", "span", *key), "halved_groups"
        )


def _few(spans: DataFrame) -> DataFrame:
    """Stored, and marked for broadcast if it comes to no more than ``BROADCAST_BYTES``; beyond, texts are shuffled."""
    spans = stored(spans, "spans")
    size = spans.agg(F.sum(F.size("spans") * 24 + 64)).first()[0] or 0
    return F.broadcast(spans) if size <= BROADCAST_BYTES else spans


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``(doc_id, text_key, spans)``: for each document with repeated passages, what they cover, as byte ranges."""
    documents, found = anchors(docs)
    cores = found.groupBy("core").agg(
        F.count("*").alias("n"), F.min("around").alias("least"), F.max("around").alias("most")
    )
    cores = cores.filter("n > 1").select("core", (F.col("least") == F.col("most")).alias("uniform"))
    shared = stored(found.join(cores, "core"), "shared_anchors")

    mixed = shared.filter("NOT uniform")
    wanted = mixed.groupBy("core", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("at"))
    wanted = stored(wanted, "distinct_surroundings")
    sizes = wanted.groupBy("core").agg(F.count("*").alias("m"))
    questions = wanted.join(sizes, "core").select("at.row", "at.place", "core", "around", "n", "m")
    asked = questions.groupBy("row").agg(F.collect_list(F.struct("place", "core", "around", "n", "m")).alias("asked"))
    asked = asked.join(documents, "row").drop("row")
    texts = keyed(docs)
    here = texts["doc_id"].eqNullSafe(asked["doc_id"]) & (texts["text_key"] == asked["text_key"])
    fetched = texts.join(asked, here).select("text", F.explode("asked").alias("q")).select("text", "q.*")
    start, width = (position() - to_left() + 1).cast("int"), (to_left() + to_right()).cast("int")
    contexts = fetched.select("core", "around", "n", "m", to_left().alias("left"), F.substring("text", start, width).alias("span"))
    around = covered_around(stored(contexts, "surroundings"), group)
    around = around.groupBy("core", "around").agg(F.collect_set(F.struct("left", "right")).alias("covers"))

    whole = F.array(F.struct(to_left().alias("left"), to_right().alias("right")))
    covered = shared.filter("uniform").select("row", "place", whole.alias("covers")).unionByName(
        mixed.join(around, ["core", "around"]).select("row", "place", "covers")
    )
    ranges = F.transform("covers", lambda c: F.struct((position() - c["left"]).alias("a"), (position() + c["right"]).alias("b")))
    spans = covered.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(ranges))).alias("spans"))
    # Rows that repeat have the same spans, each as an occurrence of the other.
    spans = spans.join(documents, "row").dropDuplicates(["doc_id", "text_key"])
    return spans.select("doc_id", "text_key", _joined(F.col("spans")).alias("spans"))


def _joined(spans: Column) -> Column:
    """Sorted ranges with overlapping and touching ones as one."""

    def step(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], span["b"]).alias("b"))
        meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= span["a"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(spans, F.array().cast("array<struct<a:bigint,b:bigint>>"), step)


def remove_repeats(docs: DataFrame, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, on request ``kept``, the bytes left."""
    spans, texts = _few(repeated_spans(docs, group)), keyed(docs)
    here = texts["doc_id"].eqNullSafe(spans["doc_id"]) & (texts["text_key"] == spans["text_key"])
    joined = texts.join(spans, here, "left").select(texts["doc_id"], "text", "spans.a", "spans.b")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows = []
            for doc_id, text, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                runs = merged(a or [], b or [], len(text))
                ends = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(ends[::2], ends[1::2]))
                row = (doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)
                rows.append(row)
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, schema + (", kept binary" if with_text else ""))


def merged(a: list[int], b: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the ranges that hold a whole passage of the text."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted(zip(a, b)):
        high = min(high, size)
        if high - low < LENGTH:
            continue
        if runs and low <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(high, runs[-1][1])
        else:
            runs.append((low, high))
    return runs
