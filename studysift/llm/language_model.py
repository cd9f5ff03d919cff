"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words with one space between them and an end mark after them. Each byte is coded as eight
binary decisions; every decision has Krichevsky-Trofimov counts under the contexts of 0 to ``DEPTH`` bytes before it,
and context-tree weighting mixes the estimates of all depths, with weights that follow from how well each depth codes
the training texts as a whole. A context that training never met has no say. The word model beside it is an add-one
unigram.

Counting: tasks merge their (DEPTH + 1)-byte strings and words before the shuffle. The tree is worked out where the
strings lie, dealt by the two bytes before the coded one, so a key has at most 256^DEPTH-1 strings; the two depths above
have at most 65,280 nodes and pass through the driver. Scoring: the strings and words that make up nearly all text, at
most ``COMMON_STRINGS`` and ``COMMON_WORDS`` of them, are sent to the tasks; all the others are joined by key, and no
such key is frequent. Nothing is left out. Tasks take texts in small batches, hold the strings of a piece of a block at
a time, and share one compact table of the frequent strings.

Defined results: a null text is empty, and an empty text is its end mark; a null id counts as empty text for the fold;
repeated rows are learnt from and scored each; without training texts every decision has probability one half; an empty
table gives an empty result. Long texts are scored whole, in blocks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studysift.llm.common import stored
from studysift.llm.toxicity import bucket

DEPTH = 5
FOLD, HELD_OUT = 7, 2
COMMON_STRINGS = 1 << 20
COMMON_WORDS = 300_000
END = b"\xff"  # no byte of UTF-8
BLOCK = 1 << 20
PIECE = 1 << 17  # strings of a block that are looked up at a time
BATCH_BYTES = 4 << 20  # of texts that go to a worker at a time
BATCH_ROWS = 1 << 16  # that a worker returns at a time
HELD_ENTRIES = 1_000_000  # strings a task holds before it merges them
MOST_MERGED = 750_000  # distinct ones beyond which it hands them on
LN10 = float(np.log(10))


# Texts as arrays


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words of each text; an empty text has one empty word."""
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    return pc.ascii_split_whitespace(clean)


def bytes_of(words: pa.ListArray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, whether a string of a single text starts at each, and where each text's strings end."""
    joined = pc.binary_join(words, " ").cast(pa.large_binary())
    before = pa.scalar(END * depth, pa.large_binary())
    end, nothing = pa.scalar(END, pa.large_binary()), pa.scalar(b"", pa.large_binary())
    padded = pc.binary_join_element_wise(before, joined, end, nothing)
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts = np.ones(max(len(data) - depth, 0), bool)
    starts[(offsets[1:-1, None] - depth + np.arange(depth)).ravel()] = False
    return data, starts, offsets[1:] - depth * np.arange(1, len(offsets))


def strings_in(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The (depth + 1)-byte strings that start at these places, as numbers."""
    strings = np.zeros(len(starts), np.uint64)
    for i in range(depth + 1):
        np.left_shift(strings, np.uint64(8), out=strings)
        np.bitwise_or(strings, data[i : i + len(starts)], out=strings)
    return strings[starts]


def strings_of(words: pa.ListArray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every (depth + 1)-byte string of each text as a number, and where each text's strings end."""
    data, starts, ends = bytes_of(words, depth)
    return strings_in(data, starts, depth), ends


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``BLOCK`` bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            floor = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, floor + BLOCK)))
            yield batch.slice(start, stop - start)
            start = stop


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, tasks of actions get batches of about ``BATCH_BYTES``, however long the texts of 10,000 rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task after which its worker, which later stages use again, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps it and has this
            if trim:
                trim(0)

    return run


def returned(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns as batches of ``BATCH_ROWS``."""
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    for start in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(start, BATCH_ROWS)


# Counting


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) for i in (1, 2)]
    return key[first], sums[0], sums[1]


def count_strings(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(string, learnt, seen)``: how often each string stands in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in blocks(batches, "text"):
            strings, ends = strings_of(words_of(batch.column("text")), depth)
            held = np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
            for part, factor in ((strings[~held], 1), (strings[held], 0)):
                key, n = np.unique(part, return_counts=True)
                parts.append((key, n * factor, n))
            if sum(len(p[0]) for p in parts) > HELD_ENTRIES:
                parts = [_merged(parts)]
                if len(parts[0][0]) > MOST_MERGED:
                    yield from as_batches(parts.pop())
        if parts:
            yield from as_batches(_merged(parts))

    def as_batches(part: tuple) -> Iterator[pa.RecordBatch]:
        return returned([c.astype(np.int64) for c in part], ["string", "learnt", "seen"])

    counted = docs.mapInArrow(frugal(run), "string long, learnt long, seen long")
    return counted.groupBy("string").agg(F.sum("learnt").alias("learnt"), F.sum("seen").alias("seen"))


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, learnt, seen)`` for every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in blocks(batches, "text"):
            words = words_of(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            learnt = pa.array(np.repeat(~held, length).astype(np.int64))
            table = pa.table({"word": words.flatten(), "learnt": learnt})
            found = table.group_by("word").aggregate([("learnt", "sum"), ("learnt", "count")])
            parts.append(found.rename_columns(["word", "learnt", "seen"]))
            if sum(map(len, parts)) > MOST_MERGED // 2:
                parts = [merged(parts)]
                if len(parts[0]) > MOST_MERGED // 4:
                    yield from parts.pop().to_batches()
        if parts:
            yield from merged(parts).to_batches()

    def merged(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by("word").aggregate([("learnt", "sum"), ("seen", "sum")])
        return found.rename_columns(["word", "learnt", "seen"])

    counted = docs.mapInArrow(frugal(run), "word string, learnt long, seen long").filter("word != ''")
    return counted.groupBy("word").agg(F.sum("learnt").alias("learnt"), F.sum("seen").alias("seen"))


# The tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after eight steps of the recurrence."""
    steps = np.log(x)
    for i in range(1, 8):
        steps = steps + np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


SMALL = 4096
HALVES, WHOLES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to any order of these bits."""
    total = zeros + ones
    out = np.zeros(len(total))
    few = np.flatnonzero(total < SMALL)
    out[few] = HALVES[zeros[few]] + HALVES[ones[few]] - WHOLES[total[few]]
    many = np.flatnonzero(total >= SMALL)
    z, o = zeros[many].astype(float), ones[many].astype(float)
    out[many] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1.0)
    return out - np.log(np.pi)


class Nodes:
    """The decisions at one bit level under the contexts of one depth.

    The key is the context's bytes and the bits decided so far under a leading one, in ascending order.
    """

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.key, self.zeros, self.ones = key, zeros.astype(np.int64), ones.astype(np.int64)
        self.own = self.weighted = kt_block(self.zeros, self.ones)
        self.share = np.ones(len(key))  # of the estimate here against those under longer contexts

    def over(self, key: np.ndarray, weighted: np.ndarray) -> Nodes:
        """Take in the nodes under longer contexts, whose keys end in these."""
        if len(self.key):
            below = np.bincount(np.searchsorted(self.key, key), weights=weighted, minlength=len(self.key))
            self.share = 1 / (1 + np.exp(np.clip(below - self.own, -700, 700)))
            self.weighted = np.logaddexp(self.own, below) - np.log(2)
        return self

    def mix(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of the bit at these nodes, given that under longer contexts; NaN where none was met."""
        zeros, ones, share = self.zeros[at], self.ones[at], self.share[at]
        own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
        both = np.where(np.isnan(deeper), own, share * own + (1 - share) * deeper)
        return np.where(zeros + ones > 0, both, deeper)


class Layer:
    """The distinct strings at one depth, from which the nodes of each bit level follow."""

    def __init__(self, string: np.ndarray, learnt: np.ndarray, depth: int) -> None:
        part = string & mask(depth + 1)
        order = np.argsort(part, kind="stable")
        ordered = part[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(part) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        self.of_string = np.zeros(len(part), np.int32)  # its place among the distinct ones
        self.of_string[order] = np.cumsum(fresh) - 1
        self.distinct = ordered[first]
        self.count = np.add.reduceat(learnt[order], first) if len(first) else np.zeros(0, np.int64)

    def nodes(self, level: int) -> tuple[Nodes, np.ndarray]:
        """The nodes of a level, and each string's node."""
        key = self.distinct & ~np.uint64(255) | prefix(self.distinct, level)
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        ones = self.count * bits(self.distinct, level)
        sums = [np.add.reduceat(c, start) if len(start) else c for c in (self.count - ones, ones)]
        return Nodes(key[start], *sums), (np.cumsum(new, dtype=np.int32) - 1)[self.of_string]


def mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def bits(string: np.ndarray, level: int) -> np.ndarray:
    return (string >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)


def prefix(string: np.ndarray, level: int) -> np.ndarray:
    """Bits of the last byte decided before this level, under a leading one."""
    return np.uint64(1 << level) | (string & np.uint64(255)) >> np.uint64(8 - level)


def deep_layers(string: np.ndarray, learnt: np.ndarray, depth: int) -> dict[int, Layer]:
    """Depth 2 and below, of strings whose two bytes before the last lie together."""
    return {d: Layer(string, learnt, d) for d in range(depth, 1, -1)}


def deep_nodes(layers: dict[int, Layer], level: int) -> dict[int, tuple[Nodes, np.ndarray]]:
    """The nodes of a bit level at all these depths, longest contexts first, and each string's node."""
    made: dict[int, tuple[Nodes, np.ndarray]] = {}
    for d, layer in layers.items():
        nodes, at = layer.nodes(level)
        if d + 1 in made:
            deeper = made[d + 1][0]
            nodes.over(deeper.key & mask(d + 1), deeper.weighted)
        made[d] = nodes, at
    return made


def code_lengths(string: np.ndarray, layers: dict[int, Layer], shallow: dict[int, Nodes]) -> np.ndarray:
    """Natural log of the probability of each string's last byte after the others."""
    total = np.zeros(len(string))
    for level in range(8):
        bit = bits(string, level)
        p = np.full(len(string), np.nan)
        for nodes, at in deep_nodes(layers, level).values():
            p = nodes.mix(at, bit, p)
        for d in (1, 0):  # all levels in one
            key = string & mask(d + 1) & ~np.uint64(255) | prefix(string, level)
            nodes = shallow[d]
            at = np.minimum(np.searchsorted(nodes.key, key), max(len(nodes.key) - 1, 0))
            if len(nodes.key):
                p = np.where(nodes.key[at] == key, nodes.mix(at, bit, p), p)
        total += np.log(np.where(np.isnan(p), 0.5, p))
    return total


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = [tuple(c.to_numpy() for c in b.columns) for b in batches]
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    string, learnt, seen = (np.concatenate(c) for c in zip(*held))
    return string.astype(np.uint64), learnt, seen


def string_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(string, seen, log_p)`` of every string that stands in any text."""
    dealt = counts.repartition(F.expr("shiftright(string, 8) & 65535"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string, learnt, _ = _columns(batches)
        layers = deep_layers(string, learnt, depth)
        for level in range(8):
            nodes = deep_nodes(layers, level)[2][0]
            columns = [nodes.key.astype(np.int64), nodes.zeros, nodes.ones, nodes.weighted]
            yield from returned(columns, ["key", "zeros", "ones", "weighted"])

    names = ("zeros", "ones", "weighted")
    first = dealt.mapInArrow(frugal(second), "key long, zeros long, ones long, weighted double")
    first = first.groupBy(F.expr("key & 65535").alias("key")).agg(*[F.sum(c).alias(c) for c in names])
    found = first.orderBy("key").toPandas()  # 65,280 rows at most
    key = found["key"].to_numpy(np.int64).astype(np.uint64)
    zeros, ones = found["zeros"].to_numpy(np.int64), found["ones"].to_numpy(np.int64)
    one, root = Nodes(key, zeros, ones), _merged([(key & np.uint64(255), zeros, ones)])
    # What lies below a node of depth 1 has been summed over its longer contexts already.
    shallow = {1: one.over(key, found["weighted"].to_numpy(float))}
    shallow[0] = Nodes(*root).over(key & np.uint64(255), one.weighted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string, learnt, seen = _columns(batches)
        layers = deep_layers(string, learnt, depth)
        columns = [string.astype(np.int64), seen, code_lengths(string, layers, shallow)]
        yield from returned(columns, ["string", "seen", "log_p"])

    return dealt.mapInArrow(frugal(score), "string long, seen long, log_p double")


# Scoring


class Lookup:
    """Open-addressing table from distinct 64-bit keys to numbers; its slots hold the places of the keys."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        bits = max(4, int(2 * len(key)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key, self.value, self.at = key, value, np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(key), np.arange(len(key), dtype=np.int32)
        while len(left):
            free = left[self.at[slot[left]] < 0]
            self.at[slot[free]] = free  # of several keys one stays
            left = left[self.at[slot[left]] != left]
            slot[left] = slot[left] + 1 & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * self.MIX >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values of the keys; NaN for those that are not there."""
        out = np.full(len(key), np.nan)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            at = self.at[slot]
            taken = at >= 0
            slot, left, at = slot[taken], left[taken], at[taken]
            hit = self.key[at] == key[left]
            out[left[hit]] = self.value[at[hit]]
            slot, left = slot[~hit] + 1 & self.last, left[~hit]
        return out


def values_of(words: pa.ListArray, depth: int, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The value of every string, zero for those not in the table, their places and themselves, and where texts end."""
    data, starts, ends = bytes_of(words, depth)
    value, rare, strings, done = np.zeros(int(starts.sum())), [], [], 0
    for i in range(0, len(starts), PIECE):
        part = strings_in(data[i : i + PIECE + depth], starts[i : i + PIECE], depth)
        found = lookup.get(part)
        missing = np.flatnonzero(np.isnan(found))
        found[missing] = 0.0
        value[done : done + len(part)] = found
        rare.append(missing + done)
        strings.append(part[missing])
        done += len(part)
    return value, np.concatenate(rare), np.concatenate(strings), ends


def common(counts: DataFrame, most: int) -> DataFrame:
    """The entries seen at least as often as the lowest power of two that leaves no more than ``most`` of them."""
    power = F.floor(F.log2("seen")).cast("int")
    sizes = {r["p"]: r["n"] for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}
    floor, total = 62, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > most:
            break
        floor = p
    return counts.filter(F.col("seen") >= (1 << floor))


def scores(docs: DataFrame, depth: int = DEPTH, strings: int = COMMON_STRINGS, words: int = COMMON_WORDS) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    held = bucket("doc_id", FOLD) == HELD_OUT
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    with small_batches(docs.sparkSession):
        counted = stored(count_words(texts.select("held_out", "text")), "word_counts")
        strings_seen = stored(count_strings(texts.select("held_out", "text"), depth), "strings")
    table = stored(string_scores(strings_seen, depth), "string_scores")

    trained = texts.agg(F.sum(F.when(~F.col("held_out"), 1).otherwise(0))).first()[0] or 0
    sums = counted.agg(F.sum("learnt"), F.sum((F.col("learnt") > 0).cast("long"))).first()
    tokens, distinct = (sums[0] or 0) + trained, (sums[1] or 0) + (trained > 0)
    below = float(np.log10(tokens + distinct + 1))

    top = common(table, strings).select("string", "log_p").toArrow()  # ``strings`` at most
    known = common(counted, words).select("word", "learnt").toArrow()  # ``words`` at most
    lookup = Lookup(top["string"].to_numpy().astype(np.uint64), top["log_p"].to_numpy())
    word_key, word_count = known["word"].combine_chunks(), known["learnt"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((lookup, word_key, word_count))

    schema = (
        "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, log_p double, "
        "strings array<bigint>, words array<string>"
    )
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lookup, word_key, word_count = sent.value
        row = TaskContext.get().partitionId() << 33
        end_log = np.log10(trained + 1) - below
        for batch in blocks(batches, "text"):
            texts = words_of(batch.column("text"))
            n = len(texts)
            value, rare, rare_strings, ends = values_of(texts, depth, lookup)
            total = np.add.reduceat(value, np.concatenate([[0], ends[:-1]]))
            rare_ends = np.searchsorted(rare, ends)

            flat = texts.flatten()
            stop = np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))
            coded = flat.dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=word_key), -1).to_numpy(zero_copy_only=False)
            c = np.where(at >= 0, word_count[at] if len(word_count) else 0, 0)
            empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
            index = coded.indices.to_numpy()
            log_word = np.where(at >= 0, np.log10(c + 1.0) - below, 0.0)[index]
            is_known = ((at >= 0) & (c > 0))[index]
            is_rare = ((at < 0) & ~empty)[index]
            first = np.concatenate([[0], stop[:-1]])
            rare_word = np.flatnonzero(is_rare)
            columns = [
                pa.array(np.arange(row, row + n)),
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(np.diff(ends, prepend=0)),
                pa.array(np.add.reduceat((~empty[index]).astype(np.int64), first) + 1),
                pa.array(np.add.reduceat(is_known.astype(np.int64), first) + int(trained > 0)),
                pa.array(np.add.reduceat(log_word, first) + end_log),
                pa.array(total),
                pa.ListArray.from_arrays(np.concatenate([[0], rare_ends]).astype(np.int32), rare_strings.astype(np.int64)),
                pa.ListArray.from_arrays(
                    np.concatenate([[0], np.searchsorted(rare_word, stop)]).astype(np.int32), flat.take(pa.array(rare_word))
                ),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=names)

    with small_batches(docs.sparkSession):
        rows = stored(texts.mapInArrow(frugal(run), schema), "scored")
    rare_strings = (
        rows.select("row", F.explode("strings").alias("string"))
        .join(table.select("string", "log_p"), "string")
        .groupBy("row")
        .agg(F.sum("log_p").alias("more_log_p"))
    )
    seen = F.coalesce("learnt", F.lit(0))
    rare_words = (
        rows.select("row", F.explode("words").alias("word"))
        .join(counted.select("word", "learnt"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(seen + 1) - below).alias("more_base"), F.sum((seen > 0).cast("long")).alias("more_known"))
    )
    plain = rows.drop("strings", "words")
    joined = plain.join(rare_strings, "row", "left").join(rare_words, "row", "left")
    log_p = F.col("log_p") + F.coalesce("more_log_p", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (log_p / LN10).alias("score"),
        (-log_p / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
