"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become token ids with an end mark; only those longer than a sequence are cut. Pieces are dealt by hash into
groups of about ``GROUP`` pieces, and each group is packed on its own, longest piece first: with N(g) the number of
open sequences that have g places left, a piece goes where the sum of N(g) squared becomes smallest, ties to the
tightest gap. A group's state is one number per gap and the numbers of its open sequences. A larger group would save no
more than the few sequences that each group leaves unfilled: on real lengths they are under a thousandth of all.

Defined results: a null text is empty; an empty text is its end mark alone; a null ``doc_id`` is carried along;
repeated rows are packed each; an empty table gives an empty result. Texts of any length are cut by the stated rule.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studysift.llm.common import stored

SEQUENCE = 4096
END = 1
GROUP = 16_384
BATCH = 2048
REMEMBERED = 500_000  # words whose ids a worker keeps at hand; others are looked up anew
BREAK = "<|endoftext|>"  # a special token of the vocabulary, put between words that are tokenised in one call
WORD_END = "</w>"  # the vocabulary's last token of a word ends with it
MARKS = ".,;:!?"
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
MARKED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)").fullmatch
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every node where the package of vocabularies is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Token ids of a text by way of its words: each distinct word is tokenised once and remembered.

    Words of Latin letters, with or without a mark behind them, are the most: they are kept in lower case and without
    the mark, which this vocabulary reads as a token of its own. The last token of such a word ends with the
    vocabulary's word end, so many can be tokenised in one line. All other words are kept as they stand.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.break_id = tokenizer.encode_batch_fast, tokenizer.token_to_id(BREAK)
        self.last = np.zeros(tokenizer.get_vocab_size(), bool)
        self.last[[number for token, number in tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.mark_ids = np.array([0] + [self._encoded([mark])[0] for mark in MARKS], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _encoded(self, lines: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, np.uint32) for e in self.encode(lines, add_special_tokens=False)])

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters one after another, and how many each has."""
        flat = self._encoded([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)])
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = self._encoded([BREAK.join(words[i : i + 64]) + BREAK for i in range(0, len(words), 64)])
        ends = np.flatnonzero(flat == self.break_id)
        return flat[flat != self.break_id], np.diff(ends, prepend=-1) - 1

    def _odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.encode(words, add_special_tokens=False)]
        return np.concatenate([np.array(g, np.uint32) for g in got]), np.array([len(g) for g in got])

    def _learn(self, words: list[str]) -> None:
        kinds: dict[str, list[str]] = {"_plain": [], "_others": [], "_odd": []}
        for word in words:
            kinds["_plain" if PLAIN(word) else "_odd" if BREAK in word else "_others"].append(word)
        for name, own in kinds.items():
            if own:
                flat, count = getattr(self, name)(own)
                at, end = len(self.number), len(self.number) + len(own)
                self.number.update(zip(own, range(at, end)))
                self.first, self.count = _room(self.first, end), _room(self.count, end)
                self.flat = _room(self.flat, self.used + len(flat))
                self.first[at:end], self.count[at:end] = self.used + np.cumsum(count) - count, count
                self.flat[self.used : self.used + len(flat)] = flat
                self.used += len(flat)

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words one after another, and where each begins; one place more than words."""
        keys, marks = [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            found = MARKED(word)
            if found:
                word = found[1].lower()
                if found[2]:
                    marks[i] = MARKS.index(found[2]) + 1
            keys.append(word)
        fresh = [key for key in dict.fromkeys(keys) if key not in self.number]
        if fresh:
            if len(self.number) + len(fresh) > REMEMBERED:
                self.clear()
                fresh = list(dict.fromkeys(keys))
            self._learn(fresh)
        at = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        begin = np.concatenate([[0], np.cumsum(self.count[at] + (marks > 0))])
        flat = np.empty(begin[-1], np.uint32)
        bare = np.ones(begin[-1], bool)
        bare[begin[1:][marks > 0] - 1] = False
        flat[bare] = _runs(self.flat, self.first[at], self.count[at])
        flat[~bare] = self.mark_ids[marks[marks > 0]]
        return flat, begin

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and where each text's end."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, begin = self._known(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        count = np.diff(begin)[at]
        end = np.concatenate([[0], np.cumsum(count)])
        return _runs(flat, begin[at], count), end[split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]]


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """The array, doubled until it holds ``size`` values."""
    if size <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)])


def _runs(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` values from ``first`` on, one after another."""
    end = np.cumsum(count)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + count, count)]


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """One memory of words for each Python worker, whatever number of tasks it runs."""
    return Words(path)


def tokenised(docs: DataFrame, tokenizer: str, limit: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every piece, on request with its ``ids``."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                flat, ends = words.ids(part.column(1).fill_null(""))
                flat = np.insert(flat, ends, END).astype("<u4", copy=False)
                ends = ends + np.arange(1, len(ends) + 1)
                size = np.diff(ends, prepend=0)
                pieces = -(-size // limit)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(size[row] - start, limit)
                first = (ends - size)[row] + start
                data = memoryview(flat)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                columns = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length)]
                columns.append(pa.array(crc, pa.int64()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.append(first, len(flat)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, and the places left in each sequence; longest first."""
    gaps = np.zeros(limit + 1, np.int64)  # gaps[g]: open sequences with g places left, 0 < g < limit
    open_at: list[list[int]] = [[] for _ in range(limit + 1)]
    left: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        best, gain = limit, 0 if size == limit else 2 * gaps[limit - size] + 1
        held = gaps[size:limit]
        if len(held):
            change = 2 * (gaps[: limit - size] - held) + 2
            change[0] = 1 - 2 * held[0]
            change[held == 0] = never
            k = int(change.argmin())
            if change[k] <= gain:
                best = size + k
        if best == limit:
            number = len(left)
            left.append(limit)
        else:
            number = open_at[best].pop()
            gaps[best] -= 1
        where[i], offset[i] = number, limit - left[number]
        left[number] -= size
        if left[number]:
            gaps[left[number]] += 1
            open_at[left[number]].append(number)
    return where, offset, np.array(left, np.int64)



def pack(pieces: DataFrame, limit: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; sequences are filled without gaps from 0.

    Pieces are dealt by a hash of their place in the stored table, so that neither long nor repeated documents gather.
    """
    groups = max(1, -(-pieces.count() // group))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(part: pd.DataFrame) -> pd.DataFrame:
        where, offset, _ = sum_of_squares(part["length"].to_numpy(np.int64), limit)
        first = int(part["__group"].iloc[0]) << 32
        return part.drop(columns="__group").assign(sequence_id=where + first, offset=offset)

    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, on request with ``ids``."""
    return pack(stored(tokenised(docs, tokenizer, with_ids=with_ids), "pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces that carry their ids; at most ``SEQUENCE`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
