"""Benchmark decontamination by pigeonhole edit matching.

A test item may be met with up to ``errors`` edits, a share of its length. Cut into errors + 1 pieces, at least one
piece of it must stand unchanged in the document; exact piece hits, found for all items in one pass over the text,
give the places where an item may stand, and Myers' bit-parallel edit distance decides there. Both sides are compared
in lower case with each run of white space as one space.

Items are sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters, one pass over the documents for each
block, so what is broadcast is bounded however many items there are. Documents are read in place: no shuffle.

Defined results: a null or empty text matches nothing, and so does a null or blank item; of an item's places in a
document the one with the fewest edits counts, the first of equals; items with equal texts are reported each; repeated
rows are reported each; a null ``doc_id`` or ``item_id`` is carried along; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studysift.operators.storage import shared_folder

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000
FOUND = "array<struct<item_id:bigint,distance:int,end:int>>"
FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of near-equal length with their offsets; of a shorter item, one for each character."""
    n = min(errors + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any part of the text, and where the first such part ends."""
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    all_ones, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, distance = all_ones, 0, len(pattern)
    best, end = distance, 0
    for at, c in enumerate(text, 1):
        equal = where.get(c, 0)
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        more = down | ~(level | up) & all_ones
        less = up & level
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more, less = more << 1 & all_ones, less << 1 & all_ones
        up = less | ~(vertical | more) & all_ones
        down = more & vertical
        if distance < best:
            best, end = distance, at
    return best, end


class Items:
    """A block of test items, ready to be searched for."""

    def __init__(self, items: list[str], rate: float) -> None:
        import ahocorasick

        self.items = items
        self.errors = [int(len(item) * rate) for item in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for offset, piece in pieces_of(item, self.errors[number]):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in places.items():
            self.automaton.add_word(piece, (len(piece), spots))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """``(item, distance, end)`` of each item that stands in the text within its budget."""
        text = normalise(text)
        starts: dict[int, set[int]] = {}
        for last, (length, spots) in self.automaton.iter(text):
            for number, offset in spots:
                starts.setdefault(number, set()).add(last + 1 - length - offset)
        found = []
        for number in sorted(starts):
            if (best := self._verify(number, sorted(starts[number]), text)) is not None:
                found.append((number, *best))
        return found

    def _verify(self, number: int, starts: list[int], text: str) -> tuple[int, int] | None:
        item, budget = self.items[number], self.errors[number]
        best: tuple[int, int] | None = None
        for low, high in windows(starts, budget, len(item)):
            low = max(0, low)
            part = text[low:high]
            exact = part.find(item)
            distance, end = (0, exact + len(item)) if exact >= 0 else myers(item, part)
            if distance <= budget and (best is None or distance < best[0]):
                best = distance, low + end
        return best


def windows(starts: list[int], budget: int, length: int) -> Iterator[tuple[int, int]]:
    """Parts of the text where the item may stand, overlapping ones as one."""
    low = high = None
    for start in starts:
        if high is not None and start - budget <= high:
            high = start + length + budget
            continue
        if high is not None:
            yield low, high
        low, high = start - budget, start + length + budget
    if high is not None:
        yield low, high


def finder(ids: list, items: list[str], rate: float):
    """A column function from text to the items found in it; each task prepares the items once."""
    prepared: list[Items] = []

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        if not prepared:
            prepared.append(Items(items, rate))
        rows = [
            [{"item_id": ids[i], "distance": d, "end": e} for i, d, e in prepared[0].find(t.as_py() or "")]
            for t in texts
        ]
        return pa.array(rows, FOUND_ARROW)

    return find


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, at most ``BLOCK_CHARS`` characters at a time."""
    ids, items, held = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = normalise(row["text"] or "")
        if not item:
            continue
        if items and held + len(item) > BLOCK_CHARS:
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row["item_id"])
        items.append(item)
        held += len(item)
    if items:
        yield ids, items


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``(doc_id, item_id, distance, end)`` of every document and test item that stands in it within the budget.

    ``end`` is where the best place ends in the normalised text. The matches of a block of items are written before the
    next block is read, so that the driver and the plan hold one block however many there are.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, `end` int"
    folder = f"{shared_folder(spark).rstrip('/')}/studysift/item_matches-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(folder)
    for ids, items in item_blocks(benchmark):
        hits = docs.select(F.col("doc_id").cast("long"), F.explode(finder(ids, items, rate)("text")).alias("f"))
        hits.select("doc_id", "f.item_id", "f.distance", "f.end").write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents in which no test item stands, with all their columns."""
    for ids, items in item_blocks(benchmark):
        docs = docs.filter(F.size(finder(ids, items, rate)("text")) == 0)
    return docs
