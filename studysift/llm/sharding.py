"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot follows from its content alone and never changes. Bytes are aggregated per slot, and a small map says
which shard holds which slot. Rebalancing edits the map: it moves or swaps slots between the fullest and the emptiest
shard and stores the outcome as a new version beside the old ones. The law is ``bytes``: shards of near-equal size.

Defined results: a null text has no bytes and size 1; a null ``doc_id`` is hashed like any value; repeated rows share a
slot and take places of their own; an empty table gives an empty result and a map of equal slot counts.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studysift.llm.common import stored
from studysift.operators.storage import shared_folder

SLOTS = 16_384
SHARDS = 16


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` of every row."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_loads(placed: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows per slot: two arrays of ``slots`` numbers, whatever the table's size."""
    size, rows = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def _edit(load: np.ndarray, shard: np.ndarray, a: int, b: int) -> bool:
    """Move a slot from shard a to b, or swap two, so that their loads come as close as one edit can bring them."""
    mine, theirs = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
    gap = load[mine].sum() - load[theirs].sum()
    order = theirs[np.argsort(load[theirs], kind="stable")]
    give = np.concatenate([[0], load[order]])  # what comes back: nothing, or one slot
    want = load[mine] - gap / 2
    at = np.clip(np.searchsorted(give, want), 1, len(give) - 1) if len(give) > 1 else np.zeros(len(mine), dtype=int)
    best = None
    for near in (at, np.maximum(at - 1, 0)):
        left = np.abs(gap - 2 * (load[mine] - give[near]))
        i = int(left.argmin()) if len(left) else -1
        if i >= 0 and left[i] < gap and (best is None or left[i] < best[0]):
            best = (left[i], mine[i], near[i])
    if best is None:
        return False
    shard[best[1]] = b
    if best[2] > 0:
        shard[order[best[2] - 1]] = a
    return True


@dataclass
class SlotMap:
    """Slot-to-shard map; every edit is a further version in the shared folder."""

    spark: SparkSession
    shards: int = SHARDS
    slots: int = SLOTS
    name: str = ""
    version: int = 0

    def __post_init__(self) -> None:
        self.name = self.name or uuid.uuid4().hex
        self.shard = np.arange(self.slots) % self.shards

    @property
    def path(self) -> str:
        return f"{shared_folder(self.spark).rstrip('/')}/studysift/slot_map-{self.name}"

    def rebalance(self, size: np.ndarray, tolerance: float = 1e-4, edits: int = 100_000) -> int:
        """Edit the map until the fullest shard is within the tolerance of the emptiest; gives the edits made."""
        load = np.bincount(self.shard, weights=size, minlength=self.shards)
        made = 0
        while made < edits:
            (full,) = heapq.nlargest(1, range(self.shards), key=load.__getitem__)
            aim = max(1.0, tolerance * load.sum() / self.shards)
            others = [s for s in np.argsort(load, kind="stable") if load[full] - load[s] > aim]
            if not any(_edit(size, self.shard, full, s) for s in others):
                break
            load = np.bincount(self.shard, weights=size, minlength=self.shards)
            made += 1
        self.version += bool(made)
        return made

    def grow(self, size: np.ndarray) -> None:
        """One shard more, which takes slots from the others until it holds its share."""
        self.shards += 1
        load = np.bincount(self.shard, weights=size, minlength=self.shards).astype(float)
        share = size.sum() / self.shards
        for s in np.argsort(-size, kind="stable"):
            if load[self.shard[s]] - size[s] >= share * 0.999 and load[-1] + size[s] <= share:
                load[self.shard[s]] -= size[s]
                load[-1] += size[s]
                self.shard[s] = self.shards - 1
        self.version += 1

    def save(self, rows: np.ndarray) -> DataFrame:
        """Store this version; ``first`` is the place of a slot's first row within its shard."""
        first = np.zeros(self.slots, dtype=np.int64)
        for s in range(self.shards):
            mine = np.flatnonzero(self.shard == s)
            first[mine] = np.cumsum(rows[mine]) - rows[mine]
        table = [(i, int(s), int(f)) for i, (s, f) in enumerate(zip(self.shard, first))]
        target = f"{self.path}/version={self.version}"
        schema = "virtual_slot int, shard int, first long"
        self.spark.createDataFrame(table, schema).coalesce(1).write.parquet(target)
        return self.spark.read.schema(schema).parquet(target)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, virtual_slot, map_version, shard, slot``.

    ``slot`` is the row's place in its shard, gapless from 0. The only shuffle is of narrow rows by virtual slot; the
    map has ``slots`` rows, so its broadcast does not grow with the data.
    """
    placed = stored(with_slots(docs, slots), "slots")
    size, rows = slot_loads(placed, slots)
    table = SlotMap(docs.sparkSession, shards, slots)
    table.rebalance(size)
    saved = table.save(rows)
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(place).cast("long") - 1)
        .join(F.broadcast(saved), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", "virtual_slot", F.lit(table.version).alias("map_version"), "shard",
            (F.col("first") + F.col("place")).alias("slot"),
        )
    )
