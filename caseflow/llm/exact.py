"""Exact dedup: cuckoo-filter index over the digests of texts, sharded by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import SPACE_CLASS, partitions, stored, text_of, unpacked, whole_rows

SLOTS = 4
KICKS = 200
ROWS_IN_A_SHARD = 100_000


class CuckooIndex:
    """Live keys behind a cuckoo filter.

    The filter holds a 16-bit mark of every key in one of two buckets of four slots; the stored keys
    and their payloads lie in the same slots. A hit in the filter is verified against the stored key,
    so a false hit never merges two keys. ``delete`` frees the slot of a live key. When an insertion
    finds no room within ``KICKS`` moves, the index doubles and is filled again from the stored keys.
    Keys are digests of 16 bytes or more.
    """

    def __init__(self, capacity: int = 64):
        self._empty(1 << max(1, (max(1, capacity) * 5 // 4 // SLOTS).bit_length()))

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = [0] * (self.buckets * SLOTS)
        self.stored: list[tuple[bytes, object] | None] = [None] * (self.buckets * SLOTS)
        self.live = 0

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _find(self, key: bytes) -> int:
        mark, one, two = self._place(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.stored[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        """The payload of a live key, or None."""
        slot = self._find(key)
        return None if slot < 0 else self.stored[slot][1]

    def put(self, key: bytes, payload) -> None:
        """Insert a key, or give a live one a new payload."""
        slot = self._find(key)
        if slot >= 0:
            self.stored[slot] = (key, payload)
            return
        homeless = self._settle(key, payload)
        if homeless is None:
            return
        kept = [*self.items(), homeless]
        while True:
            self._empty(2 * self.buckets)
            if all(self._settle(*x) is None for x in kept):
                return

    def _settle(self, key: bytes, payload):
        """Store a new key; what lost its place after too many moves, or None."""
        mark, one, two = self._place(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == 0:
                    self.marks[slot], self.stored[slot] = mark, (key, payload)
                    self.live += 1
                    return None
        bucket, item = two, (key, payload)
        for kick in range(KICKS):
            slot = bucket * SLOTS + (mark + kick) % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.stored[slot], item = item, self.stored[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == 0:
                    self.marks[slot], self.stored[slot] = mark, item
                    self.live += 1
                    return None
        return item

    def delete(self, key: bytes) -> bool:
        """Remove a live key; whether there was one."""
        slot = self._find(key)
        if slot < 0:
            return False
        self.marks[slot], self.stored[slot] = 0, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return (x for x in self.stored if x is not None)

    def __len__(self) -> int:
        return self.live


def text_digest(text="text"):
    """SHA-256 of a text after every run of white space became one blank; NULL counts as empty."""
    return F.sha2(F.regexp_replace(text_of(text), SPACE_CLASS, " "), 256)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch: the smallest identifier and the number of rows."""
    for batch in batches:
        if batch.num_rows:
            one = pa.table({"key": batch.column(0), "doc_id": batch.column(1), "n": pa.array(np.ones(batch.num_rows, np.int64))})
            out = one.group_by("key").aggregate([("doc_id", "min"), ("n", "sum")])
            yield from out.select(["key", "doc_id_min", "n_sum"]).rename_columns(["key", "keep_id", "group_size"]).to_batches()


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The live digests of a shard, gathered in one cuckoo index."""
    index = CuckooIndex()
    for batch in batches:
        for key, keep, n in zip(*(c.to_pylist() for c in batch.columns)):
            had = index.get(key)
            index.put(key, (keep, n) if had is None else (_least(had[0], keep), had[1] + n))
    block: list[tuple] = []
    for key, (keep, n) in index.items():
        block.append((key, keep, n))
        if len(block) == 10_000:
            yield _block(block)
            block = []
    if block:
        yield _block(block)


def _block(rows: list[tuple]) -> pa.RecordBatch:
    keys, keeps, sizes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(keeps, pa.int64()), pa.array(sizes, pa.int64())], ["key", "keep_id", "group_size"])


def exact_groups(digests: DataFrame) -> DataFrame:
    """The groups of equal digests: key, keep_id, group_size.

    ``digests`` has doc_id and key (binary). Map tasks shrink copies to one row a batch, so a group
    that holds a third of all rows reaches its shard as a few rows; each shard then keeps its live
    digests in one ``CuckooIndex`` of about ``ROWS_IN_A_SHARD`` keys.
    """
    schema = "key binary, keep_id bigint, group_size bigint"
    rows = digests.count()
    shards = max(partitions(digests.sparkSession), -(-rows // ROWS_IN_A_SHARD))
    return digests.select("key", "doc_id").mapInArrow(_partial, schema).repartition(shards, "key").mapInArrow(_indexed, schema)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space became one blank; NULL counts as
    empty. The smallest doc_id of a group stays; missing identifiers come last. Of rows that repeat
    both text and doc_id one stays. No rows in, no rows out. Other columns are not read.
    """
    rows = stored(docs.select(F.col("doc_id").cast("bigint"), F.unhex(text_digest()).alias("key")))
    same = Window.partitionBy("key", "doc_id").orderBy(F.lit(1))
    numbered = rows.withColumn("copy", F.row_number().over(same))
    groups = exact_groups(rows)
    return numbered.join(groups, "key", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_key"))
    rows = whole_rows(docs, id=F.col("doc_id").cast("bigint"), key=F.unhex(text_digest()))
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["key"] == kept["kept_key"])
    return unpacked(rows.join(kept, same, "left_semi").dropDuplicates(["id", "key"]), docs)
