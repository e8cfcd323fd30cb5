"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import tokens
from caseflow.llm.common import stored

#: Permitted sequence lengths in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence of c tokens costs OVERHEAD + c + c * c / ATTENTION.
OVERHEAD = 16
ATTENTION = 65536
PIECES_IN_A_SHARD = 50_000


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every size (largest first), and the capacity of every bin.

    A piece goes where it leaves the least room. If it fits nowhere, each permitted length is tried
    with all the largest remaining pieces that still fit, and the one that costs least a token is opened;
    ties go to the shorter. In the end every bin shrinks to the least length that holds its contents.
    """
    rising = sizes[::-1]
    below = [0, *accumulate(rising)]
    bins, offsets, used, opened = [], [], [], []
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}

    def offer(b: int) -> None:
        room = opened[b] - used[b]
        if room:
            if not by_room.get(room):
                insort(rooms, room)
            by_room.setdefault(room, []).append(b)

    for i, size in enumerate(sizes):
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop(0)
            if not by_room[room]:
                rooms.pop(k)
        else:
            least, best = None, None
            for capacity in capacities:
                if capacity < size:
                    continue
                gap, high = capacity - size, len(sizes) - i - 1
                # Neighbours that fit together are one step, and each step leaves less than half of the gap.
                while gap > 0 and (top := bisect_right(rising, gap, 0, high)) > 0:
                    high = bisect_left(below, below[top] - gap, 0, top)
                    gap -= below[top] - below[high]
                price = (OVERHEAD + capacity + capacity * capacity / ATTENTION) / (capacity - gap)
                if least is None or price < least:
                    least, best = price, capacity
            b = len(opened)
            opened.append(best)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        offer(b)
    return bins, offsets, [min(c for c in capacities if c >= n) for n in used]


def packed(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Where every token goes: doc_id, piece, start, length, bin_id, position, capacity, from rows of doc_id and length.

    A document longer than the longest sequence is cut into pieces of that length and a rest. A
    document without tokens keeps one row of length 0 and no bin. Pieces are dealt by hash into shards
    of about ``PIECES_IN_A_SHARD``, which are packed on their own, so no document, however long or often
    repeated, makes a shard grow; a shard leaves some part-filled bins at most. Rows that repeat are
    packed each; bins are the same however the input is split. Equal lengths go by doc_id (missing first) and piece.
    """
    largest = max(capacities)
    rows = lengths.select(F.col("doc_id").cast("bigint"), F.coalesce("length", F.lit(0)).cast("bigint").alias("total"))
    # Rows that are equal get numbers, which one has which doesn't matter: nothing depends on how the input is split.
    rows = rows.groupBy("doc_id", "total").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    rows = stored(rows.select("doc_id", "total", "copy"))
    last = F.greatest(F.ceil(F.col("total") / largest) - 1, F.lit(0))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    cut = cut.withColumns({"start": F.col("piece") * largest, "length": F.least(F.col("total") - F.col("piece") * largest, F.lit(largest))})
    n = cut.count()
    shards = max(1, -(-n // PIECES_IN_A_SHARD))
    dealt = cut.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "total", "copy", "piece"), F.lit(shards)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "total", "copy"], ascending=[False, True, True, True, True], na_position="first", kind="stable")
        bins, offsets, sizes = best_fit(group["length"].tolist(), capacities)
        out = group[["doc_id", "piece", "start", "length"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["bin_id"] = int(group["shard"].iloc[0]) * (1 << 32) + pd.Series(bins, index=group.index)
        out["position"] = offsets
        out["capacity"] = [sizes[b] for b in bins]
        return out

    schema = "doc_id bigint, piece bigint, start bigint, length bigint, bin_id bigint, position bigint, capacity bigint"
    full = dealt.select("doc_id", "piece", "start", "length", "total", "copy", "shard").groupBy("shard").applyInPandas(pack, schema)
    blank = F.lit(None).cast("bigint")
    none = cut.where("length <= 0").select("doc_id", "piece", "start", F.lit(0).cast("bigint").alias("length"), blank.alias("bin_id"), blank.alias("position"), blank.alias("capacity"))
    return full.union(none)


def packed_documents(docs: DataFrame, path: str = tokens.VOCABULARY) -> DataFrame:
    """``packed`` by the token counts of whole texts."""
    return packed(tokens.token_counts(docs, path).select("doc_id", F.col("n_tokens").alias("length")))
