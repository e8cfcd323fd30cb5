"""Ranked lexical search: an inverted index in segments; short lists term at a time, long ones document at a time.

``build_index`` cuts the documents into segments of some megabytes. A segment has a row for each of its
terms (places in the segment and occurrences there) and one without a term that holds the identifiers and
lengths of its documents. ``search`` weighs the terms by the whole index, then goes through every segment
once for all queries:

- the lists of rare terms are summed into accumulators, a place and a partial score each, in order of
  place (term at a time);
- accumulators then count as one more list beside those of the common terms. All of them go forward
  through the places together, a block at a time. A block whose lists, by the largest score that each
  has there, can't lift a document over the least score of the best so far is skipped unread
  (document at a time).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.common import pieces, stored, text_of, texts_of

#: Results a query.
TOP = 50
#: Bytes of text and documents that a segment has at most, but for one longer document alone.
SEGMENT_BYTES, SEGMENT_DOCUMENTS = 1 << 23, 1 << 14
#: Places of a block, the unit that is skipped or read.
BLOCK = 64
#: Lists that hold at most this share of a segment's documents are short.
SHORT_SHARE = 1 / 32
#: Terms and queries that are sent to the tasks at once.
QUERY_TERMS, QUERIES = 200_000, 20_000

INDEX = "segment bigint, term string, places array<int>, counts array<bigint>, ids array<bigint>"


def _lists(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, where the list of each starts, places and counts of all lists, and the terms' number of each document."""
    starts, ends, bounds = bytescan.spans(data, offsets, bytescan.WORDLIKE)
    names = bytescan.hash_spans(data, starts, ends, bytescan.SMALL)
    place = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    # By name, then by place: words come by place already.
    order = np.argsort(names, kind="stable")
    names, place = names[order], place[order]
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (place[1:] != place[:-1])
    rows = np.flatnonzero(fresh)
    counts = np.diff(np.append(rows, len(names)))
    heads = np.ones(len(rows), bool)
    heads[1:] = names[rows[1:]] != names[rows[:-1]]
    heads = np.flatnonzero(heads)
    shown = order[rows[heads]]
    size = ends[shown] - starts[shown]
    edges = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(edges[-1]) + np.repeat(starts[shown] - edges[:-1], size)
    body = bytescan.SMALL[data[at]]
    terms = pa.LargeStringArray.from_buffers(len(shown), pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
    return terms, np.append(heads, len(rows)), place[rows], counts, np.diff(bounds)


def _segment(number: int, ids: list[np.ndarray], data: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    doc_ids = pa.concat_arrays(ids)
    n = len(doc_ids)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    terms, heads, place, counts, length = _lists(np.concatenate(data), offsets)
    names = ["segment", "term", "places", "counts", "ids"]
    one = np.array([0, n], np.int32)
    head = [pa.array([number]), pa.array([None], pa.string()), pa.ListArray.from_arrays(one, pa.array(np.arange(n, dtype=np.int32))), pa.ListArray.from_arrays(one, pa.array(length)), pa.ListArray.from_arrays(one, doc_ids)]
    yield pa.RecordBatch.from_arrays(head, names)
    # A list of as many terms as make a batch of bounded size.
    step = 1 << 14
    for a in range(0, len(terms), step):
        b = min(len(terms), a + step)
        low, high = heads[a], heads[b]
        edge = pa.array((heads[a : b + 1] - low).astype(np.int32))
        columns = [
            pa.array(np.full(b - a, number)),
            terms.slice(a, b - a),
            pa.ListArray.from_arrays(edge, pa.array(place[low:high].astype(np.int32))),
            pa.ListArray.from_arrays(edge, pa.array(counts[low:high])),
            pa.nulls(b - a, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def build_index(docs: DataFrame) -> DataFrame:
    """The index over every row and whole text of ``docs``: see ``INDEX`` and the module.

    Terms are the maximal runs of letters, digits and characters beyond ASCII, with A-Z in small
    letters. A row with a term has the places of the documents that hold it, in order, and how often; a
    row without has the lengths of all documents of the segment and their doc_ids. Missing and empty
    texts have no term. No rows in, no rows out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number, held, size, ids, data, sizes = 0, 0, 0, [], [], []
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            for begin, stop, part, at in pieces(raw, offsets):
                if held and (size + len(part) > SEGMENT_BYTES or held + stop - begin > SEGMENT_DOCUMENTS):
                    yield from _segment(first + number, ids, data, sizes)
                    number, held, size, ids, data, sizes = number + 1, 0, 0, [], [], []
                ids.append(batch.column(0).slice(begin, stop - begin))
                data.append(part)
                sizes.append(np.diff(at))
                held, size = held + stop - begin, size + len(part)
        if held:
            yield from _segment(first + number, ids, data, sizes)

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return rows.mapInArrow(work, INDEX)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each term of an item once. Items that repeat an identifier are one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            for begin, stop, part, at in pieces(raw, offsets):
                terms, heads, place, _, _ = _lists(part, at)
                of = np.repeat(np.arange(len(terms)), np.diff(heads))
                rows = [batch.column(0).slice(begin, stop - begin).take(pa.array(place)), terms.take(pa.array(of))]
                yield pa.RecordBatch.from_arrays(rows, ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("bigint"), text_of().alias("text"))
    return rows.mapInArrow(work, "item_id bigint, term string").distinct()


class _Best:
    """The ``top`` best documents of one query so far, by score and then by smaller doc_id."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document has to reach to be taken."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= self.least()
        if keep.any():
            score, doc = np.concatenate([self.score, score[keep]]), np.concatenate([self.doc, doc[keep]])
            order = np.lexsort((doc, -score))[: self.top]
            self.score, self.doc = score[order], doc[order]


def _search_segment(ids: np.ndarray, lists: dict[str, tuple[np.ndarray, np.ndarray]], queries: list[tuple[int, list[tuple[str, int]]]], top: int) -> Iterator[tuple[int, _Best]]:
    """The best documents of one segment for every query.

    ids: document at each place; lists: term to places and a score for weight 1; queries: number, and terms with their weights.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    most_short = max(1, int(n * SHORT_SHARE))
    # Of a long list the first posting of each block, and the largest score there.
    edges: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for term, (places, values) in lists.items():
        if len(places) > most_short:
            edge = np.searchsorted(places, np.arange(blocks + 1) * BLOCK)
            full = np.flatnonzero(edge[1:] > edge[:-1])
            most = np.zeros(blocks, np.int64)
            most[full] = np.maximum.reduceat(values, edge[:-1][full])
            edges[term] = edge, most
    for number, terms in queries:
        here = [(t, w) for t, w in terms if w > 0 and t in lists]
        if not here:
            continue
        best = _Best(top)
        # Term at a time: the accumulators of the short lists, in order of place.
        short = [(t, w) for t, w in here if t not in edges]
        long = [(*lists[t], *edges[t], w) for t, w in here if t in edges]
        sums = np.zeros(n, np.int64)
        for t, w in short:
            places, values = lists[t]
            sums[places] += w * values
        # Accumulators as one list with bounds, beside the long ones.
        padded = np.zeros(blocks * BLOCK, np.int64)
        padded[:n] = sums
        bound = padded.reshape(blocks, BLOCK).max(axis=1)
        for *_, most, w in long:
            bound += w * most
        if short:
            # What the accumulators have is a lower bound of a score.
            held = np.flatnonzero(sums)
            floor = int(np.partition(sums[held], len(held) - top)[len(held) - top]) if len(held) >= top else 1
        else:
            floor = 1
        # Document at a time: blocks in order of place, a run of those that are left at once.
        at = 0
        while True:
            need = max(floor, best.least())
            left = np.flatnonzero(bound[at:] >= need)[:BLOCK] + at
            if not len(left):
                break
            score = padded.reshape(blocks, BLOCK)[left]
            row = np.full(blocks, -1)
            row[left] = np.arange(len(left))
            for places, values, edge, _, w in long:
                size = edge[left + 1] - edge[left]
                take = np.arange(size.sum()) + np.repeat(edge[left] - (np.cumsum(size) - size), size)
                p = places[take]
                score[row[p // BLOCK], p % BLOCK] += w * values[take]
            block, place = np.nonzero(score >= need)
            best.add(score[block, place], ids[left[block] * BLOCK + place])
            at = int(left[-1]) + 1
        if len(best.score):
            yield number, best


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of ``index`` for every item: item_id, rank, doc_id, score.

    Terms are those of ``build_index``. N: documents with a term; L: their terms; a document's n: its
    terms; df: documents with a term t; tf: its occurrences in one. Its weight w is
    floor(1000 * ln((2 N + 2) / (2 df + 1))), a document's m is 100 - 50 + (50 n N) div L, and its score
    the sum of w * ((1000000000 tf) div (1000 tf + 20 m)) over the item's terms, once each. Only scores
    above 0 count; equal ones are in order of doc_id, a missing doc_id last. Rows that repeat a doc_id
    are documents of their own. Items that repeat an item_id are one with the terms of all; a missing or empty text
    finds nothing. No rows in either table, no rows out.

    Queries are taken in blocks of at most ``QUERY_TERMS`` terms (or one query with more) and ``QUERIES`` items;
    a block's terms and weights go to the tasks. A task holds the lists of one segment for one block.
    """
    spark = index.sparkSession
    heads = index.where("term IS NULL")
    total = heads.select(
        F.sum(F.expr("size(filter(counts, c -> c > 0))")).alias("n"), F.sum(F.expr("aggregate(counts, 0L, (s, c) -> s + c)")).alias("l")
    ).first()
    documents, words = int(total["n"] or 0), int(total["l"] or 0)
    result = "item_id bigint, rank int, doc_id bigint, score bigint"
    if not words:
        return spark.createDataFrame([], result)
    asked = stored(query_terms(items))
    held = index.where("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi")
    held = stored(held.select("segment", "term", "places", "counts"))
    df = held.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * documents + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("bigint")
    weighed = stored(asked.join(df.select("term", weight.alias("w")), "term"))
    found = None
    for block in _blocks(weighed):
        queries = _queries(weighed.join(block, F.col("item_id").eqNullSafe(F.col("of_item")), "left_semi"))
        wanted = spark.createDataFrame([(t,) for t in sorted({t for _, terms in queries for t, _ in terms})], "term string")
        own = held.join(wanted, "term", "left_semi").select("segment", "term", "places", "counts", F.lit(None).cast("array<bigint>").alias("ids"))
        rows = own.unionByName(heads.select("segment", "term", "places", "counts", "ids"))
        part = rows.groupBy("segment").applyInArrow(_segments(queries, documents, words, top), "item_id bigint, doc_id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], result)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return stored(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _blocks(weighed: DataFrame) -> Iterator[DataFrame]:
    """The items in blocks, as tables of one column ``of_item``."""
    n = weighed.count()
    if n <= QUERY_TERMS and weighed.select("item_id").distinct().count() <= QUERIES:
        if n:
            yield weighed.select(F.col("item_id").alias("of_item")).distinct()
        return
    sizes = weighed.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    parts = -(-2 * n // QUERY_TERMS) + -(-sizes.count() // QUERIES)
    dealt = stored(sizes.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))))
    for part in range(parts):
        yield dealt.where(F.col("part") == part).select(F.col("item_id").alias("of_item"))


def _queries(weighed: DataFrame) -> list[tuple[int | None, list[tuple[str, int]]]]:
    """One block's queries on the driver: its size has a bound."""
    out: dict[int | None, list[tuple[str, int]]] = {}
    for r in weighed.select("item_id", "term", "w").toLocalIterator():
        out.setdefault(r["item_id"], []).append((r["term"], r["w"]))
    return [(k, sorted(v)) for k, v in sorted(out.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def _segments(queries: list, documents: int, words: int, top: int):
    """For the rows of one segment, the best documents of every query."""
    none = (1 << 63) - 1

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_head = np.asarray(table.column("term").is_null())
        head = int(np.flatnonzero(is_head)[0])
        ids = np.asarray(table.column("ids")[head].values.fill_null(none))
        length = np.asarray(table.column("counts")[head].values)
        m = 50 + (50 * length * documents) // words
        lists = {}
        rows = table.filter(pa.array(~is_head))
        terms = rows.column("term").to_pylist()
        places, counts = (rows.column(c).combine_chunks() for c in ("places", "counts"))
        edge = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))]) if terms else [0]
        place, tf = places.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        value = (1_000_000_000 * tf) // (1000 * tf + 20 * m[place]) if len(place) else tf
        for k, term in enumerate(terms):
            lists[term] = place[edge[k] : edge[k + 1]], value[edge[k] : edge[k + 1]]
        found = list(_search_segment(ids, lists, queries, top))
        doc = np.concatenate([b.doc for _, b in found]) if found else np.zeros(0, np.int64)
        columns = [
            pa.array([q for q, b in found for _ in b.score], pa.int64()),
            pa.array(doc, mask=doc == none),
            pa.array(np.concatenate([b.score for _, b in found]) if found else np.zeros(0, np.int64)),
        ]
        return pa.Table.from_arrays(columns, ["item_id", "doc_id", "score"])

    return work


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``search`` in an index of ``docs`` that is stored first."""
    return search(stored(build_index(docs)), items, top)
