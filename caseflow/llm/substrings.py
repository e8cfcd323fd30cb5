"""Substring dedup: hashed units of lines; the earliest occurrence stays, later ones go, offsets are kept.

A unit is a line or a part of one: it also ends after a word that ends in a full stop, exclamation or
question mark, and before a word with a capital that follows a word without one. So a passage that was
set into another document's line is found by its own units. Units are normalised to small letters and
single blanks, and grouped over all documents by a 128-bit digest.

A passage is any ``LONG_RUN`` words in a row, wherever they start. Documents agree on some of their
windows of ``SEED`` words (the one of least hash among those of a passage), so passages are hashed and
grouped only where such a seed repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.bytescan import U, _lookup
from caseflow.llm.common import Scratch, arrow_pass, partitions, pieces, shuffles_go, stored, text_of, texts_of

#: A unit of fewer words may repeat by chance.
LEAST_UNIT = 5
#: Words that a run of repeated units must have to be removed, and how many of them in larger units.
LEAST_RUN, LEAST_SOLID = 20, 10
#: A run of so many words goes whatever its units are.
LONG_RUN = 50
#: Words of a seed; every passage of LONG_RUN words holds a seed that depends on nothing but its words.
SEED = 25

_END = _lookup(lambda b: chr(b) in ".!?")
_CAPITAL = _lookup(lambda b: 0x41 <= b <= 0x5A)
_LEAD = _lookup(lambda b: b & 0xC0 != 0x80)
_NO_ID = (1 << 63) - 1

def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (starts, ends, before each document) and the first word of every unit."""
    starts, ends, bounds = bytescan.spans(data, offsets, bytescan.SOLID)
    n = len(starts)
    if n == 0:
        return starts, ends, bounds, np.zeros(0, np.int64)
    doc_first = np.zeros(n, bool)
    doc_first[bounds[:-1][np.diff(bounds) > 0]] = True
    newline = np.concatenate([[0], np.cumsum(data == 0x0A)])
    broken = np.zeros(n, bool)
    broken[1:] = newline[starts[1:]] > newline[ends[:-1]]
    ended = np.zeros(n, bool)
    ended[1:] = _END[data[ends[:-1] - 1]]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = _CAPITAL[data[starts]] | ((data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    rising = capital.copy()
    rising[1:] &= ~capital[:-1]
    return starts, ends, bounds, np.flatnonzero(doc_first | broken | ended | rising)


UNITS = "h1 bigint, h2 bigint, rank bigint, name bigint, first int, words int, start bigint, end bigint"

#: What goes of a document: units (kind 0) and stretches (1) that occurred before, and the rank of a document that keeps them.
PARTS = "rank bigint, name bigint, kind int, first int, words int, start bigint, end bigint, keeper bigint"


def _names(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return bytescan.digests(data, offsets)[:, 0].view(np.int64)


def _ranked(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("rank"), text_of().alias("text"))


def _once(work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray | pa.Array]], names: list[str]) -> Callable:
    """A pass over (rank, text) that leaves out rows whose rank and text the same task has seen: they are one document.

    ``work`` gets bytes, offsets, ranks and names of a run of documents and returns columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            ids, name = np.asarray(batch.column(0)), _names(data, offsets)
            fresh = np.ones(len(ids), bool)
            for i, key in enumerate(zip(ids.tolist(), name.tolist())):
                fresh[i] = key not in seen
                seen.add(key)
            if not fresh.all():
                data, offsets = texts_of(batch.column(1).filter(pa.array(fresh)))
                ids, name = ids[fresh], name[fresh]
            for begin, stop, part, at in pieces(data, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(part, at, ids[begin:stop], name[begin:stop])], names)

    return run


def units(docs: DataFrame) -> DataFrame:
    """A row for every unit of every whole text.

    h1, h2: digest; rank: doc_id, a missing one as the largest number; name: digest of the text; first:
    its first word; words; start and end in code points.
    """

    def work(part: np.ndarray, at: np.ndarray, ids: np.ndarray, names: np.ndarray) -> list[np.ndarray]:
        starts, ends, bounds, first = unit_bounds(part, at)
        last = np.append(first[1:], len(starts)) if len(first) else first
        words = bytescan.hash_spans(part, starts, ends, bytescan.SMALL)
        h1, h2 = (bytescan.fold_runs(words, first, last, base).view(np.int64) for base in (0, 1))
        doc = np.searchsorted(bounds, first, "right") - 1
        chars = np.concatenate([[0], np.cumsum(_LEAD[part])])
        from_doc = chars[at[:-1]][doc]
        place = (first - bounds[:-1][doc]).astype(np.int32)
        return [h1, h2, ids[doc], names[doc], place, (last - first).astype(np.int32), chars[starts[first]] - from_doc, chars[ends[last - 1]] - from_doc]

    return _ranked(docs).mapInArrow(_once(work, ["h1", "h2", "rank", "name", "first", "words", "start", "end"]), UNITS)


def later_units(docs: DataFrame) -> DataFrame:
    """Units that occurred before, as ``PARTS``: in a document of smaller rank, of equal ones of smaller name, or earlier in the text.

    Digests are counted with a combine before the shuffle; the join that brings the first occurrence back has
    plain shuffles on both sides, so a digest of very many rows is split at run time.
    """
    rows = units(docs)
    one = F.min(F.struct("rank", "name", "first")).alias("one")
    groups = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), one).where("n > 1")
    again = groups.select(F.expr("h1 ^ 0L").alias("g1"), F.expr("h2 ^ 0L").alias("g2"), "one")
    found = rows.join(again, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    found = found.where(F.struct("rank", "name", "first") > F.col("one"))
    return found.select("rank", "name", F.lit(0).alias("kind"), "first", "words", "start", "end", F.col("one.rank").alias("keeper"))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of every ``width`` values in a row is; of equal ones the last."""
    value, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(value) - step
        right = value[step:] <= value[:n]
        value, at = np.where(right, value[step:], value[:n]), np.where(right, at[step:], at[:n])
        have += step
    return at


def _seeded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words (starts, ends, before each document, hashes); first words of all passages, documents and seeds (first words) of these; hashes of the seeds by first word."""
    starts, ends, bounds = bytescan.spans(data, offsets, bytescan.SOLID)
    words = bytescan.hash_spans(data, starts, ends, bytescan.SMALL)
    n = len(words)
    if n < LONG_RUN:
        none = np.zeros(0, np.int64)
        return starts, ends, bounds, words, none, none, none, np.zeros(0, U)
    first = np.arange(n - SEED + 1)
    hashes = bytescan.fold_runs(words, first, first + SEED)
    at = _least(hashes, LONG_RUN - SEED + 1)
    passage = np.arange(len(at))
    doc = np.searchsorted(bounds, passage, "right") - 1
    whole = passage + LONG_RUN <= bounds[1:][doc]
    return starts, ends, bounds, words, passage[whole], doc[whole], at[whole], hashes


def _keys(ids: np.ndarray, names: np.ndarray) -> np.ndarray:
    return bytescan.mixed(names.view(U) + bytescan.mixed(ids.view(U) + U(1))).view(np.int64)


#: A stretch: all passages in a row that have one seed. h: the seed; c1, c2: digest of all its words and of the seed's place
#: in it; at: first word of the seed; low: words from there back to the first passage; of each passage its
#: hash, the start of its first word and the end of its last one.
STRETCHES = "h bigint, c1 bigint, c2 bigint, rank bigint, name bigint, at int, low int, hashes array<bigint>, starts array<bigint>, ends array<bigint>"


_NOTHING = np.zeros(0, np.uint8)


def _stretches_of(part: np.ndarray, at: np.ndarray, ids: np.ndarray, names: np.ndarray, marks: pa.ListArray) -> pa.RecordBatch | None:
    """``STRETCHES`` of some texts whose seeds are in ``marks``."""
    starts, ends, bounds, words, passage, doc, seed, hashes = _seeded(part, at)
    marked = np.zeros(len(words) + 1, bool)
    marked[marks.flatten().to_numpy() + np.repeat(bounds[:-1], marks.value_lengths().to_numpy())] = True
    keep = marked[seed]
    passage, doc, seed = passage[keep], doc[keep], seed[keep]
    if not len(passage):
        return None
    begin = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
    many = np.diff(np.append(begin, len(passage)))
    first, of, one = passage[begin], doc[begin], seed[begin]
    c1, c2 = (bytescan.mixed(bytescan.fold_runs(words, first, first + many + LONG_RUN - 1, base) + (one - first).astype(U)).view(np.int64) for base in (0, 1))
    chars = np.concatenate([[0], np.cumsum(_LEAD[part])])
    from_doc = chars[at[:-1]][doc]
    edge = pa.array(np.append(begin, len(passage)).astype(np.int32))
    lists = (bytescan.fold_runs(words, passage, passage + LONG_RUN).view(np.int64), chars[starts[passage]] - from_doc, chars[ends[passage + LONG_RUN - 1]] - from_doc)
    columns = [hashes[one].view(np.int64), c1, c2, ids[of], names[of], (one - bounds[:-1][of]).astype(np.int32), (one - first).astype(np.int32)]
    arrays = [*(pa.array(c) for c in columns), *(pa.ListArray.from_arrays(edge, pa.array(x)) for x in lists)]
    return pa.RecordBatch.from_arrays(arrays, ["h", "c1", "c2", "rank", "name", "at", "low", "hashes", "starts", "ends"])


def stretches(docs: DataFrame) -> DataFrame:
    """A row for every stretch of every whole text whose seed occurs twice or more.

    Seeds are counted by their hash alone; what is shuffled for each is its hash, its document and its place. Only
    documents with a seed that occurs again are read a second time, beside the list of their seeds.
    """
    rows = _ranked(docs)

    def seeds(part: np.ndarray, at: np.ndarray, ids: np.ndarray, names: np.ndarray) -> list[np.ndarray]:
        _, _, bounds, _, _, doc, seed, hashes = _seeded(part, at)
        fresh = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else seed
        doc, seed = doc[fresh], seed[fresh]
        return [hashes[seed].view(np.int64), _keys(ids, names)[doc], (seed - bounds[:-1][doc]).astype(np.int32)]

    def keyed(part: np.ndarray, at: np.ndarray, ids: np.ndarray, names: np.ndarray) -> list[np.ndarray | pa.Array]:
        raw = memoryview(np.ascontiguousarray(part))
        packed = [pa.compress(raw[a:b], codec="zstd", asbytes=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return [_keys(ids, names), ids, names, np.diff(at), pa.array(packed, pa.binary())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(2))
            # A few texts at a time are unpacked, and what they give goes on before the next.
            for begin, stop, _, at in pieces(_NOTHING, np.concatenate([[0], np.cumsum(size)])):
                packed = batch.column(3).slice(begin, stop - begin).to_pylist()
                text = b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(packed, size[begin:stop].tolist()) if n)
                mine = [batch.column(k).slice(begin, stop - begin) for k in (0, 1, 4)]
                if (told := _stretches_of(np.frombuffer(text, np.uint8), at, np.asarray(mine[0]), np.asarray(mine[1]), mine[2])) is not None:
                    yield told

    all_seeds = rows.mapInArrow(_once(seeds, ["h", "key", "seed"]), "h bigint, key bigint, seed int")
    again = all_seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.expr("h ^ 0L").alias("g"))
    marks = all_seeds.join(again, F.col("h") == F.col("g")).groupBy("key").agg(F.collect_set("seed").alias("seeds"))
    marks = marks.select(F.expr("key ^ 0L").alias("of_key"), "seeds")
    texts = rows.mapInArrow(_once(keyed, ["key", "rank", "name", "size", "packed"]), "key bigint, rank bigint, name bigint, size bigint, packed binary")
    both = texts.join(marks, texts["key"] == marks["of_key"]).select("rank", "name", "size", "packed", "seeds")
    return both.mapInArrow(work, STRETCHES)


def _kinds(found: DataFrame) -> DataFrame:
    """Every kind of stretch (c1, c2) with a number, its seed, and its first occurrence (rank, name, at) with the hashes of its passages."""
    one = F.min(F.struct("rank", "name", "at", "hashes")).alias("one")
    kinds = found.groupBy("c1", "c2").agg(F.first("h").alias("h"), one)
    return kinds.select(F.monotonically_increasing_id().alias("kind"), "c1", "c2", "h", "one.*")


def _shared_kinds(kinds: DataFrame) -> DataFrame:
    """The kinds whose seed has another kind too: only those can share a passage with one."""
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.expr("h ^ 0L").alias("g"))
    return kinds.join(several, F.col("h") == F.col("g"), "left_semi").select("kind", "h", "rank", "name", "at", "hashes")


def _firsts(kinds: DataFrame, shared: DataFrame) -> DataFrame:
    """For every kind of stretch its first occurrence (f_rank, f_name, f_at), and, as ``odd``, the passages that occurred before that: (d, rank, name, at), d the passage's number.

    Equal stretches have equal passages, so only the first stretch of a kind is unfolded, and only where
    its seed has several kinds.
    """
    each = shared.select("h", "kind", "rank", "name", "at", F.posexplode("hashes").alias("d", "p"))
    # The seed's place in a passage belongs to the passage, as does the seed's hash.
    one = F.min(F.struct("rank", "name", "at", "kind")).alias("f")
    groups = each.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n"), one).where("n > 1")
    groups = groups.select(F.expr("h ^ 0L").alias("g"), F.expr("p ^ 0L").alias("q"), "f")
    told = each.select("h", "p", "kind", "d").join(groups, (F.col("h") == F.col("g")) & (F.col("p") == F.col("q")))
    odd = told.where(F.col("f.kind") != F.col("kind")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("d", "f.rank", "f.name", "f.at"))).alias("odd"))
    odd = odd.select(F.expr("kind ^ 0L").alias("of_kind"), "odd")
    both = kinds.join(odd, F.col("kind") == F.col("of_kind"), "left")
    return both.select("c1", "c2", F.col("rank").alias("f_rank"), F.col("name").alias("f_name"), F.col("at").alias("f_at"), "odd")


def _later_stretches(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """Passages that occurred before, as ``PARTS``: those in a row with one keeper are one row.

    In one text a passage goes that starts ``LONG_RUN`` words after its first occurrence or later.
    """
    known = firsts.select(F.expr("c1 ^ 0L").alias("k1"), F.expr("c2 ^ 0L").alias("k2"), "f_rank", "f_name", "f_at", "odd")
    both = found.join(known, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank, name, at, low, *first = (np.asarray(batch.column(k)).astype(np.int64) for k in range(7))
        starts, ends, odd = (batch.column(k) for k in (7, 8, 9))
        many = starts.value_lengths().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), many)
        before = np.cumsum(many) - many
        d = np.arange(len(row)) - before[row]
        f_rank, f_name, f_at = (x[row] for x in first)
        listed = odd.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if listed.any():
            number, *others = (np.asarray(c).astype(np.int64) for c in odd.flatten().flatten())
            place = before[np.repeat(np.arange(batch.num_rows), listed)] + number
            for column, values in zip((f_rank, f_name, f_at), others):
                column[place] = values
        same = (f_rank == rank[row]) & (f_name == name[row])
        goes = ~same | (at[row] >= f_at + LONG_RUN)
        start, end = starts.flatten().to_numpy(), ends.flatten().to_numpy()
        row, d, f_rank, start, end = row[goes], d[goes], f_rank[goes], start[goes], end[goes]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (d[1:] != d[:-1] + 1) | (f_rank[1:] != f_rank[:-1])
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(row)) - 1
        of = row[begin]
        place = at[of] - low[of] + d[begin]
        words = d[last] - d[begin] + LONG_RUN
        columns = [rank[of], name[of], np.ones(len(of), np.int32), place.astype(np.int32), words.astype(np.int32), start[begin], end[last], f_rank[begin]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rank", "name", "kind", "first", "words", "start", "end", "keeper"])

    columns = ("rank", "name", "at", "low", "f_rank", "f_name", "f_at", "starts", "ends", "odd")
    return arrow_pass(both.select(*columns), PARTS, work)


def later_passages(docs: DataFrame) -> DataFrame:
    """All passages of ``LONG_RUN`` words that occurred before, as ``PARTS``, stored; each step's shuffles go before the next."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch, shuffles_go(spark):
        found = scratch.table(stretches(docs))
        kinds = scratch.table(_kinds(found))
        firsts = scratch.table(_firsts(kinds, scratch.table(_shared_kinds(kinds))))
        return stored(_later_stretches(found, firsts))


SPANS = "rank bigint, name bigint, start bigint, end bigint, first bigint, words bigint, units bigint, keepers array<bigint>"


def _spans(rows: np.ndarray, alone: bool) -> list[np.ndarray]:
    """What goes of whole documents: rows of ``PARTS`` (in columns) in order of rank, name, first and kind.

    Columns of ``SPANS``, the keepers as numbers of the row's span and ranks.
    """
    rank, name, kind, first, words, start, end, keeper = rows
    doc = np.zeros(len(rank), np.int64)
    doc[1:] = np.cumsum((rank[1:] != rank[:-1]) | (name[1:] != name[:-1]))
    # Runs of units next to each other; a unit once, should rows repeat their document.
    unit = np.flatnonzero(kind == 0)
    if len(unit):
        again = np.zeros(len(unit), bool)
        again[1:] = (doc[unit][1:] == doc[unit][:-1]) & (first[unit][1:] == first[unit][:-1])
        unit = unit[~again]
    new = np.ones(len(unit), bool)
    new[1:] = (doc[unit][1:] != doc[unit][:-1]) | (first[unit][1:] != first[unit][:-1] + words[unit][:-1])
    run = np.cumsum(new) - 1
    total = np.bincount(run, words[unit], minlength=1)
    solid = np.bincount(run, np.where(words[unit] >= LEAST_UNIT, words[unit], 0), minlength=1)
    enough = (total >= LEAST_RUN) & (solid >= LEAST_SOLID) | (total >= LONG_RUN)
    goes = np.zeros(len(rank), bool)
    goes[unit] = enough[run] | (alone & (words[unit] >= LEAST_UNIT))
    goes[kind == 1] = True
    at = np.flatnonzero(goes)
    if not len(at):
        return [np.zeros(0, np.int64) for _ in range(9)]
    doc, first, words, start, end, keeper, kind, rank, name = (x[at] for x in (doc, first, words, start, end, keeper, kind, rank, name))
    base = doc << 32
    reach = np.maximum.accumulate(base + first + words)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | ((base + first)[1:] > reach[:-1])
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(at)) - 1
    span = np.cumsum(fresh) - 1
    order = np.lexsort((keeper, span))
    kept = np.ones(len(at), bool)
    kept[1:] = (span[order][1:] != span[order][:-1]) | (keeper[order][1:] != keeper[order][:-1])
    return [
        rank[begin],
        name[begin],
        np.minimum.reduceat(start, begin),
        np.maximum.reduceat(end, begin),
        first[begin],
        reach[last] - (base + first)[begin],
        np.add.reduceat((kind == 0).astype(np.int64), begin),
        span[order][kept],
        keeper[order][kept],
    ]


def merged(parts: DataFrame, alone: bool) -> DataFrame:
    """``SPANS`` that go, from ``PARTS``: runs of units, single ones if ``alone``, and stretches; what overlaps or touches is one span.

    Rows come to a task by document and in order; it holds a batch and one document's rows at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told(rows: np.ndarray) -> pa.RecordBatch:
            *columns, of, keeper = _spans(rows, alone)
            edge = pa.array(np.searchsorted(of, np.arange(len(columns[0]) + 1)).astype(np.int32))
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.ListArray.from_arrays(edge, pa.array(keeper))], ["rank", "name", "start", "end", "first", "words", "units", "keepers"])

        for batch in batches:
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            if not rows.shape[1]:
                continue
            # The last document may go on in the next batch.
            open_ = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            if held and (cut or held[-1][0, -1] != rows[0, 0] or held[-1][1, -1] != rows[1, 0]):
                before = np.concatenate([*held, rows[:, :cut]], axis=1)
                held = []
                yield told(before)
            elif cut:
                yield told(rows[:, :cut])
            held.append(rows[:, cut:])
        if held:
            yield told(np.concatenate(held, axis=1))

    dealt = parts.repartition(partitions(parts.sparkSession), "rank", "name").sortWithinPartitions("rank", "name", "first", "kind")
    return dealt.mapInArrow(work, SPANS)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """The runs of units to remove, as ``SPANS``: rank, name, start, end (code points), first word, words, units, keepers (ranks that keep a unit of it)."""
    return merged(later_units(docs), False)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """What is to be removed, as ``repeated_runs`` has it: its runs, every unit of ``LEAST_UNIT`` words and every passage that occurred before.

    Of one text, a passage goes that does not overlap the first occurrence. Spans that overlap or touch
    are one; ``units`` counts the units that go as such, so it is 0 for a passage that holds none.
    """
    return merged(later_units(docs).unionByName(later_passages(docs)), True)


def removed_runs(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = repeated_runs) -> DataFrame:
    """One row for every run of units that goes: doc_id, start, end (code points), words, units, kept_doc_id, kept_doc_ids.

    kept_doc_ids has, in order, the doc_id of every document that keeps a unit or passage of the run, the document
    itself where it repeats itself, and NULL last for documents without one; kept_doc_id is the first of them.
    Which units go is said in ``substring_duplicates``; documents that lose nothing have
    no row. With ``find=repeated_spans`` single units and repeated passages go too.
    """
    told = find(docs)
    back = lambda c: F.nullif(c, F.lit(_NO_ID))
    return told.select(back(F.col("rank")).alias("doc_id"), "start", "end", "words", "units", back(F.col("keepers")[0]).alias("kept_doc_id"), F.transform("keepers", back).alias("kept_doc_ids"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """``removed_runs`` with every repeated unit of ``LEAST_UNIT`` words and every repeated passage of ``LONG_RUN`` words, wherever it starts."""
    return removed_runs(docs, repeated_spans)


def substring_duplicates(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = repeated_runs) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, removed (spans start, end, words in code points, in order), removed_chars, removed_words.

    A unit goes if it occurred before: in a document of smaller doc_id (missing ones come last, of equal
    ones the text with the smaller hash), or earlier in the same text. It goes as part of a run of such
    neighbouring units with at least ``LEAST_RUN`` words, ``LEAST_SOLID`` of them in units of
    ``LEAST_UNIT`` words or more, or with ``LONG_RUN`` words in any units. Rows that repeat doc_id and
    text are one document. Missing and empty texts have no unit. Other columns are not read. No rows
    in, no rows out. With ``find=repeated_spans`` a unit of ``LEAST_UNIT`` words goes on its own, and
    every passage of ``LONG_RUN`` words that occurred before goes too, wherever it starts.
    """
    span = F.struct("start", "end", "words")
    spans = find(docs).groupBy("rank", "name").agg(F.array_sort(F.collect_list(span)).alias("removed"))
    spans = spans.select(F.col("rank").alias("of_rank"), F.col("name").alias("of_name"), "removed")
    rows = named(docs)
    both = rows.join(spans, (rows["rank"] == spans["of_rank"]) & (rows["name"] == spans["of_name"]), "left")
    total = lambda f: F.coalesce(F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + f(x)), F.lit(0).cast("bigint"))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,words:bigint>>")
    return both.select(
        "doc_id",
        "n_chars",
        F.coalesce("removed", nothing).alias("removed"),
        total(lambda x: x["end"] - x["start"]).alias("removed_chars"),
        total(lambda x: x["words"]).alias("removed_words"),
    )


def named(docs: DataFrame) -> DataFrame:
    """doc_id, rank, name and n_chars of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts_of(batch.column(1))
        name, chars = np.zeros(batch.num_rows, U), np.zeros(batch.num_rows, np.int64)
        for first, last, part, at in pieces(data, offsets):
            name[first:last] = _names(part, at).view(U)
            chars[first:last] = bytescan.counts(_LEAD[part], at)
        ids = batch.column(0)
        return pa.RecordBatch.from_arrays([ids, ids.fill_null(_NO_ID), pa.array(name.view(np.int64)), pa.array(chars)], ["doc_id", "rank", "name", "n_chars"])

    return arrow_pass(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")), "doc_id bigint, rank bigint, name bigint, n_chars bigint", work)


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, spans):
        at, kept = 0, []
        for span in gone if gone is not None else ():
            kept.append(text[at : span["start"]])
            at = span["end"]
        out.append("".join([*kept, text[at:]]))
    return pd.Series(out)


def without_spans(text: Column, spans: Column) -> Column:
    """The text less its spans (as ``removed`` has them)."""
    return F.pandas_udf(_cut, "string")(text, spans)
