"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is the weighted set of its five-word shingles: a shingle weighs its count times the mean
inverse document frequency of its words. Words are runs of letters and digits, small letters; their
document frequencies are counted over all documents, word by word; below a share of the documents words count as
equally rare, so that the table has a bound whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.bytescan import U, mixed
from caseflow.llm.common import arrow_pass, fixed_list, partitions, pieces, shuffles_go, stored, text_of, texts_of, unpacked, whole_rows

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
#: A word in fewer documents than one of so many counts as one in as many.
RAREST = 4096
SALTS = 16
PAIRS_IN_A_PLACE = 1000
ROWS_IN_A_PART = 25_000
#: Cells that a set's weight is summed in by key, for a bound on what two sets share.
CELLS = 256
#: Quantised draws of (r, c, beta): a sample picks one by 16 bits of a hash of the shingle.
DRAWS = 1 << 16
SEED = 11


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = bytescan.spans(data, offsets, bytescan.WORDLIKE)
    return bytescan.hash_spans(data, starts, ends, bytescan.SMALL), bounds


class Idf(NamedTuple):
    """Inverse document frequencies: of the words in ``words`` (hashes, in order) ``values``, of all others ``rare``."""

    words: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.rare, np.float32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.values[at], np.float32(self.rare))


def word_idf(docs: DataFrame) -> Idf:
    """ln((1 + N) / (1 + df)) + 1 for every word, over all rows of text; df counts as N / ``RAREST`` at least.

    So rare words all weigh alike at every size, and the words that have to be told apart are bounded: no more
    than ``RAREST`` times the mean number of distinct words of a document are that frequent. Words are counted exactly,
    in every batch before the shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            seen = []
            for _, _, part, at in pieces(data, offsets):
                words, bounds = _words(part, at)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
                order = np.argsort(words, kind="stable")  # documents stay in order
                word, doc = words[order], doc[order]
                fresh = np.ones(len(word), bool)
                fresh[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
                seen.append(word[fresh])
            word, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    total = docs.count()
    floor = total / RAREST
    found = docs.select("text").mapInArrow(counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > floor)
    rows = found.toPandas()
    order = np.argsort(rows["word"].to_numpy().astype(np.int64).view(U))
    words, n = rows["word"].to_numpy().astype(np.int64).view(U)[order], rows["n"].to_numpy().astype(np.float64)[order]
    value = lambda df: np.log((1 + total) / (1 + df)) + 1
    return Idf(words, value(n).astype(np.float32), float(np.float32(value(floor))))


def weighted_sets(data: np.ndarray, offsets: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order of document and key: document, 48-bit key, weight; and 128-bit names of the word sequences.

    A text without words is named by its bytes other than white space, and has no shingle.
    """
    words, bounds = _words(data, offsets)
    n = len(offsets) - 1
    names = np.stack([bytescan.fold_runs(words, bounds[:-1], bounds[1:], base) for base in (0, 1)], axis=1)
    for i in np.flatnonzero(np.diff(bounds) == 0):
        rest = data[offsets[i] : offsets[i + 1]]
        rest = rest[bytescan.SOLID[rest]]
        one = np.array([0]), np.array([len(rest)])
        names[i] = [bytescan.hash_spans(rest, *one, base=base)[0] if len(rest) else U(base) for base in (0, 1)]
    shingle, doc, first = bytescan.shingles(words, bounds, SHINGLE)
    rarity = np.zeros(len(words) + 1)
    np.cumsum(idf.of(words), dtype=np.float64, out=rarity[1:])
    last = np.minimum(first + SHINGLE, bounds[1:][doc])
    mean = (rarity[last] - rarity[first]) / np.maximum(last - first, 1)
    keys = (doc.astype(U) << U(48)) | (shingle >> U(16))
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(keys)))
    weight = (times * mean[order[fresh]]).astype(np.float32)
    return (keys[fresh] >> U(48)).astype(np.int64), keys[fresh] & U((1 << 48) - 1), weight, names.reshape(n, 2)


_random = np.random.default_rng(SEED)
_R = _random.gamma(2.0, 1.0, DRAWS).astype(np.float32)
_LN_C = np.log(_random.gamma(2.0, 1.0, DRAWS)).astype(np.float32)
_BETA = _random.uniform(0.0, 1.0, DRAWS).astype(np.float32)
_PER_R = (1 / _R).astype(np.float32)
_TURN = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)


def samples(doc: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """``BANDS * ROWS`` consistent weighted samples of each document: uint64[n, BANDS * ROWS].

    For a shingle k of weight S a sample draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from the hash of
    k, sets t = floor(ln S / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r, and keeps (k, t) of
    the least a; of equal ones the least key. Two sets agree in a sample with a probability of their
    weighted Jaccard similarity. Documents without shingles get zeros.
    """
    out = np.zeros((n, BANDS * ROWS), U)
    if len(doc) == 0:
        return out
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    owner = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    full = mixed(keys)
    ln_s = np.log(weight)
    for j in range(BANDS * ROWS):
        draw = ((full * _TURN[j]) >> U(48)).astype(np.int32)
        r, beta = _R[draw], _BETA[draw]
        t = np.floor(ln_s * _PER_R[draw] + beta)
        ln_a = _LN_C[draw] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(ln_a, starts)
        at = np.flatnonzero(ln_a == least[owner])
        if len(at) > len(starts):  # ties: the least key
            at = at[np.lexsort((keys[at], owner[at]))]
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
        out[doc[at], j] = mixed(full[at] + t[at].astype(np.int64).view(U) * U(0x9E3779B97F4A7C15))
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """One 64-bit key a band: the hash of its ``ROWS`` samples and its number."""
    out = np.zeros((len(sampled), BANDS), U)
    for k in range(ROWS):
        out = mixed(out * U(0x9E3779B97F4A7C15) + sampled.reshape(len(sampled), BANDS, ROWS)[:, :, k])
    return mixed(out + np.arange(BANDS, dtype=U))


def signed(docs: DataFrame, idf: Idf) -> DataFrame:
    """doc_id, text_key, the 128-bit name of the word sequence (n1, n2), and the band keys (none without words)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts_of(batch.column(2))
        names = np.zeros((batch.num_rows, 2), U)
        keys = np.zeros((batch.num_rows, BANDS), U)
        some = np.zeros(batch.num_rows, bool)
        for first, last, part, at in pieces(data, offsets, 1 << 18):
            doc, shingle, weight, names[first:last] = weighted_sets(part, at, idf)
            keys[first:last] = band_keys(samples(doc, shingle, weight, last - first))
            some[first:last] = np.bincount(doc, minlength=last - first) > 0
        names, keys = names.view(np.int64), keys.view(np.int64)
        lists = fixed_list(keys, pa.int64())
        lists = pa.array([x if s else [] for x, s in zip(lists.to_pylist(), some)], lists.type) if not some.all() else lists
        columns = [batch.column(0), batch.column(1), pa.array(names[:, 0]), pa.array(names[:, 1]), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n1", "n2", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return arrow_pass(rows, "doc_id bigint, text_key bigint, n1 bigint, n2 bigint, bands array<bigint>", work)


def sets_of(docs: DataFrame, idf: Idf) -> DataFrame:
    """node, the weighted set of the text (48-bit keys in order, then their weights, as bytes), its total weight and its weight by cell.

    Rows of text, node, n1, n2; one whose text doesn't have the name (n1, n2) is left out.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts_of(batch.column(0))
        names, sets, total, cells = [], [], [], []
        for first, last, part, at in pieces(data, offsets):
            doc, shingle, weight, name = weighted_sets(part, at, idf)
            names.append(name.view(np.int64))
            edge = np.searchsorted(doc, np.arange(last - first + 1))
            sets += [shingle[a:b].tobytes() + weight[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
            total.append(np.bincount(doc, weight, last - first))
            cell = doc * CELLS + (shingle & U(CELLS - 1)).astype(np.int64)
            cells.append(np.bincount(cell, weight, (last - first) * CELLS).reshape(-1, CELLS))
        names = np.concatenate(names)
        same = pa.array((names[:, 0] == np.asarray(batch.column(2))) & (names[:, 1] == np.asarray(batch.column(3))))
        columns = [batch.column(1), pa.array(sets, pa.binary()), pa.array(np.concatenate(total))]
        columns.append(fixed_list(np.concatenate(cells).astype(np.float32), pa.float32()))
        return pa.RecordBatch.from_arrays([c.filter(same) for c in columns], ["node", "shingles", "total", "cells"])

    return arrow_pass(docs.select("text", "node", "n1", "n2"), "node bigint, shingles binary, total double, cells array<float>", work)


def opened(shingles: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of a set as ``sets_of`` writes it: 8 and 4 bytes each."""
    n = len(shingles) // 12
    return np.frombuffer(shingles, U, n), np.frombuffer(shingles, np.float32, n, 8 * n)


def shared_enough(sets: DataFrame) -> DataFrame:
    """Which sets can be ``SIMILARITY`` alike to another one of them: node, total, most.

    What a set has to itself counts against it. With a weight of W, of which V is shared with any
    other set, its similarity t to a set of weight X needs (1 + t) V >= t (W + X): X is at most ``most``,
    and at least t W. So what this drops, and pairs with a weight above the other's ``most``, are no links.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                keys, weight = opened(shingles)
                columns = [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), node)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "weight"])

    rows = sets.select("node", "shingles").mapInArrow(listed, "key bigint, node bigint, weight float")
    alone = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("of"), F.min("weight").alias("weight")).where("n = 1")
    own = alone.groupBy("of").agg(F.sum("weight").alias("own"))
    both = sets.select("node", "total").join(own, F.col("node") == F.col("of"), "left")
    shared = F.col("total") - F.coalesce("own", F.lit(0.0))
    most = (1 + 1e-4) * ((1 + SIMILARITY) / SIMILARITY * shared - F.col("total"))
    return both.withColumn("most", most).where(F.col("most") >= (SIMILARITY - 1e-4) * F.col("total")).select("node", "total", "most")


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of the smaller weights over sum of the larger ones, of two sets as ``sets_of`` writes them."""
    (keys_a, weight_a), (keys_b, weight_b) = opened(a), opened(b)
    if not len(keys_a) or not len(keys_b):
        return 0.0
    at = np.searchsorted(keys_b, keys_a)
    at[at == len(keys_b)] = 0
    both = keys_b[at] == keys_a
    shared = float(np.minimum(weight_a[both], weight_b[at[both]]).sum(dtype=np.float64))
    return shared / (float(weight_a.sum(dtype=np.float64)) + float(weight_b.sum(dtype=np.float64)) - shared)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` short rows in as many partitions as they need, where a session's shuffles have more."""
    return df.coalesce(max(1, -(-rows // ROWS_IN_A_PART)))


def verified(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Those of ``n`` pairs (a, b) whose sets have a weighted Jaccard similarity of ``SIMILARITY`` or more."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        alike = np.fromiter((weighted_jaccard(x, y) >= SIMILARITY for x, y in zip(a, b)), bool, len(a))
        return pa.RecordBatch.from_arrays([c.filter(pa.array(alike)) for c in batch.columns[:2]], ["a", "b"])

    # The first node of very many pairs is sent to as many places as it has thousands of them.
    parts = few(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_IN_A_PLACE).alias("parts")), n)
    dealt = few(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), n)
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    heads = heads.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    left = dealt.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(heads, ["a", "part"])
    return arrow_pass(both.select("a", "b", "of_a", "of_b"), "a bigint, b bigint", work)


def components(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """node and comp, the least node that links lead to: least label of the neighbours, then of the label, until none changes. ``n``: about how many nodes and links there are."""
    both = stored(few(few(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), n).distinct(), n))
    labels = stored(few(nodes.select("node", F.col("node").alias("comp")), n))
    while True:
        heard = few(both.join(labels.select(F.col("node").alias("b"), "comp"), "b"), n).groupBy("a").agg(F.min("comp").alias("near"))
        told = labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        told = stored(few(told, n))
        up = told.select(F.col("node").alias("head"), F.col("comp").alias("above"))
        jumped = stored(few(told.join(up, told["comp"] == up["head"], "left").select("node", "old", F.least("comp", "above").alias("comp")), n))
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> old").isEmpty():
            return labels


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and class_key of every row of ``docs`` (doc_id, text); see ``near_duplicates``."""
    idf = word_idf(docs)
    rows = stored(signed(docs, idf))
    total = rows.count()
    # One node for each word sequence; copies meet in the aggregate and go no further.
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    named = rows.groupBy("n1", "n2").agg(one, F.first("bands").alias("bands"))
    nodes = stored(few(named, total).withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", F.posexplode("bands").alias("number", "band")).withColumn("salt", F.pmod("node", F.lit(SALTS)))
    shared = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    # A large bucket is dealt over salts.
    spread = few(shared, BANDS * total).select("band", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = stored(few(keyed.join(spread, ["band", "salt"]).select("band", "number", "node"), BANDS * total))
    n = members.count()
    sought = few(members.select("node").distinct(), n).join(nodes.select("node", "n1", "n2", "one.*"), "node")
    sought = stored(few(sought, n).select("node", "n1", "n2", F.col("doc_id").alias("one_id"), F.col("text_key").alias("one_key")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    same = texts["doc_id"].eqNullSafe(sought["one_id"]) & (texts["text_key"] == sought["one_key"])
    # Dealt out by node once: the joins that follow bring their pairs here and leave the sets where they are.
    found = sets_of(texts.join(sought, same), idf).repartition(partitions(docs.sparkSession), "node")
    sets = stored(found.dropDuplicates(["node"]))
    # First every member against one of its bucket: the one that meets most others in its buckets.
    live = few(members.join(stored(few(shared_enough(sets), n)), "node"), n)
    sizes = live.groupBy("band").agg((F.count(F.lit(1)) - 1).alias("others"), F.min("total").alias("least")).where("others > 0")
    # A member that even the lightest of its bucket is too heavy for has no link there.
    live = stored(few(live.join(sizes, "band").where("most >= least").drop("least"), n))
    met = few(live.groupBy("node").agg(F.sum("others").alias("met")), n)
    best = F.max(F.struct("met", "node"))["node"].alias("pivot")
    pivots = few(live.join(met, "node"), n).groupBy("band").agg(best)
    stars = few(live.join(pivots, "band").where("node <> pivot"), n)
    stars = stored(few(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), n))
    edges = stored(few(verified(stars, sets, n), n))
    heads = stored(few(live.select("node").distinct(), n))
    labels = components(heads, edges, n)
    # Then, in buckets that hold more than one class by now, members of different classes; a pair in the
    # first bucket that it shares, and only if weights, and cells that hold no less than what two sets
    # share, leave room for a link.
    told = few(live.join(labels, "node").select("band", "number", "node", "comp", "total", "most"), n)
    split = told.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    still = few(told.join(split, "band"), n).join(nodes.select("node", "bands"), "node")
    still = stored(few(still.join(sets.select("node", "cells"), "node"), n))
    other = still.select("band", *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "total", "most", "bands", "cells")])
    first = "number = array_position(zip_with(bands, bands_b, (x, y) -> x = y), true) - 1"
    room = "aggregate(zip_with(cells, cells_b, (x, y) -> least(x, y)), 0d, (s, x) -> s + x)"
    room = f"{(1 + 1e-4) * (1 + SIMILARITY) / SIMILARITY}d * {room} >= total + total_b"
    cross = still.join(other, "band").where(f"comp < comp_b and total_b <= most and total <= most_b and {first} and {room}")
    cross = stored(few(cross.select(F.col("node").alias("a"), F.col("node_b").alias("b")), n))
    edges = few(edges.union(verified(cross, sets, n)), n)
    labels = components(heads, edges, n)
    classes = nodes.select("n1", "n2", "node").join(labels, "node", "left").select("n1", "n2", F.coalesce("comp", "node").alias("class_key"))
    classes = few(classes, total).select(F.expr("n1 ^ 0L").alias("m1"), F.expr("n2 ^ 0L").alias("m2"), "class_key")
    alike = (rows["n1"] == classes["m1"]) & (rows["n2"] == classes["m2"])
    return rows.select("doc_id", "text_key", "n1", "n2").join(classes, alike).select("doc_id", "text_key", "class_key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, text_key.

    Documents are linked when the weighted Jaccard similarity of their shingles is ``SIMILARITY`` or
    more, found by ``BANDS`` bands of ``ROWS`` samples (a pair at 0.8 is missed with a probability of
    2 in 10,000) and verified on the whole sets; a class is what links connect. class_id is its
    smallest doc_id, whose row is kept (of rows that repeat it, one); missing doc_ids come last. Texts
    with the same words are one, whatever their case, punctuation and white space; texts without a
    word are alike if they have the same signs, missing and empty ones among them. Texts of fewer than
    five words have one shingle of all their words. Other columns are not read. No rows in, no rows out.

    Every bucket's members are held against the one of them that meets most others, then only members of classes that are still
    apart against each other, so a group of copies costs one comparison each.
    """
    # What each step writes is stored; its shuffle files go when it ends.
    with shuffles_go(docs.sparkSession):
        told = stored(near_classes(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))))
    sizes = told.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    sizes = sizes.select(F.expr("class_key ^ 0L").alias("of_class"), "class_id", "class_size")
    first = Window.partitionBy("class_key", "doc_id").orderBy("text_key")
    rows = told.withColumn("copy", F.row_number().over(first))
    both = rows.join(sizes, rows["class_key"] == sizes["of_class"])
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == 1)
    return both.select("doc_id", "class_id", "class_size", kept.alias("kept"), "text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of every class, with all its columns."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    rows = whole_rows(docs, id=F.col("doc_id").cast("bigint"), key=F.xxhash64(text_of()))
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["key"] == kept["kept_key"])
    return unpacked(rows.join(kept, same, "left_semi").dropDuplicates(["id", "key"]), docs)
