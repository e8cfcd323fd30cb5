"""Spelling variants: words one edit apart, found by pivotal bigrams, and the form that each comes from.

Bigrams are ordered by how many words hold them, rarest first. A word's prefix is its three rarest
bigrams and all that are no more frequent than the third; its pivots are the two of them that share no
letter and are rarest together. One edit spoils one of two disjoint bigrams at most, so of two words that
are one edit apart the one whose prefix ends earlier in the order has a pivot in the prefix of the other.

There the places of a shared bigram are limited: as the edit is before or behind it, either all that
stands before it, or all behind it, is equal in both, and the lengths differ by one at most. Pivots and
prefixes therefore meet by bigram with all before it (or all behind it) and by length. What meets is
verified by the edit distance of the whole words. Where the equal letters are few, half of the others is
equal as well, and the words meet by that too, so that common beginnings and endings make no large groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.bytescan import U, mixed
from caseflow.llm.common import pieces, stored, text_of, texts_of

#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a letter.
SPOILED = 97
#: A form occurs at least so many times as often as the word.
RATIO = 2
#: Letters: a-z and U+00C0 to U+00FF, so bigrams are no more than the square of their number.
LETTERS = 26 + 64
#: Letters that tell words apart well enough to meet by them alone.
KNOWN = 5
#: Rows of longer words carry a digest in place of the word, and what meets is verified afterwards.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    """What a byte adds to a CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC_TABLE = _crc_table()


def runs_of_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF: starts, ends, runs before each document."""
    latin = data == 0xC3  # the first byte of U+00C0 to U+00FF
    inside = latin | ((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A))
    inside[1:] |= latin[:-1]
    return bytescan.spans(inside.view(np.uint8), offsets, bytescan._lookup(lambda b: b == 1))


def crc32_of(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span's bytes after others whose CRC-32 is ``prefix``."""
    state = prefix ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")
    size = (ends - starts)[order]
    state, at = state[order], starts[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))  # spans of more than k bytes
        state[:n] = _CRC_TABLE[(state[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _words(data: np.ndarray, offsets: np.ndarray, ids: list[int | None]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of these texts, after some lost a letter, with their occurrences."""
    folded = bytescan.SMALL[data]
    starts, ends, bounds = runs_of_letters(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    names = bytescan.hash_spans(folded, starts, ends)
    # Each distinct run of a document once.
    order = np.lexsort((names, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (names[order][1:] != names[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(fresh)
    times, one = np.diff(np.append(at, len(order))), order[at]
    starts, ends, doc, names = starts[one], ends[one], doc[one], names[one]
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc32_of(heads[doc], folded, starts, ends)
    spoiled = np.flatnonzero(crc % SPOILED == 0)
    odd = []
    for i in spoiled.tolist():
        run = folded[starts[i] : ends[i]].tobytes().decode()
        cut = int(crc[i]) % len(run)
        odd.append(run[:cut] + run[cut + 1 :])
    whole = np.ones(len(one), bool)
    whole[spoiled] = False
    # What is left as it is: by word, and only words that may be long enough (a letter has two bytes at most).
    whole &= ends - starts >= LEAST_LENGTH
    order = np.argsort(names[whole])
    keep = np.flatnonzero(whole)[order]
    fresh = np.flatnonzero(np.concatenate([[True], names[keep][1:] != names[keep][:-1]])) if len(keep) else keep
    total = np.add.reduceat(times[keep], fresh) if len(keep) else np.zeros(0, np.int64)
    shown = keep[fresh]
    size = ends[shown] - starts[shown]
    edges = np.concatenate([[0], np.cumsum(size)])
    body = folded[np.arange(edges[-1]) + np.repeat(starts[shown] - edges[:-1], size)]
    words = pa.LargeStringArray.from_buffers(len(shown), pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
    return pa.concat_arrays([words, pa.array(odd, pa.string())]), np.concatenate([total, times[spoiled]])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: the words of all texts with ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.

    Runs are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in small letters. A run whose
    crc32 (of doc_id, a colon and the run, in UTF-8; of a missing doc_id nothing) is divisible by
    ``SPOILED`` loses the code point at crc32 modulo its length. Occurrences are summed in every batch
    before the shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            for begin, stop, part, at in pieces(data, offsets, 1 << 23):
                words, n = _words(part, at, ids[begin:stop])
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    counted = rows.mapInArrow(work, "word string, n bigint").where(F.char_length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters of all words, below ``LETTERS``, and where each word starts."""
    data, offsets = texts_of(words)
    first = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(first)])
    second = np.append(data[1:], 0)
    code = np.where(data == 0xC3, second.astype(np.int32) - 0x80 + 26, data.astype(np.int32) - 0x61)
    return code[first], chars[offsets]


def bigram_counts(words: DataFrame) -> np.ndarray:
    """In how many words each bigram is: one number for each of the ``LETTERS`` ** 2, whatever the words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for batch in batches:
            code, at = _letters(batch.column(0))
            gram, doc, _ = _grams(code, at)
            total += np.bincount(np.unique(doc * LETTERS**2 + gram) % LETTERS**2, minlength=LETTERS**2)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["gram", "n"])

    out = np.zeros(LETTERS * LETTERS, np.int64)
    for r in words.select("word").mapInArrow(work, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def _grams(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of all words in order: number, word, place."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code)) - at[:-1][doc]
    inner = np.flatnonzero(place < size[doc] - 1)
    return code[inner] * LETTERS + code[inner + 1], doc[inner], place[inner]


_PLACE_BITS = 40


def chosen(code: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bigrams of the prefixes of all words: word, place, whether it is a pivot; and by word the end of the prefix in the order.

    rank: place of each bigram in the order. Words have four bigrams or more. Pivots come from a dynamic
    program over the places: the least sum of ranks of one bigram up to here, and of one that ends
    before here and this one.
    """
    gram, doc, place = _grams(code, at)
    ranks = rank[gram]
    order = np.lexsort((ranks, doc))
    begin = np.searchsorted(doc, np.arange(len(at) - 1))
    last = ranks[order][begin + 2]
    inside = ranks <= last[doc]
    far = np.int64(2 * LETTERS**2)
    cost = np.where(inside, ranks, far)
    # One bigram: the least cost of the places up to here, with its place in the low bits.
    one = _running((cost << _PLACE_BITS) | place, doc)
    two = np.full(len(cost), 4 * far)
    rows = np.flatnonzero(place >= 2)
    two[rows] = cost[rows] + (one[rows - 2] >> _PLACE_BITS)
    best = np.minimum.reduceat(two, begin)
    second = np.flatnonzero(two == best[doc])
    second = second[np.concatenate([[True], doc[second][1:] != doc[second][:-1]])]
    first = begin + (one[second - 2] & ((1 << _PLACE_BITS) - 1))
    pivot = np.zeros(len(cost), bool)
    pivot[first] = pivot[second] = True
    return doc[inside], place[inside], pivot[inside], last


def _running(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least of the values up to here within each group; groups come in order."""
    out = values.copy()
    step = 1
    longest = int(np.bincount(group).max()) if len(group) else 0
    while step < longest:
        same = group[step:] == group[:-step]
        out[step:] = np.where(same, np.minimum(out[step:], out[:-step]), out[step:])
        step *= 2
    return out


def _hashed(letter: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    order = np.argsort(first, kind="stable")
    out = np.empty(len(first), U)
    out[order] = bytescan.fold_runs(letter, first[order], last[order])
    return out


def entries(words: DataFrame, rank: np.ndarray, pivots: bool) -> DataFrame:
    """Rows of key, last and ``of``, for the pivots of all words or for their prefixes.

    A bigram has two kinds of key, of all letters up to its end and of all from its start: the edit is in
    the rest. Each goes with the lengths of a pivot's word and of the other word. Where these letters are
    few (``KNOWN``), many words share them, and so the edit is narrowed down further: either the first half of the rest is
    equal too, or the last one, and there is a key for each.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, at = _letters(batch.column(0))
            doc, place, pivot, last = chosen(code, at, rank)
            if pivots:
                doc, place = doc[pivot], place[pivot]
            letter = mixed(code.astype(U) + U(1))
            begin, end = at[:-1][doc], at[1:][doc]
            size = end - begin
            keys, of = [], []

            def add(kind: int, rows: np.ndarray, own: np.ndarray, apart: int, known: np.ndarray) -> None:
                mine, other = (own, own + apart) if pivots else (own + apart, own)
                keys.append(mixed(known + mixed((mine * 4096 + other).astype(U) * U(8) + U(kind))))
                of.append(doc[rows])

            upto, after = _hashed(letter, begin, begin + place + 2), _hashed(letter, begin + place, end)
            for apart in (-1, 0, 1):
                for kind, held, known in ((0, place + 2, upto), (1, size - place, after)):
                    few = np.flatnonzero(held <= KNOWN)
                    rows = np.flatnonzero(held > KNOWN)
                    add(kind, rows, size[rows], apart, known[rows])
                    rest = np.maximum(size[few] - held[few] + min(apart, 0), 0)
                    half = rest // 2
                    b, e, p, k = begin[few], end[few], place[few], known[few]
                    if kind == 0:
                        near, far = _hashed(letter, b, b + p + 2 + half), k + mixed(_hashed(letter, e - (rest - half), e))
                    else:
                        near, far = _hashed(letter, b + p - (rest - half), e), k + mixed(_hashed(letter, b, b + half))
                    add(2 + 2 * kind, few, size[few], apart, near)
                    add(3 + 2 * kind, few, size[few], apart, far)
            of = np.concatenate(of)
            columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(last[of].astype(np.int32)), batch.column(1).take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "last", "of"])

    return words.select("word", "of").mapInArrow(work, "key bigint, last int, of string")


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of words exactly one inserted, deleted or replaced code point apart, in both directions: word, other."""
    tag = F.concat(F.lit("#"), F.sha2(F.col("word").cast("binary"), 256))
    named = words.select("word", F.when(F.char_length("word") > LONG_WORD, tag).otherwise(F.col("word")).alias("of"))
    counts = bigram_counts(words)
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    left = entries(named, rank, True)
    right = entries(named, rank, False).select(F.col("key").alias("at"), F.col("last").alias("other_last"), F.col("of").alias("other"))
    # The one whose prefix ends earlier gives the pivots.
    before = (F.col("last") < F.col("other_last")) | (F.col("last") == F.col("other_last")) & (F.col("of") < F.col("other"))
    short = ~(F.col("of").startswith("#") | F.col("other").startswith("#"))
    one = F.levenshtein("of", "other", 1) == 1
    met = left.join(right, (F.col("key") == F.col("at")) & before & (~short | one))
    met = stored(met.select("of", "other").distinct())
    long = named.where(F.col("of").startswith("#")).select(F.col("of").alias("tag"), F.col("word").alias("text"))
    far = met.where(~short)
    for c in ("of", "other"):
        far = far.join(long, F.col(c) == F.col("tag"), "left").withColumn(c, F.coalesce("text", c)).drop("tag", "text")
    pairs = met.where(short).union(far.where(one))
    return pairs.select(F.col("of").alias("word"), "other").union(pairs.select("other", "of"))


def roots(links: DataFrame) -> DataFrame:
    """word and root for links word to form: forms are followed to the last, twice as far each round."""
    at = stored(links.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("head"), F.col("root").alias("next"))
        told = at.join(further, F.col("root") == F.col("head"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        told = stored(told)
        at = told.select("word", "root")
        if told.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row for every word of ``vocabulary``: word, form, root, n, n_near, form_n.

    n_near: words that differ by exactly one code point inserted, deleted or replaced. form: the one of
    them with the largest n (of equal ones the smallest in code-point order), if that is at least
    ``RATIO`` times the word's own, else NULL; form_n its n. root: the last of the forms that the word
    leads to, itself where it has none. As n doubles with each form, chains are short and end.
    Missing and empty texts have no words; rows that repeat count each. Other columns are not read. No
    rows in, no rows out.
    """
    words = stored(vocabulary(docs))
    near = near_words(words)
    others = words.select(F.col("word").alias("of_other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near.join(others, F.col("other") == F.col("of_other")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    near = near.select(F.col("word").alias("of_word"), "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.form").alias("near_form"))
    told = words.join(near, F.col("word") == F.col("of_word"), "left")
    has = F.col("near_n") >= RATIO * F.col("n")
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has, F.col("near_form")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL")).select(F.col("word").alias("of_word"), "root")
    both = told.join(ends, F.col("word") == F.col("of_word"), "left")
    return both.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
