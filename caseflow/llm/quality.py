"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.bytescan import U, _lookup, counts
from caseflow.llm.common import arrow_pass, fixed_binary, fixed_list, pieces, remainder_of_id, stored, summed_lines, text_of, texts_of, unpacked, whole_rows

FOURIER = 256
RIDGE = 1e-3
WIDTH = 4.0
SEED = 7
CELLS = 2000
ACCEPT = 0.7

_LETTER = _lookup(lambda b: b >= 0x80 or chr(b).isalpha())
_DIGIT = _lookup(lambda b: 0x30 <= b <= 0x39)
_CAPITAL = _lookup(lambda b: 0x41 <= b <= 0x5A)
_MARK = _lookup(lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum())
_STOP = _lookup(lambda b: chr(b) in ".,;:?'\"-()")
_LOUD = _lookup(lambda b: chr(b) == "!")
_LEAD = _lookup(lambda b: b & 0xC0 != 0x80)
_LINE = _lookup(lambda b: b != 0x0A)

#: The statistics of a text, in order.
STATISTICS = (
    "log_chars", "log_words", "log_lines", "words_a_line", "letters", "digits", "capitals", "marks", "odd_marks", "loud", "blanks",
    "word_length", "word_spread", "short_words", "long_words", "distinct_words", "top_word", "distinct_triples", "top_triple",
    "repeated_lines", "capital_words", "marked_words", "bare_marks", "stopped_lines", "run_of_marks", "repeated_neighbours",
)


def _shares(keys: np.ndarray, doc: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct keys and of the commonest key in each document."""
    if len(keys) == 0:
        return np.ones(n), np.zeros(n)
    both = (doc.astype(U) << U(44)) | (keys >> U(20))
    both.sort()
    fresh = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    times = np.diff(np.append(fresh, len(both)))
    owner = (both[fresh] >> U(44)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, times)
    some = np.maximum(total, 1)
    return np.where(total > 0, distinct / some, 1.0), top / some


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of every whole text, float64[n, len(STATISTICS)]."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    solid = bytescan.SOLID
    starts, ends, bounds = bytescan.spans(data, offsets, solid)
    words = np.diff(bounds)
    one = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(np.float64)
    hashes = bytescan.hash_spans(data, starts, ends)
    line_starts, line_ends, line_bounds = bytescan.spans(data, offsets, _LINE)
    lines = np.diff(line_bounds)
    line_doc = np.repeat(np.arange(n), lines)
    line_hash = bytescan.hash_spans(data, line_starts, line_ends)
    triples, triple_doc, _ = bytescan.shingles(hashes, bounds, 3)
    of_words = lambda x: np.bincount(doc, x, n) / one
    mean = of_words(length)
    spread = np.sqrt(np.maximum(of_words(length**2) - mean**2, 0))
    marks, stops, loud = _MARK[data], _STOP[data], _LOUD[data]
    share = lambda x: counts(x, offsets) / some
    first, final = data[starts], data[ends - 1]
    before_final = data[np.maximum(ends - 2, starts)]
    odd_final = _MARK[final] & _MARK[before_final] & (ends - starts > 1)
    bare = _MARK[first] & (ends - starts == 1)
    stopped = _STOP[data[line_ends - 1]] if len(line_ends) else np.zeros(0, bool)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    beside = np.zeros(len(data), bool)
    if len(data) > 1:
        beside[1:] = marks[1:] & marks[:-1]
    distinct, top = _shares(hashes, doc, n, words)
    distinct3, top3 = _shares(triples, triple_doc, n, np.bincount(triple_doc, minlength=n))
    distinct_lines, _ = _shares(line_hash, line_doc, n, lines)
    out = [
        np.log1p(counts(_LEAD[data], offsets)), np.log1p(words), np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), share(_LETTER[data]),
        share(_DIGIT[data]), share(_CAPITAL[data]), share(marks), share(marks & ~stops & ~loud), share(loud), share(~solid[data]),
        np.minimum(mean, 50), np.minimum(spread, 50), of_words(length <= 3), of_words(length >= 12), distinct, top, distinct3, top3,
        1 - distinct_lines, of_words(_CAPITAL[first]), of_words(_MARK[final]), of_words(bare), np.bincount(line_doc, stopped, n) / np.maximum(lines, 1), of_words(odd_final) + share(beside), of_words(same),
    ]
    return np.stack(out, axis=1)


def text_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = texts_of(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for first, last, part, at in pieces(data, offsets):
        out[first:last] = statistics(part, at)
    return out


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, as one pass over the texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), fixed_list(text_statistics(batch.column(1)), pa.float64())], ["doc_id", "stats"])

    return arrow_pass(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")), "doc_id bigint, stats array<double>", work)


@dataclass
class Model:
    """What scores a text: scaling, Fourier directions, ridge weights, calibration knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """sqrt(2/D) cos(Wx + b): their inner products approximate a Gaussian kernel of ``WIDTH``."""
        random = np.random.default_rng(SEED)
        directions = random.normal(size=(stats.shape[1], FOURIER)) / WIDTH
        phases = random.uniform(0, 2 * np.pi, FOURIER)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FOURIER) * np.cos(x @ directions + phases), np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit to means ``y`` with weights ``n`` at rising ``x`` (pooled neighbours)."""
    blocks: list[list[float]] = []
    for at, mean, weight in zip(x, y, n):
        blocks.append([mean * weight, weight, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, _, high = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
            blocks[-1][3] = high
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [v for b in blocks for v in (b[0] / b[1],) * 2]
    return np.array(xs), np.array(ys)


def _stats_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, len(STATISTICS))


def fit(marked: DataFrame) -> Model:
    """A model from rows of stats and label (0 or 1; others are left out).

    Every partition adds up its own normal equations; each row of the matrix is then summed over
    the partitions in two levels, as a stream, so the driver gets one matrix of ``FOURIER + 1`` rows however large the
    input is. Calibration pools the scores of ``CELLS`` cells. Without a usable row every score is 0.5.
    """
    rows = stored(marked.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("double").alias("label")))
    width = len(STATISTICS)
    one = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)],
    ).head()
    if not one["n"]:
        return Model(np.zeros(width), np.ones(width), np.zeros(FOURIER + 1))
    mean = np.array([one[f"m{i}"] for i in range(width)])
    scale = np.array([max(one[f"s{i}"], 1e-6) for i in range(width)])
    blank = Model(mean, scale, np.zeros(FOURIER + 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOURIER + 1, FOURIER + 2))
        seen = 0
        for batch in batches:
            x = blank.features(_stats_of(batch.column(0)))
            y = np.asarray(batch.column(1))
            total += x.T @ np.concatenate([x, y[:, None]], axis=1)
            seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOURIER + 1, dtype=np.int32)), fixed_binary(total)], ["i", "line"])

    lines = summed_lines(rows.mapInArrow(sums, "i int, line binary"), np.float64, "i").collect()
    table = np.stack([np.frombuffer(r["line"]) for r in sorted(lines, key=lambda r: r["i"])])
    gram = table[:, :-1] + RIDGE * one["n"] * np.diag([*[1.0 / FOURIER] * FOURIER, 0.0])
    model = Model(mean, scale, np.linalg.lstsq(gram, table[:, -1], rcond=None)[0])

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = np.round(np.clip(model.raw(_stats_of(batch.column(0))), -1, 2) * CELLS / 3).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], ["cell", "label"])

    cells = arrow_pass(rows, "cell int, label double", placed).groupBy("cell").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    cells.sort(key=lambda r: r["cell"])
    model.knots = isotonic(*(np.array([float(r[k]) for r in cells]) for k in ("cell", "y", "n")))
    model.knots = (model.knots[0] * 3 / CELLS, model.knots[1])
    return model


def training_rows(stats: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """stats and label of the marked documents that may teach: crc32(doc_id as text) mod 4 is not 2."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("marked_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where(remainder_of_id(modulus, "marked_id") != held_out)
    return stats.join(marks, stats["doc_id"] == marks["marked_id"]).select("stats", "label")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score is a function of the whole text alone: near 1 where documents with such statistics are
    marked good. NULL counts as empty; an empty text gets the score of empty statistics. Rows whose
    mark is missing or neither 0 nor 1 teach nothing, rows that repeat teach each. A missing doc_id is
    not held out and never teaches. Other columns are not read.
    """
    stats = stored(described(docs))
    model = fit(training_rows(stats, labels))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stats_of(batch.column(1))))], ["doc_id", "score"])

    scored = arrow_pass(stats, "doc_id bigint, score double", work)
    return scored.select(
        "doc_id",
        F.coalesce(remainder_of_id(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of ``ACCEPT`` or more, all columns; texts are scored where they lie."""
    model = fit(training_rows(described(docs), labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(text_statistics(pa.array(texts, pa.large_string()))))

    return unpacked(whole_rows(docs, score=score(text_of())).where(F.col("score") >= ACCEPT), docs)
