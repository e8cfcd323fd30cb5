"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or boilerplate.

A text is the sequence of its lines with a word. A line has ``FEATURES`` numbers between 0 and 1, all from the
text itself. A label sequence scores the sum of each line's weights for its label, of a weight for every
pair of neighbouring labels, and of weights for the labels at both ends. Weights are fitted by conditional likelihood to
labelled texts (every line of a good text is content, every line of a bad one boilerplate) with sums over
partitions; Viterbi decoding gives the best sequence of every text, and the share of words in content
lines decides whether a text stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.bytescan import SOLID, _lookup, counts
from caseflow.llm.common import arrow_pass, pieces, stored, text_of, texts_of

WINDOW = 5
#: Texts that the base rules drop: fewer words, or a larger share (in percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: A text stays if so much of its words is in lines of content.
LEAST_CONTENT = 0.5
#: About so many labelled texts of each label are learned from, picked by a hash; all if there are fewer.
SAMPLE = 10_000
RIDGE = 1e-3
ROUNDS = 30
#: Sums over partitions are whole numbers of this unit, so they don't depend on the order of adding.
UNIT = float(1 << 24)

_SYMBOL = _lookup(lambda b: chr(b) in "#*$%&|<>")
_NOT_NEWLINE = _lookup(lambda b: b != 0x0A)
_LEAD = _lookup(lambda b: b & 0xC0 != 0x80)
_LETTER = _lookup(lambda b: b >= 0x80 or chr(b).isalpha())
_DIGIT = _lookup(lambda b: 0x30 <= b <= 0x39)
_CAPITAL = _lookup(lambda b: 0x41 <= b <= 0x5A)
_END = _lookup(lambda b: chr(b) in ".!?")

FEATURES = (
    "one",
    "words, log",
    "letters",
    "digits",
    "symbols",
    "other signs",
    "capital words",
    "ends a sentence",
    "word length",
    "short words",
    "distinct words",
    "line occurred before",
    "words in repeated windows",
    "first line",
    "last line",
)
#: Weights: of each feature for boilerplate, of the four pairs of labels, of a boilerplate line at the start and at the end.
SIZE = len(FEATURES) + 6

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


class Lines(NamedTuple):
    """Lines with a word of some texts: features, words, where each text's lines begin; and the base counts of the texts."""

    features: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    base: np.ndarray


def _first_of(doc: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: the number of each distinct (doc, name), and whether the row is the first with it."""
    order = np.lexsort((names, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (names[order][1:] != names[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = np.zeros(len(order), bool)
    first[order[fresh]] = True
    return group, first


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Everything that the rules need to know of some texts."""
    n = len(offsets) - 1
    starts, ends, bounds = bytescan.spans(data, offsets, SOLID)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    total = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    within = lambda sums, a, b: sums[b] - sums[a]
    names = bytescan.hash_spans(data, starts, ends)
    # Words of windows that occur twice or more in the text.
    window, window_doc, first = bytescan.shingles(names, bounds, WINDOW)
    whole = first + WINDOW <= bounds[1:][window_doc]
    window, window_doc, first = window[whole], window_doc[whole], first[whole]
    group, _ = _first_of(window_doc, window)
    twice = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    # Lines, of which those with a word count.
    line_starts, line_ends, _ = bytescan.spans(data, offsets, _NOT_NEWLINE)
    low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    keep = high > low
    line_starts, line_ends, low, high = line_starts[keep], line_ends[keep], low[keep], high[keep]
    words = high - low
    owner = doc[low] if len(low) else np.zeros(0, np.int64)
    line_bounds = np.searchsorted(owner, np.arange(n + 1))
    _, new_line = _first_of(owner, bytescan.hash_spans(data, line_starts, line_ends))
    lead, symbols, solid = total(_LEAD[data]), total(_SYMBOL[data]), total(SOLID[data])
    size = np.maximum(within(solid, line_starts, line_ends), 1)
    of_words = lambda marks: within(total(marks), low, high) / words
    line_of_word = np.repeat(np.arange(len(words)), words)
    _, new_word = _first_of(line_of_word, names)
    letters, digits = total(_LETTER[data]), total(_DIGIT[data])
    chars = within(lead, starts, ends)
    parts = [within(x, line_starts, line_ends) / size for x in (letters, digits, symbols)]
    place = np.arange(len(words))
    features = np.stack(
        [
            np.ones(len(words)),
            np.minimum(np.log(words) / 8 if len(words) else words, 1.0),
            *parts,
            1 - sum(parts),
            of_words(_CAPITAL[data[starts]]),
            _END[data[ends[high - 1] - 1]] if len(words) else np.zeros(0),
            np.minimum(within(total(chars), low, high) / words / 20, 1.0),
            of_words(chars <= 3),
            of_words(new_word),
            ~new_line,
            of_words(repeated),
            place == line_bounds[:-1][owner],
            place == line_bounds[1:][owner] - 1,
        ],
        axis=1,
    ).astype(np.float32)
    edge = lambda sums: within(sums, bounds[:-1], bounds[1:])
    base = np.stack(
        [
            np.diff(bounds),
            edge(total(chars)),
            counts(_SYMBOL[data], offsets),
            counts(~new_line, line_bounds),
            edge(total(repeated)),
        ],
        axis=1,
    )
    return Lines(features, words, line_bounds, base)


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sequences from long to short, where each starts, and how many of them have an element at each step."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    longest = int(size[order[0]]) if len(order) else 0
    live = np.searchsorted(-size[order], -np.arange(longest), "left")
    return order, bounds[:-1][order], live.tolist()


def _split(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = len(FEATURES)
    ends = np.array([[0.0, weights[k + 4]], [0.0, weights[k + 5]]])
    return weights[:k], weights[k : k + 4].reshape(2, 2), ends[0], ends[1]


def decoded(features: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The best label sequence of each text (1: boilerplate), by Viterbi; of equal ones labels are 0 from the end on."""
    own, pair, start, stop = _split(weights)
    emission = np.zeros((len(features), 2))
    emission[:, 1] = features @ own
    out = np.zeros(len(features), np.int8)
    order, first, live = _steps(bounds)
    if not live:
        return out
    back = np.zeros((len(features), 2), np.int8)
    score = start + emission[first]
    for k in range(1, len(live)):
        at = first[: live[k]] + k
        both = score[: live[k], :, None] + pair
        back[at] = both.argmax(axis=1)
        score[: live[k]] = both.max(axis=1) + emission[at]
    label = (score + stop).argmax(axis=1)
    last = bounds[1:][order] - 1
    out[last] = label
    for k in range(len(live) - 1, 0, -1):
        # Sequences with an element at step k, which tells the label at step k - 1.
        at = first[: live[k]] + k
        out[at - 1] = back[at, out[at]]
    return out


def likelihood(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels of all lines, summed over the texts, and its gradient by the weights: forward and backward sums."""
    own, pair, start, stop = _split(weights)
    emission = np.zeros((len(features), 2))
    emission[:, 1] = features @ own
    order, first, live = _steps(bounds)
    if not live:
        return 0.0, np.zeros(SIZE)
    last = bounds[1:][order] - 1
    forward = np.zeros((len(features), 2))
    forward[first] = start + emission[first]
    for k in range(1, len(live)):
        at = first[: live[k]] + k
        forward[at] = np.logaddexp.reduce(forward[at - 1][:, :, None] + pair, axis=1) + emission[at]
    whole = np.logaddexp.reduce(forward[last] + stop, axis=1)
    backward = np.zeros((len(features), 2))
    backward[last] = stop
    pairs = np.zeros((2, 2))
    for k in range(len(live) - 1, 0, -1):
        at = first[: live[k]] + k
        joint = pair + (emission[at] + backward[at])[:, None, :]
        backward[at - 1] = np.logaddexp.reduce(joint, axis=2)
        pairs += np.exp(forward[at - 1][:, :, None] + joint - whole[: live[k], None, None]).sum(axis=0)
    of_text = np.zeros(len(bounds) - 1)
    of_text[order] = whole
    boiler = np.exp(forward[:, 1] + backward[:, 1] - np.repeat(of_text, np.diff(bounds)))
    inner = np.setdiff1d(np.arange(len(features)), last)
    told = np.bincount(2 * labels[inner] + labels[inner + 1], minlength=4)
    gradient = np.concatenate(
        [
            features.T @ (labels - boiler),
            told - pairs.ravel(),
            [(labels[first] - boiler[first]).sum(), (labels[last] - boiler[last]).sum()],
        ]
    )
    score = (labels * emission[:, 1]).sum() + (told * pair.ravel()).sum() + start[labels[first]].sum() + stop[labels[last]].sum()
    return float(score - whole.sum()), gradient


def _packed(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, bounds and labels of the lines of a batch of texts (``labelled_lines``)."""
    raw, at = columns[0].to_pylist(), np.asarray(columns[1])
    features = np.frombuffer(b"".join(raw), np.float32).reshape(-1, len(FEATURES))
    size = np.array([len(r) // (4 * len(FEATURES)) for r in raw], np.int64)
    return features, np.concatenate([[0], np.cumsum(size)]), np.repeat(at.astype(np.int64), size)


def labelled_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of all lines of a sample of labelled texts, a row a text, and their label (1: boilerplate).

    labels: doc_id, quality (1: good). A doc_id with both labels or none isn't learned from. About
    ``SAMPLE`` texts of each label are picked by a hash of the doc_id.
    """
    told = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("of_id"))
    told = told.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").select("of_id", (1 - F.col("low")).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, SAMPLE / n))).otherwise(share)
    part = F.pmod(F.xxhash64("of_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # About 2 * SAMPLE identifiers at any size: they go to the texts, so that no other text moves.
    told = F.broadcast(told.where(part < share))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts_of(batch.column(0))
        out = []
        for _, _, piece, at in pieces(data, offsets):
            lines = lines_of(piece, at)
            out += [lines.features[a:b].tobytes() for a, b in zip(lines.bounds[:-1], lines.bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["features", "label"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).join(told, F.col("doc_id") == F.col("of_id"))
    return arrow_pass(rows.select("text", "label"), "features binary, label int", work)


def _summed(lines: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """``likelihood`` over all rows: whole numbers of ``1 / UNIT``, added up by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1)
        for batch in batches:
            value, gradient = likelihood(*_packed(batch.columns), weights)
            total += np.append(gradient, value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1, dtype=np.int32)), pa.array(np.rint(total * UNIT).astype(np.int64))], ["at", "part"])

    rows = lines.mapInArrow(work, "at int, part bigint").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(SIZE + 1)
    for r in rows:
        out[r["at"]] = r["part"] / UNIT
    return float(out[-1]), out[:-1]


def maximised(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], rounds: int = ROUNDS, memory: int = 8) -> np.ndarray:
    """Weights with the largest value, by a limited-memory quasi-Newton method with step halving."""
    at = np.zeros(SIZE)
    value, slope = value_and_gradient(at)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, kept = slope.copy(), []
        for step, change in reversed(steps):
            share = step @ direction / (step @ change)
            direction -= share * change
            kept.append(share)
        if steps:
            direction *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1])
        else:
            direction /= max(1.0, np.abs(direction).max())
        for (step, change), share in zip(steps, reversed(kept)):
            direction += step * (share - change @ direction / (step @ change))
        length, gain = 1.0, slope @ direction
        while True:
            here = at + length * direction
            new_value, new_slope = value_and_gradient(here)
            if new_value >= value + 1e-4 * length * gain or length < 1e-6:
                break
            length /= 2
        step, change = here - at, slope - new_slope
        if step @ change > 1e-12:
            steps = [*steps, (step, change)][-memory:]
        done = abs(new_value - value) <= 1e-7 * (1 + abs(value))
        at, value, slope = here, new_value, new_slope
        if done:
            break
    return at


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weights that make the labels of ``labelled_lines`` likeliest, less ``RIDGE`` times their squares a text; all 0 without a label."""
    rows = stored(labelled_lines(docs, labels))
    n = rows.count()
    if not n:
        return np.zeros(SIZE)
    # The sample is small: as many tasks as it needs.
    few = rows.coalesce(max(1, n // 2500))

    def of(weights: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = _summed(few, weights)
        return value / n - RIDGE * float(weights @ weights), gradient / n - 2 * RIDGE * weights

    return maximised(of)


def judged(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """What ``quality_rules`` returns, for given weights."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts_of(batch.column(1))
        base, content, total = [], [], []
        for _, _, piece, at in pieces(data, offsets):
            lines = lines_of(piece, at)
            label = decoded(lines.features, lines.bounds, weights)
            held = np.concatenate([[0], np.cumsum(np.where(label == 0, lines.words, 0))])
            base.append(lines.base)
            content.append(held[lines.bounds[1:]] - held[lines.bounds[:-1]])
            total.append(np.diff(lines.bounds))
        base, content, total = np.concatenate(base), np.concatenate(content), np.concatenate(total)
        words = base[:, 0]
        share = content / np.maximum(words, 1)
        failed = (words < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * words)
        kept = ~failed & (share >= LEAST_CONTENT)
        columns = [batch.column(0), *(pa.array(c) for c in base.T.astype(np.int64)), pa.array(failed), pa.array(kept), pa.array(total), pa.array(share)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_share"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return arrow_pass(rows, f"doc_id bigint, {BASE}, base_failed boolean, kept boolean, n_lines bigint, content_share double", work)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept, n_lines, content_share.

    Words are runs without white space. n_dup_lines: lines with a word that are equal to an earlier line
    of the text; n_repeat_words: words in windows of ``WINDOW`` words that occur twice or more in the
    text, the first one included. base_failed: fewer than ``LEAST_WORDS`` words, or over ``MOST_REPEATED``
    percent of them repeated. kept: not base_failed, and lines that the field marks as content hold
    ``LEAST_CONTENT`` of the words or more. A missing or empty text has no line and fails. Without
    labels all weights are 0 and every line is content. Rows that repeat are judged alike. Other columns are not
    read. No rows in, no rows out.
    """
    return judged(docs, fitted(docs, labels))
