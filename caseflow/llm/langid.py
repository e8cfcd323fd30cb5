"""Language identification: a text as a mixture of languages, by expectation-maximisation over byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.bytescan import _lookup, counts
from caseflow.llm.common import arrow_pass, fixed_binary, pieces, remainder_of_id, summed_lines, text_of, texts_of

#: Trigrams are told apart by this many bits of a hash: a language's model has ``2 ** CELL_BITS`` counts.
CELL_BITS = 16
CELLS = 1 << CELL_BITS
SLICES = 64
SMOOTHING = 0.1
ROUNDS = 30
TOLERANCE = 1e-3
#: A language with a smaller share of a text isn't tried as a member of its set.
LEAST_SHARE = 0.02
#: How many of a log-likelihood's halves of ln(n) each further language costs; 1 is the Bayesian criterion.
PENALTY = 1.0
UNKNOWN = "und"

_LETTER = _lookup(lambda b: b >= 0x80 or chr(b).isalpha())
_FOLD = np.fromiter(((b + 32 if 0x41 <= b <= 0x5A else b) if _LETTER[b] else 0x20 for b in range(256)), np.uint8, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of each text: document, cell, count.

    Small letters; whatever is no letter is one blank; a text begins and ends with a blank.
    """
    n = len(offsets) - 1
    folded = _FOLD[data]
    if len(data) > 1:  # capitals with an accent, of two bytes
        after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        folded[after] += 0x20
    blank = folded == 0x20
    keep = np.ones(len(data), bool)
    if len(data) > 1:
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[offsets[(offsets > 0) & (offsets < len(data))]] = True
    held = counts(keep, offsets)
    doc = np.repeat(np.arange(n), held)
    body = folded[keep]
    joined = np.full(len(body) + n + 1, 0x20, np.uint32)
    at = np.arange(len(body)) + doc + 1
    joined[at] = body
    code = (joined[at - 1] << 16) | (joined[at] << 8) | joined[at + 1]
    cell = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELL_BITS)
    keys = (doc.astype(np.uint64) << np.uint64(CELL_BITS)) | cell
    keys.sort()
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(keys)))
    one = keys[fresh]
    return (one >> np.uint64(CELL_BITS)).astype(np.int64), (one & np.uint64(CELLS - 1)).astype(np.int64), times


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and ln p(cell | language), from rows of text and lang (NULL ones are left out).

    Every partition counts on its own and sends one array a language, in slices; slices are summed in two levels, as a
    stream, so neither a language of most documents nor the number of partitions makes a large group. The driver gets the counts alone:
    ``2 ** CELL_BITS`` numbers a language.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, where = np.unique(np.asarray(batch.column(1).to_pylist(), object), return_inverse=True)
            data, offsets = texts_of(batch.column(0))
            for first, last, part, at in pieces(data, offsets):
                doc, cell, times = trigrams(part, at)
                of = where[first:last][doc]
                for i in np.unique(where[first:last]):
                    mine = of == i
                    total.setdefault(langs[i], np.zeros(CELLS))
                    total[langs[i]] += np.bincount(cell[mine], times[mine], CELLS)
        for lang, sums in total.items():
            lines = fixed_binary(sums.reshape(SLICES, -1))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * SLICES), pa.array(range(SLICES), pa.int32()), lines], ["lang", "slice", "line"])

    schema = "lang string, slice int, line binary"
    taught = docs.select("text", "lang").where(F.col("lang").isNotNull())
    rows = summed_lines(taught.mapInArrow(counted, schema), np.float64, "lang", "slice").collect()
    langs = sorted({r["lang"] for r in rows})
    table = np.zeros((len(langs), SLICES, CELLS // SLICES))
    for r in rows:
        table[langs.index(r["lang"]), r["slice"]] = np.frombuffer(r["line"])
    table = table.reshape(len(langs), CELLS) + SMOOTHING
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def proportions(doc: np.ndarray, logp: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Each text's language shares that fit its trigrams best (expectation-maximisation), float64[n, languages].

    ``logp`` has a row for every distinct trigram of a text; rows are in order of ``doc``. Texts that
    have settled leave the rounds.
    """
    langs = logp.shape[1]
    share = np.full((n, langs), 1.0 / langs)
    if len(doc) == 0 or langs == 1:
        return share
    # Only ratios within a trigram matter.
    p = np.exp(logp - logp.max(axis=1, keepdims=True)).astype(np.float32)
    weight = times.astype(np.float32)
    for _ in range(ROUNDS):
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        live = doc[starts]
        total = np.add.reduceat(weight, starts).astype(np.float64)
        r = p * share[doc].astype(np.float32)
        r *= (weight / np.maximum(r.sum(axis=1), np.float32(1e-30)))[:, None]
        new = np.add.reduceat(r, starts, axis=0) / total[:, None]
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-30)
        moving = np.abs(new - share[live]).max(axis=1) > TOLERANCE
        share[live] = new
        if not moving.any():
            break
        if moving.mean() < 0.7:
            stay = np.repeat(moving, np.diff(np.append(starts, len(doc))))
            doc, p, weight = doc[stay], p[stay], weight[stay]
    return share


def chosen(doc: np.ndarray, logp: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every text its main language, that language's share, and the size of its language set.

    Sets of the one best, the two and more largest shares are compared by log-likelihood less
    ``PENALTY`` * ln(trigrams) / 2 for each further language.
    """
    langs = logp.shape[1]
    share = proportions(doc, logp, times, n)
    total = np.bincount(doc, times, n)
    single = np.stack([np.bincount(doc, logp[:, j] * times, n) for j in range(langs)], axis=1)
    best = single.argmax(axis=1)
    value = single.max(axis=1)
    main, part, size = best.copy(), np.ones(n), np.ones(n, np.int64)
    order = np.argsort(-share, axis=1, kind="stable")
    top = logp.max(axis=1)
    p = np.exp(logp - top[:, None])
    for k in range(2, langs + 1):
        tried = share[np.arange(n), order[:, k - 1]] >= LEAST_SHARE
        if not tried.any():
            break
        mine = tried[doc]
        if not mine.any():
            break
        cut = share.copy()
        np.put_along_axis(cut, order[:, k:], 0.0, axis=1)
        cut /= cut.sum(axis=1, keepdims=True)
        d = doc[mine]
        ll = np.log(np.maximum((p[mine] * cut[d]).sum(axis=1), 1e-30)) + top[mine]
        fit = np.bincount(d, ll * times[mine], n) - PENALTY * (k - 1) * np.log(np.maximum(total, 2)) / 2
        better = tried & (fit > value)
        value[better] = fit[better]
        main[better] = order[better, 0]
        part[better] = cut[better, order[better, 0]]
        size[better] = k
    return main, part, size


def identified(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and n_langs for rows of doc_id and text; ``und`` with score 0 where no letter is."""
    table = np.ascontiguousarray(model.T)  # one line a cell

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts_of(batch.column(1))
        lettered = np.asarray(batch.column(2))
        n = batch.num_rows
        pred, score, size = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, np.int64)
        for first, last, part, at in pieces(data, offsets, 1 << 19):
            if not langs:
                break
            doc, cell, times = trigrams(part, at)
            main, share, members = chosen(doc, table[cell], times, last - first)
            some = lettered[first:last]
            pred[first:last][some] = np.asarray(langs, object)[main[some]]
            score[first:last][some] = share[some]
            size[first:last][some] = members[some]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(size)], ["doc_id", "lang_pred", "score", "n_langs"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"), text_of().rlike(r"\p{L}").alias("lettered"))
    return arrow_pass(rows, "doc_id bigint, lang_pred string, score double, n_langs bigint", work)


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, n_langs.

    Learns from documents with a lang whose crc32(doc_id as text) mod 3 is not 1; a missing doc_id
    neither teaches nor is held out. The prediction depends on the text alone: the language with the
    largest share in the set of languages chosen by penalised likelihood; the score is that share.
    ``und`` with score 0 if the text is missing or has no letter, or if nothing could be learned.
    Ties go to the language that comes first by name. Other columns are not read.
    """
    left = remainder_of_id(3)
    langs, model = learn(docs.select(text_of().alias("text"), F.col("lang").cast("string"), left.alias("left")).where("left <> 1"))
    out = identified(docs, langs, model)
    return out.select("doc_id", F.coalesce(left == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_langs")
