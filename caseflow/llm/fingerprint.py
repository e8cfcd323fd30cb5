"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

The fingerprint is a sum of vectors, one for each paragraph, lane by lane modulo powers of two, so
paragraphs may come in any order and be added or removed later. A paragraph's vector has two parts:

- 16 lanes modulo 2^64 from a cryptographic digest of the whole paragraph, which make fingerprints of
  unequal multisets differ;
- 128 lanes modulo 2^32 in which every three words in a row of the paragraph add plus or minus one
  to one lane. The squared length of a difference of such sums estimates how many word triples
  differ, which gives a likeness without the texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.bytescan import U
from caseflow.llm.common import partitions, pieces, text_of, texts_of

HASH_LANES = 16
SKETCH_LANES = 128
TRIPLE = 3


def fingerprints(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both parts for every text: uint64[n, HASH_LANES] and uint32[n, SKETCH_LANES]."""
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
    data, offsets = texts_of(column)
    wide = np.zeros((len(offsets) - 1, HASH_LANES), U)
    sketch = np.zeros((len(offsets) - 1, SKETCH_LANES), np.uint32)
    for first, last, part, at in pieces(data, offsets):
        wide[first:last], sketch[first:last] = _of_piece(part, at)
    return wide, sketch


def _lanes(paragraph: memoryview) -> bytes:
    """1,024 bits of two BLAKE2b digests: the lanes of a paragraph, none of which follows from another."""
    return b"".join(hashlib.blake2b(paragraph, person=half).digest() for half in (b"low", b"high"))


def _of_piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    # A paragraph is a line; blank lines count, an empty text has none.
    ends = np.flatnonzero(data == 0x0A)
    doc_of_end = np.searchsorted(offsets, ends, "right") - 1
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = np.concatenate([offsets[:-1][full], ends + 1])
    stops = np.concatenate([ends, offsets[1:][full]])
    owner = np.concatenate([full, doc_of_end])
    starts = starts[np.lexsort((starts, owner))]
    stops.sort()
    owner = np.sort(owner)
    raw = memoryview(np.ascontiguousarray(data))
    lanes = np.frombuffer(b"".join(_lanes(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist())), U).reshape(-1, HASH_LANES)
    total = np.zeros((len(lanes) + 1, HASH_LANES), U)
    np.cumsum(lanes, axis=0, out=total[1:])
    edge = np.searchsorted(owner, np.arange(n + 1))
    wide = total[edge[1:]] - total[edge[:-1]]
    begins, finishes, _ = bytescan.spans(data, offsets, bytescan.SOLID)
    words = bytescan.hash_spans(data, begins, finishes)
    bounds = np.searchsorted(begins, np.append(starts, len(data)))
    triple, paragraph, _ = bytescan.shingles(words, bounds, TRIPLE)
    lane = (triple >> U(57)).astype(np.int64) + owner[paragraph] * SKETCH_LANES
    sign = np.where(triple & U(1), 1.0, -1.0)
    sums = np.bincount(lane, sign, n * SKETCH_LANES).reshape(n, SKETCH_LANES)
    return wide, sums.astype(np.int64).astype(np.uint32)


def encoded(wide: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as text (base64 of both parts)."""
    raw = np.concatenate([wide.view(np.uint8).reshape(len(wide), -1), sketch.view(np.uint8).reshape(len(sketch), -1)], axis=1)
    return [base64.b64encode(x.tobytes()).decode() for x in raw]


def decoded(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(map(base64.b64decode, prints)), np.uint8).reshape(len(prints), -1)
    cut = HASH_LANES * 8
    return np.ascontiguousarray(raw[:, :cut]).view(U), np.ascontiguousarray(raw[:, cut:]).view(np.uint32)


def added(print_a: str, print_b: str) -> str:
    """The fingerprint of both multisets together: insertion."""
    (a, s), (b, t) = decoded([print_a]), decoded([print_b])
    return encoded(a + b, s + t)[0]


def removed(print_a: str, print_b: str) -> str:
    """The fingerprint without the paragraphs of the second one: deletion."""
    (a, s), (b, t) = decoded([print_a]), decoded([print_b])
    return encoded(a - b, s - t)[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How alike fingerprints are, 0 to 1, row by row: shared word triples over all, as estimated; 1 where equal."""
    length = lambda x: np.square(x.astype(np.int32).astype(np.float64)).sum(axis=1)
    left, right, apart = length(a[1]), length(b[1]), length(a[1] - b[1])
    shared = (left + right - apart) / 2
    union = left + right - shared
    out = np.clip(np.divide(shared, union, out=np.zeros(len(union)), where=union > 0), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, out)


SCHEMA = """doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,
 near_edited double, near_next double"""


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, in descending order, each part's follower (``guest`` 1) at its end."""
    block: list[tuple] = []
    held = None
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            part, guest, doc_id, text = row
            if held is not None and held[0] == part and not held[1]:
                half = len(held[3]) // 2
                block.append((held[2], held[3], held[3][: len(held[3]) - half] + text[:half], text))
                size += len(held[3]) + len(text)
            held = row
            if size > 1 << 22:
                yield _finished(block)
                block, size = [], 0
    if block:
        yield _finished(block)


def _finished(block: list[tuple]) -> pa.RecordBatch:
    ids, texts, edits, nexts = zip(*block)
    # The next document's fingerprint is mostly that of the next row.
    whole = fingerprints(list(texts))
    edited = fingerprints(list(edits))
    place = [i + 1 if i + 1 < len(block) and nexts[i] is texts[i + 1] else -1 for i in range(len(block))]
    odd = [i for i, p in enumerate(place) if p < 0]
    for k, i in enumerate(odd):
        place[i] = len(block) + k
    extra = fingerprints([nexts[i] for i in odd])
    follow = tuple(np.concatenate([w, e])[place] for w, e in zip(whole, extra))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits]),
            pa.array(encoded(*whole)),
            pa.array(encoded(*edited)),
            pa.array(likeness(whole, edited)),
            pa.array(likeness(whole, follow)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``SCHEMA``), one row per row of ``docs``.

    The edited text has its last floor(n/2) code points replaced by as many first ones of the next
    document in descending order of doc_id, after the last of the first; missing identifiers come
    last, rows with one identifier by text. NULL counts as empty. One document alone is its own next.
    No rows in, no rows out. Other columns are not read.

    Documents are dealt into ranges of doc_id, cut at approximate quantiles; the first document of a
    range is also sent to the range before it. Only as many documents as there are ranges move twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    n = partitions(spark)
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) or []}, reverse=True)
    cut_list = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(cut_list, lambda c: F.col("doc_id") < c)), F.lit(0))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(part))
    # The largest identifier of each range: as many rows as ranges.
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    size = len(cuts) + 1
    top = F.array(*[F.lit(tops.get(p)).cast("bigint") for p in range(size)])
    host = F.array(*[F.lit(before.get(p, 0)) for p in range(size)])
    at = F.col("part") + 1
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    visit = F.struct(F.element_at(host, at).alias("part"), F.lit(1).alias("guest"))
    leads = F.col("doc_id").eqNullSafe(F.element_at(top, at))
    sent = rows.select("doc_id", "text", F.explode(F.when(leads, F.array(own, visit)).otherwise(F.array(own))).alias("to"))
    dealt = sent.select("to.part", "to.guest", "doc_id", "text").repartitionById(size, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_edited, SCHEMA)
