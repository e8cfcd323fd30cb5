import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from caseflow.llm import quality
from caseflow.llm.common import FAN, summed_lines


def test_statistics_of_a_batch_as_of_each_text():
    texts = ["", "a", "One two. Two!\nthree three three", "é 日本 ###", "SHOUT!! LOUD!!", "x " * 5000]
    every = quality.text_statistics(pa.array(texts))
    assert np.isfinite(every).all()
    for i, t in enumerate(texts):
        assert np.allclose(every[i], quality.text_statistics(pa.array([t]))[0])
    names = dict(zip(quality.STATISTICS, every[2]))
    assert names["distinct_words"] == 4 / 6 and names["top_word"] == 3 / 6 and np.isclose(names["log_lines"], np.log(3))


def test_isotonic_fit_never_falls():
    rng = np.random.default_rng(0)
    x = np.arange(200.0)
    y = np.clip(x / 200 + rng.normal(0, 0.2, 200), 0, 1)
    xs, ys = quality.isotonic(x, y, np.ones(200))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    # The pooled means are the best non-decreasing fit: no neighbouring pool may be split or merged at a gain.
    fit = np.interp(x, xs, ys)
    assert np.isclose(fit.mean(), y.mean(), atol=0.02) and ((fit - y) ** 2).mean() < ((y.mean() - y) ** 2).mean()


def test_isotonic_fit_by_minimax():
    """At each place the greatest over starts of the least over ends of the mean between: the same fit by another way."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 25):
        x, y, w = np.arange(float(n)), rng.normal(size=n).round(1), rng.integers(1, 6, n).astype(float)
        expected = [max(min((y[a : b + 1] @ w[a : b + 1]) / w[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.interp(x, *quality.isotonic(x, y, w)), expected)


def test_statistics_by_plain_rules():
    """Shares and means of whole texts, counted one character and word at a time."""
    texts = ["One two. Two!\nthree three three", "SHOUT it: 12 cats, ok", "a a a a b", "Éa b\nÉa b\n# #", "it ended..."]
    for t in texts:
        got = dict(zip(quality.STATISTICS, quality.text_statistics(pa.array([t]))[0]))
        words, lines, size = t.split(), t.split("\n"), len(t.encode())
        assert np.isclose(got["log_words"], np.log1p(len(words))) and np.isclose(got["log_lines"], np.log1p(len(lines)))
        assert np.isclose(got["digits"], sum(c.isdigit() for c in t) / size) and np.isclose(got["capitals"], sum("A" <= c <= "Z" for c in t) / size)
        assert np.isclose(got["distinct_words"], len({*words}) / len(words)) and np.isclose(got["top_word"], max(map(words.count, words)) / len(words))
        triples = [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        assert np.isclose(got["distinct_triples"], len({*triples}) / len(triples))
        assert np.isclose(got["word_length"], np.mean([len(w.encode()) for w in words]))


def test_sums_in_levels_over_many_partitions(spark):
    """2,000 partitions: no group of the first level has more than its share of them."""
    rows = spark.range(0, 2000, 1, 2000)

    def lines(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([np.full(5, i, np.int64).tobytes(), np.arange(5).tobytes()])], ["slice", "line"])

    partial = rows.mapInArrow(lines, "slice int, line binary")
    got = {r["slice"]: np.frombuffer(r["line"], np.int64).tolist() for r in summed_lines(partial, np.int64, "slice").collect()}
    assert got == {0: [sum(range(2000))] * 5, 1: [2000 * k for k in range(5)]}
    placed = partial.withColumn("place", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    assert placed.groupBy("slice", "place").count().agg(F.max("count")).first()[0] <= 2000 / FAN + 1


def test_partition_sums_give_the_one_solution(spark):
    rng = np.random.default_rng(5)
    stats = rng.normal(size=(400, len(quality.STATISTICS)))
    label = (stats[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(stats, label)], "stats array<double>, label int")
    model = quality.fit(rows.repartition(7))
    x = model.features(stats)
    gram = x.T @ x + quality.RIDGE * 400 * np.diag([*[1 / quality.FOURIER] * quality.FOURIER, 0])
    expected = np.linalg.lstsq(gram, x.T @ label, rcond=None)[0]
    assert np.allclose(model.raw(stats), x @ expected, atol=1e-6)
    assert ((model.score(stats) >= 0.5) == (label == 1)).mean() > 0.95


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.quality_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95


def test_odd_rows(spark, odd, none, labels):
    marks = spark.createDataFrame([(4, 1), (4, 1), (3, 0), (8, 0), (5, None), (None, 1), (11, 7)], "doc_id bigint, quality int")
    rows = quality.quality_scores(odd, marks).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(odd, marks.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
    kept = quality.keep_good(odd, marks)
    expected = {r.doc_id for r in rows if r.predicted}
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == expected
