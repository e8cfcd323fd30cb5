import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from caseflow.llm import crf
from caseflow.llm.common import texts_of


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def test_base_counts(documents, labels, odd, none):
    for docs in (documents, odd):
        rows = Counter((r.doc_id, *base(r.text)) for r in docs.select("doc_id", "text").collect())
        got = crf.quality_rules(docs, labels).collect()
        assert Counter(tuple(r)[:7] for r in got) == rows
        assert all(not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.content_share >= 0.5) for r in got)
    assert crf.quality_rules(none, labels).count() == 0


def _score(features, labels, weights):
    """The score of one label sequence by the definition."""
    k = len(crf.FEATURES)
    own, pair = weights[:k], weights[k : k + 4].reshape(2, 2)
    out = sum(float(features[i] @ own) for i, y in enumerate(labels) if y)
    out += sum(pair[a, b] for a, b in zip(labels, labels[1:]))
    return out + (weights[k + 4] if labels[0] else 0.0) + (weights[k + 5] if labels[-1] else 0.0)


def _some(rng):
    size = np.array([3, 0, 7, 1, 5, 2])
    bounds = np.concatenate([[0], np.cumsum(size)])
    return rng.uniform(size=(size.sum(), len(crf.FEATURES))).astype(np.float32), bounds, rng.normal(size=crf.SIZE) * 2


def test_viterbi_and_likelihood_by_trying_all_sequences():
    rng = np.random.default_rng(2)
    for _ in range(20):
        features, bounds, weights = _some(rng)
        got = crf.decoded(features, bounds, weights)
        labels = rng.integers(0, 2, len(features))
        value = 0.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            scores = {y: _score(features[a:b], y, weights) for y in itertools.product((0, 1), repeat=int(b - a))}
            assert tuple(got[a:b]) == max(scores, key=scores.get)
            value += scores[tuple(labels[a:b])] - np.logaddexp.reduce(list(scores.values()))
        told, gradient = crf.likelihood(features, bounds, labels, weights)
        assert abs(told - value) < 1e-6
        for k in range(crf.SIZE):
            apart = np.zeros(crf.SIZE)
            apart[k] = 1e-5
            up, down = (crf.likelihood(features, bounds, labels, weights + s * apart)[0] for s in (1, -1))
            assert abs((up - down) / 2e-5 - gradient[k]) < 1e-4


def test_features_by_plain_rules():
    text = "The Sun rose, over it.\n\n# 12 $$ ab\nThe Sun rose, over it.\nÉté à l'eau"
    lines = crf.lines_of(*texts_of(pa.array(["", text, "one"], pa.large_string())))
    assert lines.bounds.tolist() == [0, 0, 4, 5] and lines.words.tolist() == [5, 4, 5, 3, 1]
    column = lambda name: lines.features[:, crf.FEATURES.index(name)].astype(float).round(4).tolist()
    assert column("capital words") == [0.4, 0, 0.4, 0, 0]
    assert column("ends a sentence") == [1, 0, 1, 0, 0]
    assert column("line occurred before") == [0, 0, 1, 0, 0]
    assert column("words in repeated windows") == [1, 0, 1, 0, 0]
    assert column("first line") == [1, 0, 0, 0, 1] and column("last line") == [0, 0, 0, 1, 1]
    assert column("digits")[1] == round(2 / 7, 4) and column("symbols")[1] == round(3 / 7, 4)


def test_learned_verdict_on_texts_not_learned_from(spark):
    """Held-out accuracy on sf0.01: learned from one half of the labelled texts, judged on the other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = crf.judged(docs, crf.fitted(docs, labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = got.select("quality", "kept", "base_failed", "n_words").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_weights_do_not_follow_the_order_of_adding(documents, labels):
    one = crf.fitted(documents.coalesce(1), labels)
    other = crf.fitted(documents.repartition(7), labels)
    assert np.abs(one - other).max() < 1e-3


def test_no_label_leaves_the_base_rules(documents, labels):
    got = crf.quality_rules(documents, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in got)
