import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from llm_texts import balanced

from caseflow.llm import near
from caseflow.llm.common import texts_of


def plain_words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def brute(rows):
    """Classes of doc_ids by all pairs that share a shingle."""
    words = {i: plain_words(t) for i, (_, t) in enumerate(rows)}
    df = collections.Counter(w for ws in words.values() for w in {*ws})
    idf = {w: math.log((1 + len(rows)) / (1 + max(n, len(rows) / near.RAREST))) + 1 for w, n in df.items()}
    sets = {}
    for i, ws in words.items():
        n = collections.Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else {}
        sets[i] = {s: c * sum(idf[w] for w in s) / len(s) for s, c in n.items()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for k in s:
            holders[k].append(i)
    for a, b in {p for v in holders.values() for p in itertools.combinations(v, 2)}:
        shared = sum(min(w, sets[b][k]) for k, w in sets[a].items() if k in sets[b])
        j = shared / (sum(sets[a].values()) + sum(sets[b].values()) - shared)
        if j >= 0.8:
            parent[find(a)] = find(b)
    named = {}
    for i, ws in words.items():
        name = tuple(ws) or re.sub(r"[\x20\x09-\x0D]+", "", rows[i][1] or "")
        parent[find(i)] = find(named.setdefault(name, i))
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, c)) for c in classes.values())


def classes_of(got):
    out = collections.defaultdict(list)
    for r in got:
        out[r.class_id].append(str(r.doc_id))
    return sorted(sorted(c) for c in out.values())


def test_samples_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.choice(1 << 48, 400, replace=False).astype(np.uint64))
    weight = rng.gamma(2, 2, 400).astype(np.float32)
    for part in (0.5, 0.8, 0.95):
        other = np.where(rng.random(400) < part, weight, weight * np.float32(0.05)).astype(np.float32)
        doc = np.repeat([0, 1], 400)
        agree, n = 0, 0
        for trial in range(12):
            turned = np.sort((keys * np.uint64(2 * trial + 3)) & np.uint64((1 << 48) - 1))
            s = near.samples(doc, np.concatenate([turned, turned]), np.concatenate([weight, other]), 2)
            agree += (s[0] == s[1]).sum()
            n += s.shape[1]
        expected = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
        assert abs(agree / n - expected) < 0.06


def test_like_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    expected = brute(rows)
    got = near.near_duplicates(documents).collect()
    assert classes_of(got) == expected
    assert sum(r.kept for r in got) == len(expected) and all(r.class_id == r.doc_id for r in got if r.kept)


@pytest.mark.parametrize("edits", [3, 40])
def test_edited_copies(spark, edits):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(4000)]
    rows = []
    for group in range(3):
        base = rng.choice(4000, 400)
        for copy in range(60):
            text = base.copy()
            text[rng.choice(400, edits if copy else 0, replace=False)] = rng.choice(4000, edits if copy else 0)
            rows.append((group * 1000 + copy, " ".join(vocabulary[i] for i in text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = classes_of(near.near_duplicates(docs).collect())
    assert len(found) == (3 if edits == 3 else 180)


def test_chains_are_one_class(spark):
    # Each text is alike to the next one alone.
    words = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(words[30 * k : 30 * k + 400])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert classes_of(near.near_duplicates(docs).collect()) == brute(rows)
    assert len(brute(rows)) == 1


def test_whole_sets_of_a_batch_as_of_each_text():
    texts = ["one two three four five six", "", "one", "One  TWO, three! four five six", "a b c d e " * 50]
    idf = near.Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0)
    doc, keys, weight, names = near.weighted_sets(*texts_of(pa.array(texts)), idf)
    for i, t in enumerate(texts):
        d, k, w, n = near.weighted_sets(*texts_of(pa.array([t])), idf)
        assert (keys[doc == i] == k).all() and np.allclose(weight[doc == i], w) and (names[i] == n[0]).all()
    assert (names[0] == names[3]).all()


def test_frequencies_are_exact(documents, monkeypatch):
    rows = [plain_words(r.text) for r in documents.select("text").collect()]
    df = collections.Counter(w for ws in rows for w in {*ws})
    for rarest in (4096, 20):
        monkeypatch.setattr(near, "RAREST", rarest)
        idf = near.word_idf(documents.repartition(5))
        names = {w: near._words(*texts_of(pa.array([w])))[0] for w in df}
        for w, n in df.items():
            assert np.isclose(idf.of(names[w])[0], math.log((1 + len(rows)) / (1 + max(n, len(rows) / rarest))) + 1, rtol=1e-5)
        assert len(idf.words) <= rarest * np.mean([len({*ws}) for ws in rows])


def test_texts_whose_letters_balance_are_no_copies(spark):
    """Sequences that sums of powers modulo 2^64 can't tell apart, as letters and as words."""
    one, other = balanced("a", "b"), balanced("b", "a")
    texts = ["".join(one), "".join(other), "see " + "".join(one) + " now", "see " + "".join(other) + " now", " ".join(one), " ".join(other)]
    texts += [" ".join(balanced("river", "stone")), " ".join(balanced("stone", "river"))]
    data, offsets = texts_of(pa.array(texts))
    idf = near.Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0)
    names = near.weighted_sets(data, offsets, idf)[3]
    assert len({tuple(n) for n in names.tolist()}) == len(texts)
    docs = spark.createDataFrame([*enumerate(texts[:4])], "doc_id bigint, text string")
    assert {r.class_size for r in near.near_duplicates(docs).collect()} == {1}


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = near.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    sizes = sorted(len(c) for c in brute(rows))
    assert sorted(collections.Counter((r.class_id, r.class_size) for r in got).values()) == sizes
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got) == len(sizes)
    assert near.near_duplicates(none).count() == 0 and near.keep_one(none).count() == 0
