import math
import re
from collections import Counter, defaultdict

import numpy as np

from caseflow.llm import search
from llm_texts import sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=search.TOP):
    """Every document against every item, by the formula."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if lost else d, -s) for k, (s, lost, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(docs, items, top=search.TOP):
    rows = [tuple(r) for r in search.ranked(docs, items, top).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_like_brute_force(spark, documents, odd, none, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    monkeypatch.setattr(search, "BLOCK", 8)
    assert found(documents, items) == brute(pairs(documents, "doc_id"), pairs(items, "item_id"))
    assert found(documents.repartition(7), items, 3) == brute(pairs(documents, "doc_id"), pairs(items, "item_id"), 3)
    some = [(1, "River bridges 42"), (1, "old STONE"), (2, None), (3, " !"), (4, "élan naïve 日本語 ÉLAN"), (None, "naïve"), (5, "nothing like it")]
    asked = spark.createDataFrame(some, "item_id bigint, text string")
    assert found(odd, asked) == brute(pairs(odd, "doc_id"), some)
    assert found(none, asked) == [] and found(odd, asked.limit(0)) == []


def test_blocks_of_queries_and_small_segments(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = found(documents, items)
    monkeypatch.setattr(search, "QUERY_TERMS", 300)
    assert found(documents, items) == plain


def test_a_segment_by_brute_force():
    """Skipped blocks hold nothing that belongs to the best, whatever the lists look like."""
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 1000, 5000):
        ids = rng.permutation(10 * n)[:n]
        lists = {}
        for k in range(30):
            places = np.sort(rng.choice(n, max(1, int(n * rng.uniform() ** 4)), replace=False))
            lists[f"t{k}"] = places, rng.integers(1, 50 if k % 3 else 3, len(places))
        queries = [(q, [(f"t{k}", int(rng.integers(0, 90))) for k in rng.choice(40, 9, replace=False)]) for q in range(40)]
        got = {q: (b.score.tolist(), b.doc.tolist()) for q, b in search._search_segment(ids, lists, queries, 20)}
        for q, wanted in queries:
            score = np.zeros(n, np.int64)
            for t, w in wanted:
                if t in lists:
                    np.add.at(score, lists[t][0], w * lists[t][1])
            best = [(s, d) for s, d in sorted(zip((-score).tolist(), ids.tolist())) if s < 0][:20]
            assert got.get(q, ([], [])) == ([-s for s, _ in best], [d for _, d in best])


def test_index_has_every_row_and_term(documents, odd):
    for docs in (documents, odd):
        rows = search.build_index(docs).collect()
        texts = [r["text"] for r in docs.select("text").collect()]
        assert sum(len(r.ids) for r in rows if r.term is None) == len(texts)
        got = Counter()
        for r in rows:
            if r.term is not None:
                assert r.places == sorted(set(r.places))
                got[r.term] += sum(r.counts)
        assert got == Counter(t for text in texts for t in terms(text))


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 40, sentence(3)) for i in range(80)] + [(99, sentence(8, 400))] * 3, "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame([(7, sentence(3, 6)), (8, sentence(3, 6))], "item_id bigint, text string")
    assert found(docs, items) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
