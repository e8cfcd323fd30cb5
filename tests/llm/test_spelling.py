import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import spelling


def brute_vocabulary(rows):
    counted = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    return {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b, by trying all cuts."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_vocabulary(rows)
    near = {w: [] for w in words}
    for w in words:
        for v in words:
            if abs(len(w) - len(v)) <= 1 and one_apart(w, v):
                near[w].append(v)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_like_brute_force(documents, odd, none):
    some = documents.withColumn("text", F.substring("text", 1, 900))
    for docs in (some, odd):
        got = [tuple(r) for r in spelling.spelling_variants(docs).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows_of(docs))
    assert spelling.spelling_variants(none).count() == 0


def test_vocabulary_of_whole_texts(documents):
    got = {r.word: r.n for r in spelling.vocabulary(documents.repartition(6)).collect()}
    assert got == brute_vocabulary(rows_of(documents))


def crowd(seed, letters, n, longest):
    """Random words over few letters, so that many are one edit apart."""
    rng = np.random.default_rng(seed)
    return {"".join(rng.choice(letters, rng.integers(5, longest))) for _ in range(n)}


@pytest.mark.parametrize("letters, longest", [(["a", "b"], 9), (["a", "b", "é", "ÿ"], 7), (["x"], 90)])
def test_pairs_of_a_crowd(spark, letters, longest):
    words = crowd(3, letters, 400, longest)
    if "x" in letters:  # repeated bigrams in long words, and a long one with other letters
        words |= {"x" * 5000, "x" * 5001, "x" * 2500 + "y" + "x" * 2500, "x" * 64 + "y", "y" + "x" * 63}
    df = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n bigint").repartition(4)
    got = [tuple(r) for r in spelling.near_words(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and one_apart(a, b)}


def test_pivots_are_the_rarest_two_apart():
    rng = np.random.default_rng(1)
    rank = rng.permutation(spelling.LETTERS**2)
    words = sorted(crowd(9, list("abcdeé"), 200, 14))
    code, at = spelling._letters(pa.array(words))
    doc, place, pivot, last = spelling.chosen(code, at, rank)
    number = lambda c: ord(c) - 97 if c <= "z" else ord(c) - 0xC0 + 26
    for k, w in enumerate(words):
        ranks = [rank[number(a) * spelling.LETTERS + number(b)] for a, b in zip(w, w[1:])]
        end = sorted(ranks)[2]
        inside = [i for i, r in enumerate(ranks) if r <= end]
        assert last[k] == end and place[doc == k].tolist() == inside
        best = min(ranks[i] + ranks[j] for i in inside for j in inside if j >= i + 2)
        i, j = place[(doc == k) & pivot]
        assert j >= i + 2 and ranks[i] + ranks[j] == best


def test_crc_and_chains(spark):
    data = np.frombuffer("élan vital".encode(), np.uint8)
    got = spelling.crc32_of(np.array([zlib.crc32(b"7:"), zlib.crc32(b"")], np.uint32), data, np.array([0, 6]), np.array([5, 11]))
    assert got.tolist() == [zlib.crc32("7:élan".encode()), zlib.crc32(b"vital")]
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(links).collect()} == {(f"w{i}", "w40") for i in range(40)}
