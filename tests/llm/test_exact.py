import hashlib
import random
import re

from caseflow.llm.exact import CuckooIndex, exact_duplicates, keep_first


def brute(rows):
    """doc_id -> expected columns, by plain grouping."""
    groups = {}
    keyed = [(d, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for d, t in rows]
    for d, k in keyed:
        groups.setdefault(k, []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, least[k], len(groups[k]), k) for d, k in keyed), key=str), len(groups)


def test_index_inserts_deletes_and_grows():
    random.seed(1)
    index, model = CuckooIndex(8), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        key = random.choice(keys)
        if random.random() < 0.35:
            assert index.delete(key) == (model.pop(key, None) is not None)
        else:
            index.put(key, step)
            model[key] = step
    assert len(index) == len(model) and dict(index.items()) == model
    assert all(index.get(k) == model.get(k) for k in keys)


def test_false_hits_are_told_apart():
    # Equal mark and buckets, other keys: only the stored content differs.
    index = CuckooIndex(4)
    same = [b"\x01\x02" + b"\x00" * 8 + bytes([i]) * 22 for i in range(8)]
    for i, key in enumerate(same):
        index.put(key, i)
    assert [index.get(k) for k in same] == list(range(8))


def test_like_brute_force(documents, odd):
    for docs in (documents, odd):
        got = exact_duplicates(docs).collect()
        expected, groups = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
        assert sum(r.kept for r in got) == groups
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_that_stay_keep_their_columns(odd, none):
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "8", "9", "11", "None"])
    assert exact_duplicates(none).count() == 0 and keep_first(none).count() == 0
