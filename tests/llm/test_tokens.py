import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import tokens


def greedy(text, vocabulary):
    """Longest entry from the left, word by word, building every piece."""
    longest = max(map(len, vocabulary), default=1)
    n = words = 0
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        words += 1
        left = b" " + word
        while left:
            size = next((k for k in range(min(longest, len(left)), 1, -1) if left[:k] in vocabulary), 1)
            left = left[size:]
            n += 1
    return words, n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=6), max_size=12), st.lists(st.text("abcé \n", max_size=25), min_size=1, max_size=5))
def test_small_vocabularies_like_greedy(entries, texts):
    vocabulary = {e.encode() for e in entries if " " not in e[1:]}
    words, n = tokens.count_tokens(pa.array(texts), tokens.Automaton(tuple(sorted(vocabulary))))
    assert list(zip(words.tolist(), n.tolist())) == [greedy(t, vocabulary) for t in texts]


def test_documents_like_greedy(documents, odd, none):
    vocabulary = set(tokens.read_vocabulary())
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        expected = sorted(((d, *greedy(t, vocabulary)) for d, t in rows), key=str)
        assert sorted(map(tuple, tokens.token_counts(docs).collect()), key=str) == expected
    assert tokens.token_counts(none).count() == 0
