"""Token counts by greedy longest match in linear time: a vocabulary trie with failure links and popped-token counts.

A word is a blank and a run of anything but white space, as bytes; its pieces are the longest
vocabulary entries from the left. Following the trie, a byte that no child takes is handled by the
failure link: the tokens that are certain by then are popped, and matching goes on in the node that
the rest of the bytes leads to. Only the number of popped tokens is kept, so no piece is ever built.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import bytescan
from caseflow.llm.common import arrow_pass, pieces, text_of, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str = VOCABULARY) -> tuple[bytes, ...]:
    """The entries of a vocabulary file (base64 and rank a line), as bytes; read on the driver."""
    with open(path, "rb") as lines:
        return tuple(base64.b64decode(line.split()[0]) for line in lines if line.strip())


class Automaton:
    """The trie of a vocabulary, its failure links, and all transitions as one table.

    ``pops[v]`` is the number of tokens that the failure link of node v pops. The table has, for each
    node and class of bytes, the next node and the tokens popped on the way; bytes that the vocabulary
    never puts beside another share a class. A byte that is no entry counts as a token of its own.
    """

    def __init__(self, vocabulary: tuple[bytes, ...]):
        children: list[dict[int, int]] = [{}]
        token = [False]
        depth = [0]
        for entry in sorted({bytes([b]) for b in range(256)} | {e for e in vocabulary if e}):
            at = 0
            for b in entry:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    token.append(False)
                    depth.append(depth[at] + 1)
                at = children[at][b]
            token[at] = True
        n = len(children)
        fail, pops = [0] * n, [0] * n
        order, k = [0], 0
        while k < len(order):
            u = order[k]
            k += 1
            for b, v in children[u].items():
                order.append(v)
                if token[v]:
                    pops[v] = 1
                else:
                    z, popped = fail[u], pops[u]
                    while b not in children[z]:
                        popped += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = children[z][b], popped
        inner = sorted({b for entry in vocabulary if len(entry) > 1 for b in entry})
        self.byte_class = np.full(256, len(inner), np.int64)
        self.byte_class[inner] = np.arange(len(inner))
        lonely = sorted(set(range(256)) - set(inner))
        self.classes = len(inner) + 1
        # All lonely bytes lead to nodes alike: a token without children.
        fill = children[0][lonely[0]] if lonely else 0
        if n >= 1 << 24:
            raise ValueError(f"a vocabulary with {n} nodes: the table holds 24 bits of them")
        table = np.zeros((n, self.classes), np.uint32)
        table[0, :-1] = [children[0][b] << 8 for b in inner]
        table[0, -1] = fill << 8
        flush = np.zeros(n, np.int64)
        fail_at, pops_at, depth_at = np.array(fail), np.array(pops, np.uint32), np.array(depth)
        steps = np.zeros(n, np.int64)
        for level in range(1, int(depth_at.max()) + 1):
            nodes = np.flatnonzero(depth_at == level)
            table[nodes] = table[fail_at[nodes]] + pops_at[nodes, None]
            flush[nodes] = flush[fail_at[nodes]] + pops_at[nodes]
            # The most that one step from here can pop.
            steps[nodes] = steps[fail_at[nodes]] + pops_at[nodes]
            if steps[nodes].max(initial=0) > 255:
                raise ValueError("a vocabulary in which one byte ends more than 255 tokens: the table holds 8 bits of them")
            own = [(v, self.byte_class[b], c << 8) for v in nodes.tolist() for b, c in children[v].items()]
            if own:
                v, b, c = np.array(own).T
                table[v, b] = c
        self.table, self.flush = table.ravel(), flush

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of every word ``data[start:end]`` with a blank before it, all words a byte at a time."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at = starts[order]
        live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        first = int(self.table[self.byte_class[0x20]])
        state = np.full(len(at), first >> 8, np.int64)
        total = np.full(len(at), first & 255, np.int64)
        for k, n in enumerate(live):
            step = self.table[state[:n] * self.classes + self.byte_class[data[at[:n] + k]]]
            state[:n] = step >> 8
            total[:n] += step & 255
        total += self.flush[state]
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


@functools.lru_cache(maxsize=2)
def automaton(vocabulary: tuple[bytes, ...]) -> Automaton:
    return Automaton(vocabulary)


def count_tokens(column: pa.Array, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of every text."""
    data, offsets = texts_of(column)
    words, tokens = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for first, last, part, at in pieces(data, offsets):
        starts, ends, bounds = bytescan.spans(part, at, bytescan.SOLID)
        total = np.concatenate([[0], np.cumsum(machine.lengths(part, starts, ends))])
        words[first:last] = np.diff(bounds)
        tokens[first:last] = total[bounds[1:]] - total[bounds[:-1]]
    return words, tokens


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens of the whole text.

    Missing, empty and blank texts have none. White space only ends words; bytes are matched as they
    are. The vocabulary (some hundred kB) travels with the task; a Python worker builds the table once.
    Other columns are not read. No rows in, no rows out.
    """
    vocabulary = read_vocabulary(path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, tokens = count_tokens(batch.column(1), automaton(vocabulary))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return arrow_pass(docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")), "doc_id bigint, n_words bigint, n_tokens bigint", work)
