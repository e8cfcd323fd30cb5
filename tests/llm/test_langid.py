import zlib

import numpy as np
import pyarrow as pa

from caseflow.llm import langid
from caseflow.llm.common import texts_of


def test_trigrams_like_plain_python():
    texts = ["", "Ab, cd", "  x--y ", "ÉLAN élan", "12"]
    doc, cell, times = langid.trigrams(*texts_of(pa.array(texts)))
    for i, t in enumerate(texts):
        raw = "".join(c if c.isalpha() else " " for c in t.lower()).encode()
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        full, expected = b" " + raw + b" ", {}
        for k in range(1, len(full) - 1):
            code = full[k - 1] << 16 | full[k] << 8 | full[k + 1]
            c = (code * 0x9E3779B1 % (1 << 32)) >> 16
            expected[c] = expected.get(c, 0) + 1
        assert dict(zip(cell[doc == i].tolist(), times[doc == i].tolist())) == expected


def test_shares_are_the_best_mixture():
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(300), size=2).astype(np.float32)).T
    times = rng.multinomial(4000, 0.7 * np.exp(logp[:, 0]) / np.exp(logp[:, 0]).sum() + 0.3 * np.exp(logp[:, 1]) / np.exp(logp[:, 1]).sum())
    some = np.flatnonzero(times)
    share = langid.proportions(np.zeros(len(some), int), logp[some], times[some], 1)[0]
    grid = np.linspace(0.01, 0.99, 99)
    ll = [(times * np.log(a * np.exp(logp[:, 0]) + (1 - a) * np.exp(logp[:, 1]))).sum() for a in grid]
    assert abs(share[0] - grid[int(np.argmax(ll))]) < 0.02
    main, part, size = langid.chosen(np.zeros(len(some), int), logp[some], times[some], 1)
    assert (main[0], size[0]) == (0, 2) and abs(part[0] - 0.7) < 0.05


def test_sets_of_languages_by_trying_all_sizes():
    """Of the sets of the largest shares, the one with the best penalised likelihood."""
    rng = np.random.default_rng(8)
    logp = np.log(rng.dirichlet(np.full(400, 0.3), size=4).astype(np.float64) + 1e-6).T
    for mix in ([1, 0, 0, 0], [0.5, 0.3, 0.2, 0], [0.4, 0.3, 0.2, 0.1], [0, 0.9, 0.1, 0]):
        times = rng.multinomial(3000, sum(m * np.exp(logp[:, j]) for j, m in enumerate(mix)) / sum(m * np.exp(logp[:, j]).sum() for j, m in enumerate(mix)))
        some = np.flatnonzero(times)
        p, t = np.exp(logp[some]), times[some]
        # Shares by plain expectation-maximisation, one trigram after the other.
        share = np.full(4, 0.25)
        for _ in range(400):
            new = np.zeros(4)
            for row, n in zip(p, t):
                new += n * row * share / (row @ share)
            share = new / t.sum()
        order = sorted(range(4), key=lambda j: -share[j])
        scores = {1: max((t * np.log(p[:, j])).sum() for j in range(4))}
        for k in (2, 3, 4):
            if share[order[k - 1]] >= langid.LEAST_SHARE:
                cut = np.array([share[j] if j in order[:k] else 0 for j in range(4)])
                scores[k] = (t * np.log(p @ (cut / cut.sum()))).sum() - langid.PENALTY * (k - 1) * np.log(t.sum()) / 2
        best = max(scores, key=lambda k: (scores[k], -k))
        main, part, size = langid.chosen(np.zeros(len(some), int), logp[some].astype(np.float32), t, 1)
        assert size[0] == best == sum(m > 0 for m in mix)
        assert main[0] == (order[0] if best > 1 else int(np.argmax((t[:, None] * np.log(p)).sum(axis=0))))
        assert abs(part[0] - (share[order[0]] / share[order[:best]].sum() if best > 1 else 1)) < 0.02


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_two_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model = langid.learn(docs.select("text", "lang"))
    some = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}' and doc_id > 500").limit(20).collect()) for lang in ("de", "fr")}
    both = some["de"][:6000] + " " + some["fr"][:3000]
    row = langid.identified(spark.createDataFrame([(1, both)], "doc_id bigint, text string"), langs, model).head()
    assert row.lang_pred == "de" and row.n_langs == 2 and 0.5 < row.score < 0.85


def test_odd_rows(odd, none):
    rows = langid.languages(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id): r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 10, 11))
    assert by[9].lang_pred != "und" and by[4].lang_pred != "und"
    assert langid.languages(none).count() == 0
    unknown = langid.languages(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
