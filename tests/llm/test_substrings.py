import re

from caseflow.llm import substrings
from llm_texts import balanced, sentence


def units(text):
    """(start, end, normalised) of every unit, by plain rules on the characters."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out = []
    for i, (s, e) in enumerate(words):
        capital = lambda k: bool(re.match("[A-ZÀ-Þ]", text[words[k][0]]))
        fresh = i == 0 or "\n" in text[words[i - 1][1] : s] or text[words[i - 1][1] - 1] in ".!?" or (capital(i) and not capital(i - 1))
        if fresh:
            out.append([])
        out[-1].append((s, e))
    small = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    return [(u[0][0], u[-1][1], tuple(small(text[s:e]) for s, e in u)) for u in out]


def brute(rows):
    texts = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, spans = set(), {}
    firsts = {}
    for key in texts:
        for k, (_, _, u) in enumerate(units(key[2])):
            firsts.setdefault(u, (key, k))
    for key in texts:
        runs, last = [], None
        for k, (s, e, u) in enumerate(units(key[2])):
            if firsts[u] != (key, k):
                if last is None or k != last + 1:
                    runs.append([s, e, 0, 0])
                runs[-1][1] = e
                runs[-1][2] += len(u)
                runs[-1][3] += len(u) if len(u) >= substrings.LEAST_UNIT else 0
                last = k
        spans[key] = [tuple(r[:3]) for r in runs if r[2] >= substrings.LEAST_RUN and r[3] >= substrings.LEAST_SOLID or r[2] >= substrings.LONG_RUN]
    return {(d, tuple(spans[(d is None, d or 0, t or "")]), len(t or "")) for d, t in rows}


def test_like_brute_force(documents, odd, none):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = substrings.substring_duplicates(docs).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, tuple(map(tuple, r.removed)), r.n_chars) for r in got} == brute(rows)
        runs = substrings.removed_runs(docs).collect()
        assert {(r.doc_id, r.start, r.end, r.words) for r in runs} == {(r.doc_id, *x) for r in got for x in r.removed}
        assert all(r.kept_doc_id <= r.doc_id for r in runs)
    assert substrings.substring_duplicates(none).count() == 0


def test_passage_inside_other_lines_goes_once(spark):
    passage = ". ".join(sentence(k, 12).capitalize() for k in range(5)) + "."
    rows = [(i, f"{sentence(10 + i, 30)} {passage} {sentence(30 + i, 30)}") for i in range(6)] + [(90, sentence(77, 80))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = substrings.substring_duplicates(docs)
    found = {r.doc_id: r for r in got.collect()}
    assert found[0].removed == [] and found[90].removed == []
    for i in range(1, 6):
        assert len(found[i].removed) == 1 and found[i].removed_words == 60
        start, end, _ = found[i].removed[0]
        assert rows[i][1][start:end] == passage
    clean = docs.join(got.select("doc_id", "removed"), "doc_id").select("doc_id", substrings.without_spans("text", "removed").alias("t"))
    texts = {r.doc_id: r.t for r in clean.collect()}
    assert texts[3] == rows[3][1].replace(passage, "") and texts[0] == rows[0][1]


def brute_passages(rows, n):
    """Per document which words are in a passage that occurred before."""
    texts = sorted({(d is None, d or 0, t or "") for d, t in rows})
    small = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    first, out = {}, {}
    for key in texts:
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", key[2])]
        same = [small(key[2][s:e]) for s, e in words]
        gone = set()
        for i in range(len(words) - n + 1):
            kept, at = first.setdefault(tuple(same[i : i + n]), (key, i))
            if kept != key or i >= at + n:
                gone.update(range(i, i + n))
        out[key] = words, gone
    return out


def brute_units(rows):
    """Per document which words are in a unit of LEAST_UNIT words that occurred before."""
    seen, out = set(), {}
    for key in sorted({(d is None, d or 0, t or "") for d, t in rows}):
        at, out[key] = 0, set()
        for _, _, u in units(key[2]):
            if u in seen and len(u) >= substrings.LEAST_UNIT:
                out[key].update(range(at, at + len(u)))
            seen.add(u)
            at += len(u)
    return out


def test_passages_like_brute_force(documents, odd, none):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        later_units = brute_units(rows)
        plain, whole = brute(rows), brute_passages(rows, substrings.LONG_RUN)
        expected = set()
        for d, spans, _ in plain:
            for t in {t or "" for e, t in rows if e == d}:
                words, gone = whole[(d is None, d or 0, t)]
                if (d, spans, len(t)) not in plain:
                    continue
                gone = gone | later_units[(d is None, d or 0, t)] | {k for k, (s, e) in enumerate(words) for a, b, _ in spans if a <= s and e <= b}
                runs = []
                for k in sorted(gone):
                    if runs and runs[-1][1] == k - 1:
                        runs[-1][1] = k
                    else:
                        runs.append([k, k])
                expected |= {(d, words[a][0], words[b][1], b - a + 1) for a, b in runs}
        got = substrings.removed_spans(docs).collect()
        assert {(r.doc_id, r.start, r.end, r.words) for r in got} == expected
        assert len(got) == len(expected)
    assert substrings.removed_spans(none).count() == 0


def test_passage_set_mid_line_goes(spark):
    word = lambda k, i: "".join(chr(97 + (k * 7919 + i * 104729) // 26**j % 26) for j in range(5))
    passage = " ".join(word(1, i) for i in range(60))
    rows = [(i, " ".join(word(1000 + i, j) for j in range(30)) + f" {passage} " + " ".join(word(2000 + i, j) for j in range(30))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in substrings.removed_spans(docs).collect()}
    assert sorted(got) == [1, 2, 3]
    assert all(rows[i][1][got[i].start : got[i].end] == passage and got[i].kept_doc_id == 0 for i in got)
    twice = spark.createDataFrame([(1, f"{passage} then {passage}")], "doc_id bigint, text string")
    assert [(r.start, r.words) for r in substrings.removed_spans(twice).collect()] == [(len(passage) + 6, 60)]


def test_line_that_recurs_alone_goes(spark):
    line = "released under the very same seven words"
    rows = [(i, f"{sentence(50 + i, 12)}\n{line}\nback {i}\nto top") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substrings.removed_spans(docs).collect()
    assert sorted((r.doc_id, rows[r.doc_id][1][r.start : r.end], r.units, r.kept_doc_id) for r in got) == [(i, line, 1, 0) for i in range(1, 5)]


def test_letters_that_balance_are_no_copy(spark):
    one, other = "".join(balanced("a", "b")), "".join(balanced("b", "a"))
    rows = [(1, f"see {one} now and then again"), (2, f"see {other} now and then again"), (3, " ".join(balanced("a", "b"))), (4, " ".join(balanced("b", "a")))]
    got = substrings.removed_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    words = {d: t.split(" ") for d, t in rows}
    expected = brute_passages(rows, substrings.LONG_RUN)
    assert not [r for r in got if r.doc_id in (1, 2)]
    gone = {(r.doc_id, k) for r in got for k in range(len(words[r.doc_id])) if r.start <= sum(map(len, words[r.doc_id][:k])) + k < r.end}
    assert gone == {(d, k) for (_, d, _), (_, ks) in expected.items() if d > 2 for k in ks}


def test_every_keeper_is_named(spark):
    word = lambda k, i: "".join(chr(97 + (k * 7919 + i * 104729) // 26**j % 26) for j in range(5))
    parts = [" ".join(word(k, i) for i in range(60)) for k in (1, 2, 3)]
    rows = [(1, parts[0]), (2, parts[1]), (3, f"{parts[0]} {parts[1]}"), (None, parts[2]), (None, f"{parts[2]} {parts[0]}")]
    got = {(r.doc_id, r.words): r for r in substrings.removed_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[3, 120].kept_doc_ids == [1, 2] and got[3, 120].kept_doc_id == 1
    assert [r.kept_doc_ids for (d, _), r in got.items() if d is None] in ([[1, None]], [[1], [None]])


def test_rows_that_repeat_are_one(spark):
    docs = spark.createDataFrame([(7, sentence(1, 80))] * 40 + [(8, sentence(1, 80))] * 30, "doc_id bigint, text string").repartition(6)
    got = substrings.removed_spans(docs).collect()
    assert {(r.doc_id, r.words, r.kept_doc_id) for r in got if r.doc_id == 8} == {(8, 80, 7)} and len([r for r in got if r.doc_id == 8]) == 1
