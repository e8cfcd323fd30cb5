"""The pipeline against its stages in plain Python, and the registered queries."""

import collections

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from caseflow.llm import mixture, quality, queries, tokens
from test_exact import brute as exact_groups
from test_near import brute as near_classes
from test_packing import check as check_packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's table, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], FOLDER).write.parquet(f"{folder}/{name}")
        tables.append(spark.read.parquet(f"{folder}/{name}"))
    return tables


def rows(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]


def test_each_stage_like_plain_python(spark, steps):
    docs, good, exact, near, mix, packed = steps
    for table in (good, exact, near, mix):
        assert table.columns == docs.columns and table.dtypes == docs.dtypes
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    accepted = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    assert {d for d, _ in rows(good)} == accepted
    groups, _ = exact_groups(rows(good))
    assert {d for d, _ in rows(exact)} == {keep for _, keep, _, _ in groups}
    classes = near_classes(rows(exact))
    assert {d for d, _ in rows(near)} == {min(int(d) for d in c) for c in classes}
    copies = collections.Counter()
    for r in mixture.source_mix(near).collect():
        copies[r.doc_id] += (2 * r.taken + r.size) // (2 * r.size) if r.size else 0
    assert collections.Counter(d for d, _ in rows(mix)) == +copies
    lengths = collections.Counter()
    for r in tokens.token_counts(mix).collect():
        lengths[r.doc_id] += r.n_tokens
    check_packing(packed.collect(), lengths, (512, 1024, 2048, 4096, 8192))


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == steps[-1].columns
    assert sorted(map(tuple, got.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, steps[-1].select("doc_id", "piece", "length").collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "best_fit_packing" or out.columns == docs.columns
            assert out.count() > 0 or docs is none


def test_every_operator_is_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_like_sql(spark, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from compare import duck, duck_bag, spark_bag

    assert spark_bag(queries.QUERIES[name](spark, FOLDER)) == duck_bag(duck(FOLDER), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", queries.QUERIES)
def test_reruns_agree(spark, name):
    """The same rows whatever the partitioning of the session."""
    def bag():
        return collections.Counter(map(str, queries.QUERIES[name](spark, FOLDER).collect()))

    before, first = spark.conf.get("spark.sql.shuffle.partitions"), bag()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert bag() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
