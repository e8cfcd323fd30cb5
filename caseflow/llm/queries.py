"""The operators as registered queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import crf, exact, fingerprint, langid, mixture, near, packing, quality, search, spelling, substrings, templates, tokens
from caseflow.llm.common import reachable, table

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: work(table(reachable(spark), folder, "documents"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(reachable(spark), folder, "documents"), table(spark, folder, "labels"))


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return crf.quality_rules(table(reachable(spark), folder, "documents"), table(spark, folder, "labels"))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(table(reachable(spark), folder, "documents"), table(spark, folder, "benchmark"))


def _near(docs: DataFrame) -> DataFrame:
    return near.near_duplicates(docs).drop("text_key")


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": _on_documents(_near),
    "op2_document_fingerprints": _on_documents(fingerprint.with_edits),
    "op3_quality_classifier": _quality,
    "op4_best_fit_packing": _on_documents(packing.packed_documents),
    "op5_source_mixing": _on_documents(mixture.source_mix),
    "op6_line_dedup": _on_documents(templates.line_dedup),
    "op7_substring_dedup": _on_documents(substrings.removed_spans),
    "op8_exact_dedup": _on_documents(exact.exact_duplicates),
    "op9_language_id": _on_documents(langid.languages),
    "op10_token_counts": _on_documents(tokens.token_counts),
    "op11_line_rules": _rules,
    "op12_ranked_search": _ranked,
    "op13_spelling_variants": _on_documents(spelling.spelling_variants),
}

_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
    row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, text_sha256
FROM d JOIN g USING (text_sha256)""",
    "op5_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{mixture.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS top, sum(source_size) OVER () AS total,
    coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source) AS place
  FROM s WHERE source_size > 0),
c AS (SELECT min(place) AS free FROM o WHERE weight * ((total - given) / rest) < top),
t AS (SELECT source, source_size, CASE WHEN place < coalesce(free, 1000000000) THEN top
    ELSE weight * (SELECT (f.total - f.given) / f.rest FROM o f, c WHERE f.place = c.free) END AS target FROM o, c),
p AS (SELECT *, CAST(floor(target) AS BIGINT) AS words FROM t),
q AS (SELECT d.doc_id, d.size, coalesce(p.source_size, 0) AS source_size, coalesce(p.target, 0) AS target,
    p.words // p.source_size AS whole, p.words % p.source_size AS more,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d LEFT JOIN p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(coalesce(whole * size + least(size, greatest(more - before, 0)), 0) AS BIGINT) AS taken FROM q""",
    "op12_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
i AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM benchmark),
size AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(len(found)) AS BIGINT) AS words FROM d WHERE len(found) > 0),
asked AS (SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT item_id, unnest(found) AS term FROM i)),
held AS (SELECT row, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, unnest(found) AS term FROM d) GROUP BY 1, 2),
weight AS (SELECT term, CAST(floor(1000.0::DOUBLE * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, size GROUP BY term),
length AS (SELECT row, doc_id, 100 - 50 + ((50 * len(found) * documents) // words) AS m FROM d, size),
scored AS (SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN length USING (row) GROUP BY item_id, doc_id, row),
placed AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50""",
}
