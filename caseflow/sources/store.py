"""The prepared case table on disk, pulls that meet by case number, and CSV export of case detail."""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import domain
from caseflow.sources.named_csv import NamedCsv


def write_cases(cases: DataFrame, path: str) -> None:
    """Store a pull. Only the partitions of its own pull dates are replaced.

    Rows are sorted inside each task, so that a reader asking for one region or status skips the
    pages and row groups of the others.
    """
    (
        cases.sortWithinPartitions("pull_date", "facility_region", "status_code")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("pull_date")
        .parquet(path)
    )


def read_all_pulls(spark: SparkSession, path: str) -> DataFrame:
    """Stored cases of every pull, in engine column order. The plans count what they are given: use
    ``pulls.by_pull`` for figures per pull."""
    return spark.read.parquet(path).select(*domain.CASES_COLUMNS)


def read_cases(spark: SparkSession, path: str, pull_date: dt.date | str | None = None) -> DataFrame:
    """Stored cases of one pull, the newest if none is named; only its partition is read.

    The newest date is a subquery over the partition values: no column of the other pulls is read.
    """
    cases = read_all_pulls(spark, path)
    if pull_date is None:
        newest = spark.read.parquet(path).agg(F.max("pull_date")).scalar()
        return cases.filter(F.col("pull_date") == newest)
    return cases.filter(F.col("pull_date") == F.lit(pull_date).cast("date"))


KEY = "ea_number"


def _columns(cases: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema.fields)


def _pull_folder(path: str, buckets: int, pull_date: dt.date | str) -> str:
    return f"{path.rstrip('/')}/{KEY}-{buckets}/{pull_date}"


@contextlib.contextmanager
def _own_name(spark: SparkSession) -> Iterator[str]:
    """A table name for one statement; what it named stays on disk, and the catalogue as it was."""
    name = f"pull_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_pull(cases: DataFrame, path: str, pull_date: dt.date | str, buckets: int = 64) -> None:
    """Store one pull dealt out by case number: ``buckets`` files, each sorted by it.

    Pulls of one number of buckets meet by case number without a shuffle (``recon.reconcile_stored``),
    so choose it once, for the largest pull to come, at some 128 MB a file. Only this pull is
    replaced. Cases without a number share a bucket; of prepared cases there are none.
    """
    dealt = cases.filter(F.col("pull_date") == F.lit(pull_date).cast("date")).repartition(buckets, KEY)
    with _own_name(cases.sparkSession) as name:
        writer = dealt.write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY).mode("overwrite")
        writer.option("path", _pull_folder(path, buckets, pull_date)).saveAsTable(name)


def read_pull(spark: SparkSession, path: str, pull_date: dt.date | str, buckets: int = 64) -> DataFrame:
    """A pull that ``write_pull`` stored, with its dealing known to Spark. The number of buckets is
    part of where it lies: another one finds nothing instead of wrong matches."""
    folder = _pull_folder(path, buckets, pull_date)
    columns = _columns(spark.read.parquet(folder).select(*domain.CASES_COLUMNS))
    with _own_name(spark) as name:
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
        return spark.table(name)


def write_csv(rows: DataFrame, path: str, name: str) -> None:
    """Header CSV below ``path`` in files that bear the text of the column ``name``: see ``named_csv``.

    Rows are evened out by that column first: small groups end in one file each, a large one in
    several with numbers, never in one task. Values are put into lines by Spark itself.
    """
    values = [c for c in rows.columns if c != name]
    texts = [F.col(f"`{c}`").cast("string").alias(c) if k in ("date",) else F.col(f"`{c}`") for c, k in rows.dtypes if c != name]
    line = F.to_csv(F.struct(*texts), {"escape": '"'})
    header = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(values)]), {"escape": '"'})
    first = rows.sparkSession.range(1).select(header.alias("header")).first()["header"]
    lines = rows.select(F.col(f"`{name}`").alias("file"), line.alias("line")).hint("rebalance", "file")
    rows.sparkSession.dataSource.register(NamedCsv)
    lines.write.format(NamedCsv.name()).mode("append").options(path=path, header=first).save()
