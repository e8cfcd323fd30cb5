"""The six operational views, from a database, a catalogue or a Parquet folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import domain
from caseflow.functions.dates import as_date, wall_clock, within


def jdbc_options(
    url: str,
    view: str,
    schema: str | None = domain.VIEW_SCHEMA,
    *,
    split_on: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    **more: str,
) -> dict[str, str]:
    """Options for a database scan.

    A scan without ``split_on`` is a single task, so a large view needs it, with its bounds. Rows
    outside the bounds are still read, by the first and last task. Zone-less database times stay
    zone-less.
    """
    options = {
        "url": url,
        "dbtable": f"{schema}.{view}" if schema else view,
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
        **more,
    }
    if split_on is not None:
        if bounds is None or partitions is None:
            raise ValueError("split_on needs bounds and partitions")
        options |= {
            "partitionColumn": split_on,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_view_jdbc(spark: SparkSession, url: str, view: str, **settings) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, view, **settings)).load()


def jdbc_catalogue(name: str, url: str, driver: str | None = None, **more: str) -> dict[str, str]:
    """Session settings under which a database is the catalogue ``name``.

    Its schemas are namespaces: ``available_views(spark, f"{name}.{domain.VIEW_SCHEMA}")`` lists them
    and ``read_view_table(spark, view, f"{name}.{domain.VIEW_SCHEMA}")`` reads one, and the database
    applies filters, counts, sums, limits and samples itself. ``more`` has further options of the
    reader, user and password among them.
    """
    at = f"spark.sql.catalog.{name}"
    pushed = ("pushDownPredicate", "pushDownAggregate", "pushDownLimit", "pushDownOffset", "pushDownTableSample")
    settings = {"url": url, **{p: "true" for p in pushed}, "preferTimestampNTZ": "true", **more}
    if driver:
        settings["driver"] = driver
    source = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
    return {at: source, **{f"{at}.{k}": v for k, v in settings.items()}}


def quantile_query(
    view: str, split_on: str, partitions: int, schema: str | None = domain.VIEW_SCHEMA
) -> str:
    """A question to the database, as a table: the least key of each of ``partitions`` equal shares of the rows."""
    table = f"{schema}.{view}" if schema else view
    shares = f"SELECT {split_on} AS k, NTILE({partitions}) OVER (ORDER BY {split_on}) AS share FROM {table} WHERE {split_on} IS NOT NULL"
    return f"(SELECT share, MIN(k) AS low FROM ({shares}) s GROUP BY share) q"


def split_predicates(split_on: str, lows: Sequence[object]) -> list[str]:
    """Conditions that deal every row to one task, cut at the least keys of equal shares.

    Even bounds leave most rows to few tasks where keys are dense in one place; these follow the rows.
    Equal cuts are one, so a key of very many rows stays whole. Rows without a key go to the first.
    """
    cuts = sorted({low for low in lows if low is not None})[1:]

    def shown(value: object) -> str:
        return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"

    if not cuts:
        return ["1 = 1"]
    first = f"{split_on} < {shown(cuts[0])} OR {split_on} IS NULL"
    inner = [f"{split_on} >= {shown(a)} AND {split_on} < {shown(b)}" for a, b in zip(cuts, cuts[1:])]
    return [first, *inner, f"{split_on} >= {shown(cuts[-1])}"]


def read_view_shares(
    spark: SparkSession, url: str, view: str, split_on: str, partitions: int, **settings
) -> DataFrame:
    """A database view in tasks of about equal size: the database is asked for the cuts first."""
    options = jdbc_options(url, view, **settings)
    table = options.pop("dbtable")
    question = quantile_query(table, split_on, partitions, None)
    cuts = spark.read.format("jdbc").options(**options, dbtable=question).load().select("low").collect()
    predicates = split_predicates(split_on, [r["low"] for r in cuts])
    return spark.read.jdbc(options.pop("url"), table, predicates=predicates, properties=options)


def read_view_parquet(spark: SparkSession, folder: str, view: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{view}")


def read_view_table(spark: SparkSession, view: str, database: str | None = None) -> DataFrame:
    return spark.table(f"{database}.{view}" if database else view)


def available_views(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Which of the known views a namespace holds: a database, or a schema of a catalogue such as
    ``jdbc_catalogue`` sets up. Views that the session registered for itself are in no namespace;
    without one the current database and they are listed together. Names are matched without regard
    to case, as most catalogues keep them in lower case."""
    tables = spark.sql(f"SHOW TABLES IN {database}" if database else "SHOW TABLES")
    if database:
        tables = tables.filter(~F.col("isTemporary"))
    known = [v.lower() for v in domain.VIEWS]
    return tables.filter(F.lower("tableName").isin(*known)).select(F.col("tableName").alias("view"))


def select_cases(view: DataFrame) -> DataFrame:
    """The fifteen columns the engine uses of the case view, under engine names."""
    return view.select(*[F.col(s).alias(n) for n, (s, _) in domain.CASE_COLUMNS.items()])


def select_facilities(view: DataFrame) -> DataFrame:
    return view.select(*[F.col(s).alias(n) for n, (s, _) in domain.FACILITY_COLUMNS.items()])


def _comparable(raw: DataFrame, name: str) -> Column:
    """A typed date column stays bare, so that the source can filter on it; text is parsed."""
    is_text = isinstance(raw.schema[name].dataType, T.StringType)
    return wall_clock(raw, name) if is_text else F.col(name)


def issued_between(raw: DataFrame, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """Cases by notice date, filtered at the source."""
    return raw.filter(within(_comparable(raw, "nov_date"), as_date(first), as_date(last)))


def touched_between(raw: DataFrame, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """Cases executed, noticed or terminated in the range, filtered at the source."""
    executed, noticed, terminated = (
        within(_comparable(raw, c), as_date(first), as_date(last))
        for c in ("executed_date", "nov_date", "term_date")
    )
    return raw.filter(executed | noticed | terminated)
