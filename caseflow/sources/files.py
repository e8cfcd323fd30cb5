"""CSV dimensions and the CSV case extract."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import domain
from caseflow.functions.dates import parsed_day
from caseflow.session import cut_lineage

# Quotes are doubled inside quoted fields; blanks around a value are not part of it.
_CSV = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}
_ORG_LABELS = {
    "region": "Region",
    "position": "Position",
    "position_number": "Position number",
    "capacity": "Capacity",
}
_REFERRAL_LABELS = {"region": "Region", "referral_rate": "Referral Rate"}


#: Where a record lies: its file, the block of the file that a task read, and its place among them.
PLACE = "file_place"
_RECORD = "_record"
_REJECTED = "array<struct<field string, text string, reason string>>"


@dataclass(frozen=True)
class Parsed:
    """What a CSV folder holds: good rows, and what could not be read as it should.

    ``rejects`` has a row for every value that is NULL in ``rows`` though its field has a text: file,
    record (counted from 1 in its file, without the header), field, text, reason. A record with too
    few or too many fields has one more row with its whole text and no field. Its values stay as far
    as they go.
    """

    rows: DataFrame
    rejects: DataFrame


def _text(label: str) -> Column:
    """A field by its header; an empty field and the text NA are missing values."""
    return F.nullif(F.col(f"`{label}`"), F.lit("NA"))


def _typed(text: Column, kind: T.DataType) -> Column:
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def _raw(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All fields as text, the whole record where their number is wrong, and the place of the record."""
    options = {**_CSV, "multiLine": str(multiline).lower()}
    names = spark.read.options(**options).csv(path).columns
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RECORD]])
    read = spark.read.options(**options, columnNameOfCorruptRecord=_RECORD, columnPruning="false")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    return read.schema(kinds).csv(path).withColumn(PLACE, place)


def _rejected(labels: dict[str, str], schema: T.StructType, days: Sequence[str]) -> Column:
    """The fields of a record that have a text and no value."""
    found = []
    for f in schema.fields:
        text = _text(labels[f.name])
        if f.name in days:
            bad, reason = parsed_day(text).isNull() & (F.trim(text) != ""), "no date"
        elif isinstance(f.dataType, T.StringType):
            continue
        else:
            bad, reason = _typed(text, f.dataType).isNull(), f"no {f.dataType.simpleString()}"
        one = F.struct(F.lit(labels[f.name]).alias("field"), text.alias("text"), F.lit(reason).alias("reason"))
        found.append(F.when(text.isNotNull() & bad, one))
    missing = F.lit(None).cast("string").alias("field")
    whole = F.struct(missing, F.col(_RECORD).alias("text"), F.lit("another number of fields").alias("reason"))
    found.append(F.when(F.col(_RECORD).isNotNull(), whole))
    return F.array_compact(F.array(*found)).cast(_REJECTED)


def _values(labels: dict[str, str], schema: T.StructType) -> list[Column]:
    return [_typed(_text(labels[f.name]), f.dataType).alias(f.name) for f in schema.fields]


def _read(
    spark: SparkSession,
    path: str,
    labels: dict[str, str],
    schema: T.StructType,
    multiline: bool,
    place: bool = False,
) -> DataFrame:
    if place:
        return _raw(spark, path, multiline).select(*_values(labels, schema), PLACE)
    table = spark.read.options(**_CSV, multiLine=str(multiline).lower()).csv(path)
    return table.select(*_values(labels, schema))


def _parse(
    spark: SparkSession,
    path: str,
    labels: dict[str, str],
    schema: T.StructType,
    multiline: bool,
    days: Sequence[str] = (),
) -> Parsed:
    """Rows and rejects of one reading, kept in the session's checkpoint folder; without one each is a reading of its own."""
    raw = _raw(spark, path, multiline)
    held = cut_lineage(raw.select(*_values(labels, schema), PLACE, _rejected(labels, schema, days).alias("rejected")))
    # Records before a block, from one row a block; only rejects are numbered.
    blocks = held.groupBy(f"{PLACE}.file", f"{PLACE}.block").agg(
        F.min(f"{PLACE}.at").alias("low"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    told = held.select(f"{PLACE}.*", F.explode("rejected").alias("one")).join(blocks, ["file", "block"])
    record = F.col("before") + F.col("at") - F.col("low") + 1
    return Parsed(held.drop(PLACE, "rejected"), told.select("file", record.alias("record"), "one.*"))


def read_org_chart(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _ORG_LABELS, domain.ORG_CHART_SCHEMA, False)


def parse_org_chart(spark: SparkSession, path: str) -> Parsed:
    return _parse(spark, path, _ORG_LABELS, domain.ORG_CHART_SCHEMA, False)


def read_referral_rates(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _REFERRAL_LABELS, domain.REFERRAL_RATES_SCHEMA, False)


def parse_referral_rates(spark: SparkSession, path: str) -> Parsed:
    return _parse(spark, path, _REFERRAL_LABELS, domain.REFERRAL_RATES_SCHEMA, False)


def _extract_schema() -> T.StructType:
    fields = [f for f in domain.RAW_CASES_SCHEMA.fields if f.name != "facility_id"]
    return T.StructType([T.StructField("facility_name", T.StringType()), *fields])


def read_case_extract(
    spark: SparkSession, path: str, *, multiline: bool, place: bool = False
) -> DataFrame:
    """Cases from an extract with display headers and month/day/year text; the facility name is
    already in it. ``multiline`` says whether comments hold line breaks: if they do, every file is
    one task; if not, large files are split.

    ``place`` adds ``PLACE``, which orders records as they stand: files by path, then from top to
    bottom, however the files are split. ``rows.first_row_per`` takes it as order, and
    ``prepare.prepare_extract`` keeps it if told to."""
    return _read(spark, path, dict(domain.DISPLAY_LABELS), _extract_schema(), multiline, place)


def parse_case_extract(spark: SparkSession, path: str, *, multiline: bool) -> Parsed:
    """The same with its rejects, texts that are no date among them (those stay in the rows as they are)."""
    labels = dict(domain.DISPLAY_LABELS)
    return _parse(spark, path, labels, _extract_schema(), multiline, domain.DATE_COLUMNS)
