"""Joins in which a missing key matches a missing key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"
# A right row has one copy per salt: only join types that never show an unmatched copy can use it.
_SALTABLE = ("inner", "left", "left_semi", "left_anti")


def lookup(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    salt: int = 1,
    missing_match: bool | None = None,
) -> DataFrame:
    """Join ``right`` on with ``left_key <=> right_key`` and drop the right key.

    No broadcast is forced: Spark broadcasts ``right`` when it knows it to be small, also at run
    time, and else sorts and merges, splitting skewed partitions. A null-safe key is shuffled as a
    pair, so a side that is dealt out by the bare key already moves again; ``missing_match=False``
    joins by plain equality and keeps it in place. It is for keys of which at least one side has no
    missing one; by default the schema decides.

    ``salt`` splits a hot key without run-time splitting: left rows are spread over ``salt`` copies
    of ``right`` by a hash of their other columns, which a re-run task repeats exactly and a shuffle
    on the key before does not undo. Rows that are equal in all columns share a copy.
    """
    if missing_match is None:
        missing_match = left.schema[left_key].nullable and right.schema[right_key].nullable
    left_column, right_column = F.col("l." + left_key), F.col("r." + right_key)
    condition = left_column.eqNullSafe(right_column) if missing_match else left_column == right_column
    if salt > 1:
        if how not in _SALTABLE:
            raise ValueError(f"a {how} join cannot be salted")
        others = [F.col(f"`{c}`") for c in left.columns if c != left_key] or [F.lit(0)]
        left = left.withColumn(_SALT, F.pmod(F.xxhash64(*others), F.lit(salt)))
        copies = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
        right = right.withColumn(_SALT, copies)
        condition = condition & (F.col("l." + _SALT) == F.col("r." + _SALT))
    whole = how not in ("left_semi", "left_anti")
    kept_right = [f"r.{c}" for c in right.columns if whole and c not in (right_key, _SALT)]
    joined = left.alias("l").join(right.alias("r"), condition, how)
    return joined.select("l.*", *kept_right).drop(_SALT)


def in_other(
    left: DataFrame, right: DataFrame, key: str, salt: int = 1, missing_match: bool = True
) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``.

    Keys are made distinct first, so repeats on the right cost nothing in the join. The null-safe
    join shuffles the bare keys once more; in return both sides come straight from a shuffle, and
    Spark can split a hot key on the left. ``missing_match=False`` saves that shuffle where no key is
    hot.
    """
    return lookup(left, right.select(key).distinct(), key, key, "left_semi", salt, missing_match)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: a lookup table with any would multiply rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
