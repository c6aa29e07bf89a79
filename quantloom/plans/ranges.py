"""Places and totals within groups that are too large for one task.

Rows are dealt by ranges of (group, order), so a group takes as many partitions as it needs. A table of one row
per group and range, with counts and sums, says what lies before each range; a row's place is that and its place
within the range. No window sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.session import written

PLACE, COUNT, RANGE = "_place", "_count", "_range"


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """The rows with ``_place`` (from 1, within ``by`` in the given order), ``_count`` of the group, and the
    ``_range`` they are in. ``sums`` gives for a name and a column of numbers the sum of that column from the
    row on to the group's end, and ``<name>_all`` of the whole group.

    The order should tell all rows of a group apart; of rows that it does not, places are arbitrary."""
    sums = sums or {}
    n = partitions or _shuffle_partitions(df)
    # The written table fixes the ranges: they are made from a sample, which another run may draw anew.
    dealt = written(df.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn(RANGE, F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*by, RANGE).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()])
    group, along = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(RANGE)
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    offsets = parts.select(
        *by, RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias(COUNT),
        *[F.coalesce(F.sum(f"_s_{name}").over(after), F.lit(0.0)).alias(f"_after_{name}") for name in sums], *[F.sum(f"_s_{name}").over(group).alias(f"{name}_all") for name in sums],
    )
    rows = joined(dealt, offsets, [*by, RANGE])
    inside = Window.partitionBy(*by, RANGE).orderBy(*order)
    rows = rows.withColumn(PLACE, F.row_number().over(inside) + F.col("_before"))
    # from the end on: a frame that reaches to the end would be summed anew for every row
    back = Window.partitionBy(*by, RANGE).orderBy(F.desc(PLACE)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({name: F.sum(c).over(back) + F.col(f"_after_{name}") for name, c in sums.items()}) if sums else rows
    return rows.drop("_before", *[f"_after_{name}" for name in sums])


def joined(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows with what ``small`` has for their key; null keys match null keys. Whether it is broadcast is for
    Spark to say from its size; else both sides are dealt by the whole key, of which the range is a part."""
    named = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(named, match).drop(*[f"_on_{c}" for c in on])


def with_totals(df: DataFrame, by: list[str], aggregates: dict[str, Column], salt: str, partitions: int | None = None) -> DataFrame:
    """The rows with aggregates of their group, which partial aggregation makes. A group's rows are dealt over
    salts by the column ``salt`` to get them, and the aggregates are copied to each."""
    n = partitions or _shuffle_partitions(df)
    totals = df.groupBy(*by).agg(*[c.alias(name) for name, c in aggregates.items()]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int"))
    return joined(salted, totals, [*by, "_salt"]).drop("_salt")


def first_of_each(df: DataFrame, by: list[str], order: list[Column], n: int, salt: str, partitions: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group: the first of each salt, which Spark cuts before the shuffle, and of
    those, at most ``n`` a salt, the first by place."""
    salts = partitions or _shuffle_partitions(df)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    heads = salted.withColumn("_head", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_head") <= n)
    return placed(heads.drop("_salt", "_head"), by, order, partitions=partitions).where(F.col(PLACE) <= n).drop(PLACE, COUNT, RANGE)
