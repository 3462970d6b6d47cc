"""Attaching single-row aggregates (totals, thresholds, KPIs) to other DataFrames.

A one-row aggregate is attached as a scalar subquery: Spark computes it once and
inlines the value, so there is no join at all (no nested-loop or cartesian
product, no shuffle of the receiving side).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDE_MONEY = "decimal(38,6)"


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add every column of the single-row ``one_row`` to each row of ``df``."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*[F.col(c) for c in cols]).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, *[F.col("_s")[c].alias(c) for c in cols])


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """``first`` (any number of rows) with the columns of the one-row ``others`` added."""
    return reduce(attach, others, first)


def aggregated(lines: DataFrame, keys: list[Column], aggregates: list[Column], distinct: list[Column]) -> DataFrame:
    """``lines.groupBy(*keys).agg(*aggregates, *distinct)`` for several counts of distinct values.

    In one aggregate several such counts would expand every line once a count, all summed columns
    with it.  Here each further count is a pass over its own two columns, joined by the (null-safe) keys."""
    out = lines.groupBy(*keys).agg(*aggregates, distinct[0])
    names = lines.select(*keys).columns
    for count in distinct[1:]:
        own = lines.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(count)
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_key{i}")) for i, n in enumerate(names)])
        out = out.join(own, same).drop(*[f"_key{i}" for i in range(len(names))])
    return out


def sort_key(largest: str, then: list[str] | None = None) -> Column:
    """An ascending key of the order: the largest ``largest`` first, then ``then`` ascending, nulls last
    (NaN after all numbers)."""
    return F.struct(F.col(largest).isNull().alias("n"), (-F.col(largest)).alias("v"), *[
        part for i, c in enumerate(then or []) for part in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])


def in_ranges(df: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``_key`` and ``_range``, the number of its range of keys: ranges follow the keys' order.

    The borders are the keys that hash least, one a shuffle partition: an even sample that depends on
    the keys alone, so each reading of a plan finds the same ranges and nothing has to be kept between
    two of them.  They reach the rows as a scalar subquery; a row finds its range by halving."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = df.select(key.alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(ranges - 1)
    borders = sample.agg(F.array_sort(F.collect_list("_key")).alias("_b")).scalar()
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(ranges.bit_length()))])
    # read once and before the key is a column, the borders stay the subquery's own array in most plans, without a copy a row
    places = F.transform(F.array("_borders"), lambda b: F.aggregate(halves, F.lit(0), lambda at, step: F.when(
        F.get(b, at + step - 1) <= key, at + step).otherwise(at)))
    return df.withColumn("_borders", borders).withColumn("_range", F.get(places, F.lit(0))).drop("_borders").withColumn("_key", key)


def ranked(df: DataFrame, largest: str, then: list[str] | None = None, rank: str = "rank",
           running: dict[str, Column] | None = None, ties: bool = False) -> DataFrame:
    """``df`` with its position in the order of ``sort_key``, and running sums, without a single-task window.

    Each range of keys is numbered and summed on its own and the counts and sums of the ranges
    before it, one row a range, are added; no job runs before the result is asked for.  ``running``:
    new column -> money to sum up to and including the row.  ``ties``: rows equal in ``largest`` share
    the least position (``then`` and ``running`` are not used); positions are those of the distinct values, counted before
    the shuffle, so that a value of very many rows is no task of its own."""
    if ties:
        return with_places(df, df, largest, rank)
    sums = {rank: F.lit(1).cast("long")} | {k: v.cast(WIDE_MONEY) for k, v in (running or {}).items()}
    out = _running(df, sort_key(largest, then), sums)
    return out.select(*df.columns, rank, *[F.col(k).cast("double").alias(k) for k in running or {}])


def with_places(df: DataFrame, population: DataFrame, largest: str, rank: str) -> DataFrame:
    """``df`` with the least position of its value of ``largest`` in ``population``, the largest first, nulls last."""
    values = population.groupBy(F.col(largest).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    placed = _running(values, sort_key("_value"), {"_upto": F.col("_rows").cast("long")}).select(
        "_value", (F.col("_upto") - F.col("_rows") + 1).alias(rank))
    return df.join(placed, F.col(largest).eqNullSafe(F.col("_value"))).select(*df.columns, rank)


def _running(df: DataFrame, key: Column, sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the rows up to and including its own, in order of ``key``."""
    rows = in_ranges(df, key)
    whole = rows.groupBy("_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    offsets = whole.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    upto = W.partitionBy("_range").orderBy("_key").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(offsets, "_range").withColumns(
        {k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(upto), F.lit(0)) for k, v in sums.items()}).drop(
        "_range", "_key", *[f"_{k}" for k in sums])


def order_statistics(df: DataFrame, largest: str, positions: dict[str, Column]) -> DataFrame:
    """One row: the value of ``largest`` at each of ``positions`` (new column -> place from 1, in terms of the
    row count ``n``) from the largest down, nulls last; NULL where there is no such row.

    The rows of each value are counted before the shuffle; whole ranges of values are passed by their
    counts and only the values of the ranges that hold a wanted place are numbered."""
    values = df.groupBy(F.col(largest).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    rows = in_ranges(values, sort_key("_value"))
    whole = rows.groupBy("_range").agg(F.sum("_rows").alias("_in"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    whole = whole.withColumns({"_before": F.coalesce(F.sum("_in").over(before), F.lit(0)), "n": F.sum("_in").over(W.partitionBy())})
    wanted = whole.withColumn("_at", F.array(*[p.cast("long") for p in positions.values()])).where(F.exists(
        "_at", lambda p: (p > F.col("_before")) & (p <= F.col("_before") + F.col("_in"))))
    inside = W.partitionBy("_range").orderBy("_key")
    found = rows.join(wanted, "_range").withColumn(
        "_last", F.col("_before") + F.sum("_rows").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return found.agg(*[F.max(F.when((F.get("_at", F.lit(i)) <= F.col("_last")) & (F.get("_at", F.lit(i)) > F.col("_last") - F.col("_rows")),
                                    F.col("_value"))).alias(name) for i, name in enumerate(positions)])
