"""Counting item pairs inside groups (baskets, customers) by stripes.

A group's items become sorted arrays, and of every item one row, its stripe, carries the items
after it.  Stripes are shuffled once by their first item and only then unfolded, so a pair
is made and counted in one stage and is never shuffled itself.

* Items below the support can't be in a pair that reaches it and go first (exact).
* A group of many items is cut into blocks of about ``BLOCK`` items by ranges of their numbers;
  every two blocks of it meet in a row of their own, so no row or task holds a whole group.  An item is sent
  to all meetings of its block at once, so that groups of any size are shuffled once.
* The stripes of an item in more than ``STRIPES`` groups are dealt by ranges of the second
  item's number, so a hot item is many tasks and each pair is still counted in one.  A stripe is cut to
  the items of each range that it has any of.
* Where a count alone decides (``pair_sums``), the second items of an item's stripes are sorted, and what is not
  repeated often enough goes before it is a row: a task holds its stripes, not its pairs.
* A few groups that hold very many items are looked up instead of unfolded (``pair_sums``).

The work that remains is that of looking at the other groups' pairs of supported items once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, STRIPES = 1024, 4096
_BUCKETS, _NUMBERS = 1 << 12, 1 << 32
_SHIFT = (1 << 31) + 1  # numbers (1 to 2**32) less this are ints


def numbered(items: DataFrame, key: str, name: str) -> DataFrame:
    """``items`` with a number below 2**32 for each row, from its (distinct) key: the hash bucket,
    then the place in it.  Lazy, the same on every run, and no task sees more than a bucket."""
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return items.withColumn("_bucket", bucket).withColumn(
        name, F.col("_bucket") * (_NUMBERS // _BUCKETS) + place).drop("_bucket")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[f"_{c}"])
    return on


class Pairs:
    """Counted pairs by number; ``named`` gives them their codes."""

    def __init__(self, counts: DataFrame, numbers: DataFrame):
        self.counts, self.numbers = counts, numbers

    def where(self, condition) -> Pairs:
        return Pairs(self.counts.where(condition), self.numbers)

    def named(self, a: str, b: str, swapped: dict[str, str] | None = None) -> DataFrame:
        """Pairs with the lesser code as ``a``; ``swapped``: pairs of columns that change places with the items."""
        one, two = (self.numbers.select(F.col("_id").alias(n), F.col("item_code").alias(f"_code{n}")) for n in ("_a", "_b"))
        found = self.counts.join(one, "_a").join(two, "_b")
        turned = F.col("_code_a") > F.col("_code_b")
        swapped = swapped or {}
        swapped = swapped | {v: k for k, v in swapped.items()}
        others = [F.when(turned, F.col(swapped[c])).otherwise(F.col(c)).alias(c) if c in swapped else F.col(c)
                  for c in self.counts.columns if c not in ("_a", "_b")]
        return found.select(F.least("_code_a", "_code_b").alias(a), F.greatest("_code_a", "_code_b").alias(b), *others)


def group_sizes(rows: DataFrame, group: list[str]) -> DataFrame:
    """How many of the rows each group has, as ``_n``."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))


def _kept(rows: DataFrame, group: list[str], min_support: int, carry: list[str], stripes: int,
          support: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of supported items as (group, _x: number, splits and carried columns), and the items' numbers."""
    # null items are counted as none and compared null-safely: a filter on them would reach the rows' own shuffle, which
    # then differs from that of the other readings and is made twice
    if support is None:
        support = rows.groupBy("item_code").agg(F.count("item_code").alias("_support"))
    numbers = numbered(support.where(F.col("_support") >= max(min_support, 1)), "item_code", "_id")
    return rows.join(numbers, rows["item_code"].eqNullSafe(numbers["item_code"])).select(
        *group, F.struct("_id", F.ceil(F.col("_support") / stripes).cast("int").alias("_splits"), *carry).alias("_x")), numbers


def _over(sizes: DataFrame, group: list[str], block: int) -> DataFrame:
    """Groups of more than ``block`` rows and how many they have."""
    return sizes.where(F.col("_n") > block).select(*[F.col(c).alias(f"_{c}") for c in group], "_n")


def _unfolded(kept: DataFrame, sizes: DataFrame, group: list[str], carry: list[str], block: int,
              relate: Callable[[Column, Column], Column] | None = None, least: int = 1) -> DataFrame:
    """A row for each pair in each group, made where the pair's stripes are: _a, _split, _b, the group and carried columns,
    or with ``relate`` its number as _related instead of the carried columns.  Pairs that share fewer than ``least``
    groups may be missing, and with that the group."""
    big = _over(sizes, group, block)
    blocks = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    kept = kept.join(big, _same(kept, big, group), "left").select(*group, "_x", blocks.alias("_blocks"))
    part = F.floor(F.col("_x._id") * F.col("_blocks") / _NUMBERS).cast("int")
    # an item goes to every meeting of its block, with itself and with each other one: one shuffle, whatever the size
    met = kept.withColumn("_block", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *group, F.least("_block", "_other").alias("_one"), F.greatest("_block", "_other").alias("_two"), "_block", "_x")
    of_block = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("_x"))))
    met = met.groupBy(*group, "_one", "_two").agg(of_block(F.col("_block") == F.col("_one")).alias("_xs"),
                                                  of_block(F.col("_block") != F.col("_one")).alias("_ys"))
    after = F.slice("_xs", F.col("_at") + 2, F.size("_xs"))
    later = met.select(*group, "_one", "_two", "_xs", "_ys", F.posexplode("_xs").alias("_at", "_x")).select(
        *group, "_x", F.when(F.col("_one") == F.col("_two"), after).otherwise(F.col("_ys")).alias("_later"))
    # the stripes of a hot item are cut by ranges of their items; a stripe goes to the ranges that it has items of
    range_of = lambda y: F.floor(y["_id"] * F.col("_x._splits") / _NUMBERS).cast("int")
    whole = F.col("_x._splits") == 1
    dealt = later.where(F.size("_later") > 0).withColumn("_split", F.explode(
        F.when(whole, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform("_later", range_of))))).withColumn(
        "_later", F.when(whole, F.col("_later")).otherwise(F.filter("_later", lambda y: range_of(y) == F.col("_split"))))
    # what is shuffled are flat columns and arrays of numbers; four times the usual partitions, which are not merged by
    # their bytes, as a stripe unfolds to many times its size
    if relate:
        own, others = [], {"_related": F.transform("_later", lambda y: relate(F.col("_x"), y).cast("byte"))}
    else:
        own, others = [F.col(f"_x.{c}").alias(f"a_{c}") for c in carry], {f"b_{c}": F.col(f"_later.{c}") for c in carry}
    stripes = dealt.select(F.col("_x._id").alias("_a"), "_split", *group, *own,
                           F.transform("_later._id", lambda i: (i - _SHIFT).cast("int")).alias("_y__id"),
                           *[c.alias(f"_y_{n}") for n, c in others.items()])
    dealers = 4 * int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = stripes.repartition(dealers, "_a", "_split")
    if least > 1 and (relate or not carry):
        return _repeated(stripes, least, bool(relate))
    kept_columns = ["_a", "_split", *group, *([] if relate else [f"a_{c}" for c in carry])]
    pairs = stripes.select(
        *kept_columns, F.arrays_zip(*[f"_y_{n}" for n in ("_id", *others)]).alias("_later")).select(
        *kept_columns, F.explode("_later").alias("_y"))
    return pairs.select(*kept_columns, (F.col("_y._y__id") + F.lit(_SHIFT)).alias("_b"),
                        *[F.col(f"_y._y_{n}").alias(n) for n in others])


def _repeated(stripes: DataFrame, least: int, related: bool) -> DataFrame:
    """A row (_a, _split, _b, _related) for each pair in each group that shares ``least`` groups or more; of others some.

    The second items of all stripes of an item are sorted in an array.  One that is there ``least`` times has itself
    ``least`` // 2 places before or after it, wherever in its run it stands; the rest go before they become rows, so
    that what a task holds is its stripes and not its pairs."""
    place = lambda y: (y + F.lit(_SHIFT)) * 128
    entries = (F.zip_with("_y__id", "_y__related", lambda y, r: place(y) + r) if related
               else F.transform("_y__id", place))
    sorted_ = stripes.select("_a", "_split", entries.alias("_entries")).groupBy("_a", "_split").agg(
        F.sort_array(F.flatten(F.collect_list("_entries"))).alias("_sorted"))
    item = lambda e: F.shiftright(e, 7)
    step = least // 2
    again = F.filter("_sorted", lambda e, i: (item(F.get("_sorted", i + step)) == item(e)) | (item(F.get("_sorted", i - step)) == item(e)))
    return sorted_.select("_a", "_split", F.explode(again).alias("_e")).select(
        "_a", "_split", item(F.col("_e")).alias("_b"), F.col("_e").bitwiseAND(F.lit(127).cast("long")).alias("_related"))


def pair_counts(rows: DataFrame, group: list[str], aggregates: list[Column], min_support: int = 1,
                block: int = BLOCK, stripes: int = STRIPES, sizes: DataFrame | None = None,
                support: DataFrame | None = None) -> Pairs:
    """Aggregates over the groups of every pair of items that share a group (they see the group's columns).

    ``rows``: distinct (group, item_code).  Pairs that share fewer than ``min_support`` groups may be missing.  A caller that
    has them gives ``sizes``, ``group_sizes`` of these or more rows, and ``support``, the rows of each item as ``_support``
    (0 for the null item), so that they are not counted again."""
    kept, numbers = _kept(rows, group, min_support, [], stripes, support)
    pairs = _unfolded(kept, group_sizes(rows, group) if sizes is None else sizes, group, [], block)
    return Pairs(pairs.groupBy("_a", "_split", "_b").agg(*aggregates).drop("_split"), numbers)


def pair_sums(rows: DataFrame, group: list[str], count: str, conditions: dict[str, Callable[[str, str], Column] | int],
              min_count: int, carry: list[str] | None = None, block: int = BLOCK, stripes: int = STRIPES,
              relate: Callable[[Column, Column], Column] | None = None) -> Pairs:
    """Pairs that share at least ``min_count`` groups: in how many they do (``count``), and in how many of these
    each condition holds.  ``rows``: distinct (group, item_code) with the columns ``carry``; a condition is
    made from the prefixes of the first and the second item's carried columns.  With ``relate``, which makes a number
    (0 to 127) of the structs of both items, a condition is the number it holds for: the numbers are
    made before the stripes are shuffled, a byte a pair, and the carried columns stay behind.

    The largest groups, fewer than half of ``min_count``, are not unfolded if they exceed a block: each of the h of
    them adds at most one to a pair's count, so only pairs that reach ``min_count`` - h elsewhere can qualify, and
    for these it is looked up which of the h groups hold both items.  A group with most of the items
    so costs its items, not their pairs, and the counts stay exact."""
    carry = carry or []
    hottest = (min_count - 1) // 2
    sizes = group_sizes(rows, group)
    kept, numbers = _kept(rows, group, min_count, carry, stripes)
    if hottest:
        hot = _over(sizes, group, block).orderBy(F.col("_n").desc(), *[f"_{c}" for c in group]).limit(hottest)
        hot = hot.withColumn("_hot", F.row_number().over(Window.orderBy(F.col("_n").desc(), *[f"_{c}" for c in group])))
        marked = kept.join(hot.drop("_n"), _same(kept, hot, group), "left").select(*group, "_x", "_hot")
        kept = marked.where("_hot is null").select(*group, "_x")
    holds = conditions
    if relate:
        struct = lambda x: F.struct(*[F.col(f"{x}_{c}").alias(c) for c in carry])
        holds = {n: lambda a, b, number=number: relate(struct(a), struct(b)) == number for n, number in conditions.items()}
    found = {n: F.col("_related") == c if relate else c("a", "b") for n, c in conditions.items()}
    counted = [F.count(F.lit(1)).alias(count)] + [F.count(F.when(c, 1)).alias(n) for n, c in found.items()]
    pairs = _unfolded(kept, sizes, group, carry, block, relate, min_count - hottest)
    counts = pairs.groupBy("_a", "_split", "_b").agg(*counted).drop("_split")
    if hottest:
        least = F.lit(min_count) - hot.agg(F.count(F.lit(1))).scalar()
        counts = counts.where(F.col(count) >= least)
        inside = lambda k, c: F.max(F.when(F.col("_hot") == k, c))  # noqa: E731  at most one row an item and group
        members = marked.where("_hot is not null").groupBy(F.col("_x._id").alias("_item")).agg(*[
            inside(k, F.col(f"_x.{c}") if c else F.lit(1)).alias(f"h{k}_{c}")
            for k in range(1, hottest + 1) for c in ("", *carry)])
        for side in "ab":
            own = members.select(F.col("_item").alias(f"_{side}"),
                                 *[F.col(c).alias(f"{side}{c}") for c in members.columns if c != "_item"])
            counts = counts.join(own, f"_{side}", "left")
        totals = {count: lambda a, b: F.lit(True), **holds}
        for name, condition in totals.items():
            more = [F.when(F.col(f"ah{k}_").isNotNull() & F.col(f"bh{k}_").isNotNull() & condition(f"ah{k}", f"bh{k}"), 1)
                    .otherwise(0) for k in range(1, hottest + 1)]
            counts = counts.withColumn(name, sum(more, F.col(name)))
        counts = counts.select("_a", "_b", *totals)
    return Pairs(counts.where(F.col(count) >= min_count), numbers)
