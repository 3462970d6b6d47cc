"""Scalar metric helpers (C1-C14) and the null / arithmetic rules N1-N12.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen; there is no Python UDF anywhere in the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed as fixed-point decimals so that totals are exact and do not depend
# on the order rows reach an aggregation buffer (partials from 1000s of tasks).
MONEY = "decimal(18,6)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c) -> Column:
    """SQL ``SUM`` of a money/quantity column: NULL only when every input is NULL.

    Exact to the micro-unit (6 decimals, as ``decimal(18,6)``) but aggregated with two
    ``long`` sums -- whole units and micro-units of the fraction -- which stay in
    Spark's fast fixed-width aggregation buffers (a wide-decimal buffer is several times
    slower).  The whole-unit sum cannot overflow for money; the fraction sum adds less
    than 10^6 per row.  The two are combined as a decimal once per group.
    """
    x = col(c)
    whole = F.floor(x)
    micro = F.round((x - whole) * 1000000).cast("long")
    total = F.sum(whole).cast("decimal(38,0)") * 1000000 + F.sum(micro)
    return (total / 1000000).cast("double")


FINE = "decimal(28,10)"


def fine_sum(c) -> Column:
    """Exact sum of a computed ratio (10 decimals kept), independent of row order."""
    return F.sum(col(c).cast(FINE)).cast("double")


def fine_mean(c) -> Column:
    """Mean of the non-NULL values of a computed ratio, summed exactly."""
    return F.try_divide(fine_sum(c), F.count(col(c)).cast("double"))


def exact_mean(c) -> Column:
    """Mean of the non-NULL values from an exact decimal sum (row-order independent)."""
    return F.try_divide(fine_sum(c), F.count(col(c)).cast("double"))


def exact_covar_pop(a, b=None) -> Column:
    """Population covariance (variance without ``b``) of values to the micro-unit, from whole-number moments.

    With m and k the values in micro-units, S their sums, p = Sm div n and q = Sk div n, the products about
    (p, q) are ``Smk - p Sk - q (Sm - n p)``, and the covariance is that over n less (Sm - n p)(Sk - n q) / n^2.
    All but the last step is exact, so nothing cancels and the order of the rows does not matter.
    Rows where either value is NULL are left out.  Where the products pass 38 digits (values of
    2e9 on more than 10^7 rows) the ordinary double aggregate stands in."""
    x, y = col(a), col(a if b is None else b)
    if b is not None:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    m, k = (F.floor(v * 1000000 + 0.5).cast("decimal(19,0)") for v in (x, y))
    n = F.count(x).cast("decimal(19,0)")
    sm, sk, smk = F.sum(m), F.sum(k), F.try_sum(m * k)
    p, q = (F.try_divide(s - s % F.greatest(n, F.lit(1).cast("decimal(19,0)")), n).cast("decimal(19,0)") for s in (sm, sk))
    products = F.try_subtract(F.try_subtract(smk, F.try_multiply(p, sk)), F.try_multiply(q, sm - n * p))
    count, rest = n.cast("double"), [(s - n * c).cast("double") for s, c in ((sm, p), (sk, q))]
    low = products % 1000000000  # in two parts, each of which becomes a double without an engine's choice of rounding
    double = F.try_divide(products - low, F.lit(1000000000)).cast("decimal(29,0)").cast("double") * 1e9 + low.cast("double")
    exact = F.try_divide(double, count) - F.try_divide(rest[0], count) * F.try_divide(rest[1], count)
    return F.coalesce(exact / 1000000 / 1000000, F.covar_pop(x, y))


def exact_stddev_pop(c) -> Column:
    """Population standard deviation, see ``exact_covar_pop``."""
    return F.sqrt(F.greatest(exact_covar_pop(c), F.lit(0.0)))


def js_sum(c) -> Column:
    """A JavaScript reduce treats NULL as 0 (an empty/all-null group sums to 0)."""
    return F.coalesce(money_sum(c), F.lit(0.0))


def js_mean(c) -> Column:
    """JS means divide by the row count including NULL rows."""
    return F.try_divide(js_sum(c), F.count(F.lit(1)).cast("double"))


def js_distinct_count(c) -> Column:
    """``new Set(values).size`` counts NULL as one more value."""
    c = col(c)
    return (F.countDistinct(c) + F.max(c.isNull().cast("int"))).cast("long")


def first_day(c) -> Column:
    """Least calendar date of a group's text dates, as text; texts that are no dates do not count.

    Dates have fixed-width aggregation buffers, so the lines are hashed; text MIN / MAX would sort them."""
    return F.min(F.try_to_date(col(c))).cast("string")


def last_day(c) -> Column:
    """Greatest calendar date of a group's text dates, see ``first_day``."""
    return F.max(F.try_to_date(col(c))).cast("string")


def js_le_zero(c) -> Column:
    """JS ``null <= 0`` is true."""
    return F.coalesce(col(c), F.lit(0.0)) <= 0


def round_half_up(c, scale: int = 2) -> Column:
    """Round HALF_UP on the decimal value of a double, as decimal.js does.

    Going through a wide decimal first makes the rounding independent of the
    binary representation error of the double (12.345 rounds to 12.35).
    """
    return F.round(F.coalesce(col(c), F.lit(0.0)).cast("decimal(38,10)"), scale).cast("double")


def ratio_or_zero(num, den) -> Column:
    """``num / den``, 0 when the denominator is 0 or NULL (helpers' N6 rule)."""
    num, den = col(num), col(den)
    d = F.coalesce(den, F.lit(0.0))
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(F.coalesce(num, F.lit(0.0)), d))


def to_cents(c) -> Column:
    """A sum or mean of money to two decimals, halves away from zero; NULL stays NULL."""
    return F.round(col(c).cast(MONEY), 2).cast("double")


# --- C1-C6: financial helpers --------------------------------------------------------

def margin(revenue, cost) -> Column:
    """round(revenue - cost, 2), NULL as 0.

    The subtraction is done on the decimal values (6 places, the precision of every
    money sum), as decimal.js does, so a difference that is exactly half a cent
    rounds up instead of depending on the binary error of a double subtraction.
    """
    r = F.coalesce(col(revenue), F.lit(0.0)).cast("decimal(38,6)")
    c = F.coalesce(col(cost), F.lit(0.0)).cast("decimal(38,6)")
    return F.round(r - c, 2).cast("double")


def margin_percent(revenue, cost) -> Column:
    """(revenue - cost) / revenue * 100, 2 dp; 0 when revenue is 0."""
    r = F.coalesce(col(revenue), F.lit(0.0))
    c = F.coalesce(col(cost), F.lit(0.0))
    return F.when(r == 0, F.lit(0.0)).otherwise(round_half_up(F.try_divide(r - c, r) * 100))


def average_price(revenue, quantity) -> Column:
    """Revenue / quantity, 2 dp; 0 when quantity is 0."""
    return round_half_up(ratio_or_zero(revenue, quantity))


def average(total, count) -> Column:
    """C4: total / count, 2 dp; 0 when count is 0."""
    return round_half_up(ratio_or_zero(total, col(count).cast("double")))


def percentage_of_total(value, total) -> Column:
    """Value / total * 100, 2 dp; 0 when total is 0."""
    return round_half_up(ratio_or_zero(value, total) * 100)


def round_to(c, scale: int = 2) -> Column:
    """round(coalesce(x, 0), n)."""
    return round_half_up(c, scale)


def discount_percent(quantity, line_total, base_price) -> Column:
    """((q * base) - line_total) / (q * base) * 100, 2 dp.

    0 when the base price is NULL or not positive, or the quantity is 0.
    """
    q, lt, b = col(quantity), col(line_total), col(base_price)
    expected = q * b
    return (F.when(b.isNull() | (b <= 0) | (q == 0), F.lit(0.0))
             .otherwise(round_half_up(F.try_divide(expected - lt, expected) * 100)))


# --- C7-C12, C14: list helpers as DataFrame transforms -------------------------------

def filter_negative_margins(df):
    """Keep rows whose first present margin column is negative."""
    for name in ("margin", "total_margin", "gross_margin"):
        if name in df.columns:
            return df.filter(F.col(name) < 0)
    return df.limit(0)


def filter_high_discounts(df, threshold: float):
    """discount_percent strictly above the threshold."""
    return df.filter(F.col("discount_percent") > threshold)


def filter_min_transactions(df, n: int):
    """transaction_count >= n."""
    return df.filter(F.col("transaction_count") >= n)


def sort_by(df, field: str, order: str = "desc", *tie_break: str):
    """Sort ascending/descending with NULLs last, then a total tie-break."""
    c = F.col(field)
    key = c.desc_nulls_last() if order == "desc" else c.asc_nulls_last()
    return df.orderBy(key, *[F.col(t).asc_nulls_last() for t in tie_break])


def top(df, field: str, order: str, n: int | None, *tie_break: str):
    """C10 + C11: sort then keep the first n (TakeOrderedAndProject, no full sort)."""
    out = sort_by(df, field, order, *tie_break)
    return out if n is None else out.limit(n)


def paginate(df, page: int, page_size: int):
    """1-based page of an already totally ordered DataFrame."""
    return df.offset((page - 1) * page_size).limit(page_size)


def filter_discount_range(df, min_discount=None, max_discount=None):
    """C14: inclusive min/max on discount_percent."""
    if min_discount is not None:
        df = df.filter(F.col("discount_percent") >= min_discount)
    if max_discount is not None:
        df = df.filter(F.col("discount_percent") <= max_discount)
    return df
