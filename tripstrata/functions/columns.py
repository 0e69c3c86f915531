"""Column helpers: the null and rounding rules that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_false(p: Column) -> Column:
    """A predicate for which NULL counts as false."""
    return F.coalesce(p, F.lit(False))


def flag(p: Column) -> Column:
    return p.cast("int")


def pct(p: Column, digits: int = 1) -> Column:
    """Share of true among the non-null, in percent."""
    return F.round(F.lit(100.0) * F.avg(flag(p)), digits)


def share(n: str, digits: int = 4) -> Column:
    """A row's part of the sum over all rows of an aggregate, in percent. For small, grouped frames."""
    return F.round(F.lit(100.0) * F.col(n) / F.sum(n).over(Window.partitionBy()), digits)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limits a value and keeps NULL; greatest() and least() alone would skip it."""
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def any_true(p: Column) -> Column:
    return F.bool_or(p)


def first_by(x: Column, *order: Column) -> Column:
    """The x of the first row in the order, of rows where x isn't NULL; the order settles ties. One number as the order can be hashed."""
    return F.min_by(x, F.when(x.isNotNull(), F.struct(*order) if len(order) > 1 else order[0]))


def last_by(x: Column, *order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), F.struct(*order) if len(order) > 1 else order[0]))


def words(path: Column) -> Column:
    """How many parts a path has between blanks; NULL for NULL."""
    return F.when(path.isNotNull(), F.size(F.split(F.trim(path), " ")))


def place(text: Column, at: int) -> Column:
    """The three-letter code at a position, upper case."""
    return F.upper(F.substring(text, at, 3))


def money(text: Column) -> Column:
    """'$574', '574$' or '1,574' as a number; NULL where it is none."""
    return F.regexp_replace(F.trim(text), r"[$,\s]", "").try_cast("double")


def timestamp19(text: Column) -> Column:
    """The first 19 characters as a timestamp without zone; fractions beyond them are cut."""
    return F.substring(text, 1, 19).try_cast("timestamp_ntz")


def quantile_bucket(rank: Column, n: Column, k: int) -> Column:
    """Bucket 0 to k - 1 of a 1-based rank among n, with right-closed edges at 1 + (n - 1) * i / k."""
    out = F.lit(k - 1)
    for i in range(k - 1, 0, -1):
        out = F.when(rank <= 1 + (n - 1) * F.lit(i / k), i - 1).otherwise(out)
    return out


def bins(x: Column, edges: list[float], labels: list[str] | None = None, right: bool = True) -> Column:
    """Interval label or number of x; right-closed, or left-closed with right=False. NULL outside."""
    out = F.lit(None)
    for i in reversed(range(len(edges) - 1)):
        lo, hi = edges[i], edges[i + 1]
        inside = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        out = F.when(inside, labels[i] if labels else i).otherwise(out)
    return out


def average_rank(df: DataFrame, column: str, name: str, descending: bool = False) -> DataFrame:
    """Rank with ties averaged and NULLs last. For small frames: it is one window over all rows."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    w = Window.partitionBy().orderBy(key)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2.0)


def counted_percentile(df: DataFrame, groups: list[str], x: str, parts: list[float], weight: str | None = None) -> DataFrame:
    """Interpolated percentiles of x by group, as an array `q`, and how many rows have an x. Values are counted first: what
    meets in one place is a group's distinct values (money in whole cents, say), not its rows. A row counts once, or as often as `weight`
    says."""
    counted = df.where(F.col(x).isNotNull()).groupBy(*groups, x).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    return counted.groupBy(*groups).agg(F.percentile(x, F.array(*map(F.lit, parts)), F.col("__n")).alias("q"), F.sum("__n").alias("n"))


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def from_cents(x: Column) -> Column:
    """An amount in cents, rounded up at the half, as money: so that interpolated halves come out alike everywhere."""
    return F.floor(x + 0.5) / 100
