"""Running totals and row numbers over a whole table, without a task that takes all rows.

Rows are dealt into buckets by bounds that are written into the plan as literals, so a row's bucket
follows from its value alone: whatever is planned twice, coalesced or pruned, it stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets at most; a bucket's rows are sorted by one task, which spills if they don't fit.
MOST_BUCKETS = 256
#: Rows of a bucket, where the table is large enough for several.
BUCKET_ROWS = 50_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bucket_of(df: DataFrame, order: str) -> Column:
    """The bucket of df's rows by the column order (a number, date or timestamp): ascending, nulls and the
    least values in bucket 0, equal values in one bucket. The driver gets one row with the bounds."""
    n = df.count()
    buckets = min(MOST_BUCKETS, n // BUCKET_ROWS + 1)
    if buckets == 1:
        return F.lit(0)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, shares, 10 * MOST_BUCKETS)).first()[0]
    distinct = list(dict.fromkeys(bounds or []))
    at = F.size(F.filter(F.array(*map(F.lit, distinct)), lambda b: b <= F.col(order))) if distinct else F.lit(0)
    return F.when(F.col(order).isNull(), F.lit(0)).otherwise(at)


def _before(dealt: DataFrame, bucket: str, value: Column, newest_first: bool, key: str, base: str) -> DataFrame:
    """(key, base): what the buckets before each one sum to. MOST_BUCKETS rows at most, so one window takes
    them."""
    sums = dealt.groupBy(bucket).agg(F.sum(value).alias("s"))
    w = Window.orderBy(F.col(bucket).desc() if newest_first else F.col(bucket).asc()).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col(bucket).alias(key), F.coalesce(F.sum("s").over(w), F.lit(0)).alias(base))


def running_total(df: DataFrame, order: str, value: str, out: str, newest_first: bool = True) -> DataFrame:
    """df with the running sum of value in descending (or ascending) order of a column. Equal orders sum
    together; null orders come last (first, if ascending); null values count as nothing. Other columns stay,
    whatever their names; an empty table stays empty."""
    bucket, inside, key, base = fresh(df, "bucket", "inside", "key", "base")
    sort = F.col(order).desc() if newest_first else F.col(order).asc()
    dealt = df.withColumn(bucket, bucket_of(df, order))
    before = _before(dealt, bucket, F.col(value), newest_first, key, base)
    summed = dealt.withColumn(inside, F.coalesce(F.sum(value).over(Window.partitionBy(bucket).orderBy(sort)), F.lit(0)))
    joined = summed.join(F.broadcast(before), F.col(bucket) == F.col(key))  # a row a bucket
    return joined.select(*df.columns, (F.col(base) + F.col(inside)).alias(out))


def row_numbers(df: DataFrame, order: str, out: str) -> DataFrame:
    """df with numbers 1, 2, ... in ascending order of a column; rows of equal order are numbered by a
    digest of the whole row."""
    bucket, inside, key, base = fresh(df, "bucket", "inside", "key", "base")
    dealt = df.withColumn(bucket, bucket_of(df, order))
    before = _before(dealt, bucket, F.lit(1), False, key, base)
    tie = F.xxhash64(F.to_json(F.struct(*df.columns)))
    numbered = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(bucket).orderBy(F.col(order).asc(), tie)))
    return numbered.join(F.broadcast(before), F.col(bucket) == F.col(key)).select(*df.columns, (F.col(base) + F.col(inside)).alias(out))
