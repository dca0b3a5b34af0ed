"""As-of joins by time buckets: what was the case at a row's moment, or comes next after it.

Facts of a key become intervals between one and the next. Rows and intervals meet on (key, bucket of time), so a
key with many rows or many facts is spread over its buckets, and no key's rows have to be sorted in one task.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = 3600 * 1_000_000_000
_END = (1 << 63) - 1


def as_of(rows: DataFrame, facts: DataFrame, by: list[str], at: str, since: str, columns: list[str], following: bool = False, bucket: int = HOUR) -> DataFrame:
    """rows with `columns` of the last fact of their key `by` that isn't after `at`; with following, of the first one after it.

    Null where there is none. Of facts of one key and moment the greatest columns count. Facts matter only
    where rows are, so their buckets end with the rows' own first and last moments, which come as one row.
    """
    last = facts.filter(F.col(since).isNotNull()).groupBy(*by, since).agg(F.max(F.struct(*columns)).alias("__f"))
    order = Window.partitionBy(*by).orderBy(since)
    if following:
        ends = last.withColumns({"__from": F.coalesce(F.lag(since).over(order), F.lit(-_END)), "__to": F.col(since)})
    else:
        ends = last.withColumns({"__from": F.col(since), "__to": F.coalesce(F.lead(since).over(order), F.lit(_END))})
    span = rows.agg(F.min(at).alias("__low"), F.max(at).alias("__high"))
    ends = ends.crossJoin(F.broadcast(span.filter("__low IS NOT NULL"))).withColumns({"__a": F.greatest("__from", "__low"), "__b": F.least(F.col("__to") - 1, F.col("__high"))}).filter("__a <= __b")
    number = lambda c: F.floor(F.col(c).cast("decimal(20,0)") / F.lit(bucket)).cast("long")
    met = ends.withColumn("__bucket", F.explode(F.sequence(number("__a"), number("__b")))).select(*[F.col(c).alias(f"__{c}") for c in by], "__bucket", "__from", "__to", "__f")
    moment = F.col(at)
    same = reduce(lambda x, c: x & (F.col(c) == F.col(f"__{c}")), by, F.col("__at") == F.col("__bucket"))
    joined = rows.withColumn("__at", number(at)).join(met, same & (F.col("__from") <= moment) & (moment < F.col("__to")), "left")
    return joined.withColumns({c: F.col(f"__f.{c}") for c in columns}).drop("__at", "__bucket", "__from", "__to", "__f", *[f"__{c}" for c in by])
