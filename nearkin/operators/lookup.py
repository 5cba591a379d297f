"""Floor lookup in sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.session import materialize


def floor_index(values: Column | str, x: Column | str) -> Column:
    """Index of ``x`` in a sorted array, else of the greatest element below it, else 0.

    Bisection by halving steps; of equal elements the last one counts.
    """
    values = F.col(values) if isinstance(values, str) else values
    x = F.col(x) if isinstance(x, str) else x

    def search(both: Column) -> Column:
        v, wanted = both["values"], both["x"]

        def step(at: Column, width: Column) -> Column:
            to = at + width
            return F.when((to <= F.size(v)) & (F.get(v, to - 1) <= wanted), to).otherwise(at)

        widths = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
        return F.greatest(F.aggregate(widths, F.lit(0), step) - 1, F.lit(0))

    return F.transform(F.array(F.struct(values.alias("values"), x.alias("x"))), search)[0]


def floor_index_by(df: DataFrame, key: str, value: str, x: Column) -> DataFrame:
    """The same lookup per key, over the distinct values of the key's rows.

    The index is a count of values not above ``x``, so no key's values are ever gathered in
    one place and a key owning most of the rows is summed up before the shuffle.
    """
    distinct = df.select(key, value).distinct()
    found = F.greatest(F.count_if(F.col(value) <= x) - 1, F.lit(0)).cast("int")
    return distinct.groupBy(key).agg(found.alias("floor_index"))


def floor_join(left: DataFrame, right: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """Rows of ``left`` with ``floor``: the greatest ``value`` of ``right`` under the same ``by`` not above ``x``.

    Null where there is none or where ``x`` or a key is null. Both tables are laid out in one order by ranges,
    ties broken by a hash, so a key of most rows fills many partitions; each partition remembers its
    last value, and what it starts with comes from one row per partition before it.
    """
    points = right.select(*by, F.col(value).alias("at")).dropna().distinct()
    key = F.struct(*by).alias("key")
    rows = left.select(key, F.col(x).alias("at"), F.lit(1).alias("kind"), F.xxhash64(*left.columns).alias("tie"), F.struct(*left.columns).alias("row"))
    marks = points.select(key, "at", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tie"))
    order = ["key", "at", "kind", "tie"]
    spread = marks.unionByName(rows, allowMissingColumns=True).repartitionByRange(*order)
    spread = materialize(spread.withColumn("part", F.spark_partition_id()), "floor")

    mark = F.when(F.col("kind") == 0, F.struct("key", "at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition, so the ordered window and the broadcast are small.
    starts = spread.groupBy("part").agg(F.max(mark).alias("mark")).select("part", F.last("mark", ignorenulls=True).over(before).alias("start"))
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = spread.withColumn("seen", F.last(mark, ignorenulls=True).over(upto)).where("kind = 1")
    last = F.coalesce("seen", "start")
    found = F.when((last["key"] == F.col("key")) & F.col("at").isNotNull(), last["at"])
    return seen.join(F.broadcast(starts), "part").select("row.*", found.alias("floor"))
