"""Row numbers and running sums over a whole table, by range partitions and their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (inclusive) of columns in an order that is total over its rows.

    Rows are dealt to range partitions; each sums its own, and the totals of the partitions before it
    (one row a partition) are added, so that no task gets all rows.
    """
    placed = df.select("*", *[e.alias(f"__v_{k}") for k, e in sums.items()])
    placed = written(placed.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = sorted(placed.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(k) for k in sums]).collect(), key=lambda r: r["__part"])
    before, ahead = [], dict.fromkeys(sums, 0)
    for r in totals:
        before.append((r["__part"], *(ahead[k] for k in sums)))
        ahead = {k: ahead[k] + (r[k] or 0) for k in sums}
    kinds = dict(placed.groupBy().agg(*[F.sum(f"__v_{k}").alias(k) for k in sums]).dtypes)
    offsets = df.sparkSession.createDataFrame(before, ", ".join(["__part int", *(f"`__b_{k}` {kinds[k]}" for k in sums)]))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "__part")  # one row a partition
    return out.select(*df.columns, *[(F.sum(f"__v_{k}").over(own) + F.col(f"__b_{k}")).alias(k) for k in sums])


def every_nth(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows: of the rows in order of a unique ``key`` each ceil(n / limit)-th, from the first on."""
    n = df.count()
    stride = max(1, -(-n // limit))
    return running(df, [F.col(key)], {"__n": F.lit(1)}).filter((F.col("__n") - 1) % stride == 0).drop("__n")
