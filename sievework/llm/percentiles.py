"""Percentiles per group over very large numeric columns.

``exact_percentiles`` is a full distributed sort: rows are range-partitioned and sorted by
(groups, value, salt), so a group, or a single value, that holds a third of all rows is spread over
a third of the partitions. Per partition the rows of each group are counted; running sums of these counts give
each group's offset in each partition, hence the partition and the row at which each target
position lies. The neighbouring order statistics are looked up by row number and interpolated
exactly: the error is zero.

``partial_counts`` and ``combined_percentiles`` are the form whose results can be stored by day or
partition and combined later: counts in logarithmic bins. Adding up counts is associative and
commutative; any percentile of the combination is within ``error`` (relative) of an exact order
statistic at its rank.

Edge cases, for both: null and NaN values are ignored; infinite values sort last and are ignored
by the binned form; a null group is a group; repeated rows count as often as they occur; ties need
no rule, as equal values are interchangeable; a group without values and an empty table give no
rows; input columns may have any names, as they are renamed inside.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut, small


SALTS = 4096


def name_of(p: float) -> str:
    return "p" + f"{100 * p:g}".replace(".", "_")


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, percentiles: Sequence[float]) -> DataFrame:
    """Columns: groups, ``n``, and one column per percentile (linear interpolation at p * (n - 1))."""
    g = [f"g{i}" for i in range(len(groups))]
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(groups, g, strict=True)], v.alias("v")).where("v is not null and not isnan(v)")
    # equal values are interchangeable: a salt lets a range end within them; it is written before rows are
    # ranged by it, so that a task that runs again after a loss finds the same one
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")))
    ordered = cut(rows.repartitionByRange(*[F.col(c) for c in (*g, "v", "salt")]).sortWithinPartitions(*g, "v").drop("salt"))
    # in the written table the id is (partition, row in the partition), each in sort order
    numbered = ordered.withColumn("at", F.monotonically_increasing_id())

    runs = numbered.groupBy(*g, F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = Window.partitionBy(*g).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy(*g)))

    wanted = F.array(*[F.struct(F.lit(i).alias("p"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")) for i, p in enumerate(percentiles)])
    targets = (
        runs.withColumn("t", F.explode(wanted))
        .select("*", F.explode(F.array(F.floor("t.pos"), F.ceil("t.pos"))).alias("rank"))
        .where("rank >= offset and rank < offset + c")
        .select(*g, "n", "t.p", (F.col("t.pos") - F.floor("t.pos")).alias("part_way"), (F.col("rank") - F.col("t.pos") > 0).alias("upper"), (F.col("first") + F.col("rank") - F.col("offset")).alias("at"))
        .distinct()
    )
    targets = small(cut(targets), 8 << 20)
    found = targets.join(numbered.select("at", "v"), "at").groupBy(*g, "n", "p").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("part_way").alias("part_way")
    )
    value_at = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part_way"))
    found = found.withColumn("x", value_at)
    return found.groupBy(*g, "n").agg(
        *[F.max(F.when(F.col("p") == i, F.col("x"))).alias(name_of(p)) for i, p in enumerate(percentiles)]
    ).select(*[F.col(a).alias(c) for c, a in zip(groups, g, strict=True)], "n", *[name_of(p) for p in percentiles])


def _base(error: float) -> float:
    return (1 + error) / (1 - error)


def bin_of(value: Column, error: float) -> Column:
    """Number of the bin of a value; 0 is for zero, negative values have a sign of their own."""
    log = F.ceil(F.log(F.abs(value)) / F.lit(math.log(_base(error)))).cast("int")
    return F.when(value == 0, F.struct(F.lit(0).alias("sign"), F.lit(0).alias("log"))).otherwise(F.struct(F.signum(value).cast("int").alias("sign"), log.alias("log")))


def partial_counts(df: DataFrame, groups: Sequence[str], value: str, error: float) -> DataFrame:
    """Counts in bins of relative width 2 * ``error``: columns groups, sign, log, c."""
    g = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(groups, g, strict=True)], F.col(value).cast("double").alias("v"))
    rows = rows.where("v is not null and not isnan(v) and abs(v) < double('inf')").withColumn("b", bin_of(F.col("v"), error))
    return rows.groupBy(*g, "b.sign", "b.log").agg(F.count("*").alias("c")).select(*[F.col(a).alias(c) for c, a in zip(groups, g, strict=True)], "sign", "log", "c")


def combined_percentiles(partials: DataFrame, groups: Sequence[str], percentiles: Sequence[float], error: float) -> DataFrame:
    """Percentiles (lower order statistic at floor(p * (n - 1))) from any union of partial counts."""
    merged = partials.groupBy(*groups, "sign", "log").agg(F.sum("c").alias("c"))
    order = F.col("sign") * F.col("log")
    up = Window.partitionBy(*groups).orderBy("sign", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*groups)))
    base = _base(error)
    middle = F.col("sign") * F.lit(2.0) * F.pow(F.lit(base), F.col("log")) / F.lit(base + 1)
    within = lambda p: (F.floor(F.lit(float(p)) * (F.col("n") - 1)) >= F.col("upto") - F.col("c")) & (F.floor(F.lit(float(p)) * (F.col("n") - 1)) < F.col("upto"))
    return merged.groupBy(*groups, "n").agg(*[F.max(F.when(within(p), middle)).alias(name_of(p)) for p in percentiles])
