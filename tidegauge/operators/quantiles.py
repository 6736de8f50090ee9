"""Exact percentiles without a task that holds a group, and percentiles of all earlier rows."""

from __future__ import annotations

from heapq import heappush, heappushpop

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources.shared import materialize


def grouped_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group its exact percentiles, interpolated between neighbours; nulls don't count, a group without values has no row.

    Equal values of a group are counted first, so ties are one row. Values are
    dealt out by range, the ranges of a group are counted, and the running sum
    of these counts (one number a range) says in which range, and at which place
    there, each wanted rank lies. Only those ranges are ranked. No task holds
    more of a group than one range.
    """
    weighted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(weighted.repartitionByRange(parts, *by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    sized = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    group = Window.partitionBy(*by)
    sized = sized.withColumns(
        {"_from": F.sum("_size").over(group.orderBy("_part")) - F.col("_size"), "_all": F.sum("_size").over(group)}
    )
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("_all") - 1) * F.lit(float(s))).alias("at")) for name, s in shares.items()))
    asked = sized.withColumn("_w", F.explode(wanted)).select(*by, "_part", "_from", "_size", "_w.name", "_w.at")
    asked = asked.withColumn("_rank", F.explode(F.array(F.floor("at"), F.ceil("at"))))
    asked = asked.where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_size")))
    local = asked.withColumn("_rank", F.col("_rank") - F.col("_from")).select(*by, "_part", "name", "at", "_rank").distinct()
    running = Window.partitionBy(*by, "_part").orderBy("_v")
    inside = dealt.join(local.select(*by, "_part").distinct(), [*by, "_part"], "left_semi")
    inside = inside.withColumn("_below", F.sum("_n").over(running) - F.col("_n"))
    met = inside.join(local, [*by, "_part"]).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
    low, high = F.min("_v"), F.max("_v")
    found = met.groupBy(*by, "name", "at").agg((low + (high - low) * (F.col("at") - F.floor("at"))).alias("_p"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("_p"))).alias(name) for name in shares))


class RunningPercentile:
    """One percentile of the values so far, in two heaps: those up to the lower neighbour, and those above it."""

    def __init__(self, share: float):
        self.share, self.low, self.high = share, [], []

    def add(self, x: float) -> None:
        """A value takes time logarithmic in the values so far; the lower neighbour's rank rises by one at most."""
        n = len(self.low) + len(self.high) + 1
        up = int(np.floor(self.share * (n - 1))) + 1 > len(self.low)
        if up:
            heappush(self.low, -heappushpop(self.high, x))
        else:
            heappush(self.high, -heappushpop(self.low, -x))

    def value(self) -> float | None:
        """None without values."""
        if not self.low:
            return None
        at = self.share * (len(self.low) + len(self.high) - 1)
        below = -self.low[0]
        return below + (self.high[0] - below) * (at - np.floor(at)) if self.high else below


def prior_percentile(rows: DataFrame, by: str, order: str, value: str, share: float, name: str) -> DataFrame:
    """(by, order, name): the percentile of all earlier values of each row's group, null before the first; nulls don't count.

    A group is one series in time (hours of a trigger) and is read once, in order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seen, out = RunningPercentile(share), []
        for x in pdf[value].tolist():
            out.append(seen.value())
            if x == x:
                seen.add(x)
        return pdf[[by, order]].assign(**{name: np.array(out, dtype=float)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    asked = rows.select(by, order, F.col(value).cast("double").alias(value))
    found = asked.groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, `{name}` double")
    return found.withColumn(name, F.nanvl(F.col(name), F.lit(None).cast("double")))
