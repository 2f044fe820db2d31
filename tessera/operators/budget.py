"""Admission under a budget (W03, W04, W13), chunk windows (W05) and regions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.running import running


def prefix_budget(rows: DataFrame, cost: str, budget: int, by: list, partition: list[str] | None = None) -> DataFrame:
    """Rows in order while their running cost fits; the first that does not ends it. Over all rows if there is no partition: then in ranges."""
    if not partition:
        return running(rows, by, spent=cost).where(F.col("spent") <= budget)
    w = Window.partitionBy(*partition).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def skipping_budget(rows: DataFrame, cost: str, budget: int, by: list[str], key: str, partition: str) -> DataFrame:
    """A row that does not fit is left out, later smaller ones may fit. Rows that never fit go first; the others pass in order, and of each partition only what is spent is held."""
    kinds = dict(rows.dtypes)
    ordered = rows.where(F.col(cost) <= budget).select(partition, *[b for b in by if b not in (partition, key)], F.col(key).cast("long").alias(key), F.col(cost).cast("long").alias("__cost"))
    ordered = ordered.repartition(partition).sortWithinPartitions(partition, *by, key, "__cost")

    def admit(batches):
        here, spent = None, 0
        for b in batches:
            names, keys, kept, costs = b.column(partition).to_pylist(), b.column(key).to_pylist(), [], []
            for i, (name, c) in enumerate(zip(names, b.column("__cost").to_pylist())):
                if name != here:
                    here, spent = name, 0
                if spent + c <= budget:
                    spent += c
                    kept.append(i)
                    costs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in kept], b.column(partition).type), pa.array([keys[i] for i in kept], pa.int64()), pa.array(costs, pa.int64())], names=[partition, key, "cost"])

    taken = ordered.mapInArrow(admit, f"{partition} {kinds[partition]}, {key} long, cost long")
    return taken.join(taken.groupBy(partition).agg(F.sum("cost").alias("spent")), partition).select(partition, "spent", key)


def capped(rows: DataFrame, count: str, per_row: int, total: int, by: list) -> DataFrame:
    """At most `per_row` of each row, at most `total` of all, in order: `taken`."""
    own = F.least(F.col(count), F.lit(per_row))
    upto = running(rows, by, __upto=own)
    return upto.withColumn("taken", F.greatest(F.lit(0), F.least(own, F.lit(total) - (F.col("__upto") - own)))).drop("__upto")


def line_windows(costs: list[int], target: int = 600, overlap: int = 75) -> list[tuple[int, int]]:
    """Overlapping windows over line costs, from 1 and inclusive.

    A window grows while it stays within `target` (its first line always fits); the next starts far enough back to cover
    `overlap` again, but always at least one line further.
    """
    out, at, n = [], 0, len(costs)
    while at < n:
        end, spent = at, 0
        while end < n and (end == at or spent + costs[end] <= target):
            spent += costs[end]
            end += 1
        out.append((at + 1, end))
        if end >= n:
            break
        back, again = end, 0
        while back > at + 1 and again < overlap:
            back -= 1
            again += costs[back]
        at = back
    return out


def windows(costs: Column) -> Column:
    """W05 over a column of line costs: a window may step back, which a fold in SQL cannot do cheaply."""

    def of(c: pd.Series) -> pd.Series:
        return c.map(lambda x: [{"start": a, "end": b} for a, b in line_windows(list(x))])

    return F.pandas_udf(of, "array<struct<start:int,end:int>>")(costs)


def regions(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """A file's lines between consecutive anchors; what stands before the first is a region of its own."""
    all_ = anchors.select("file_id", "line").union(lines.select("file_id", F.lit(1).alias("line"))).distinct()
    return all_.withColumn("next", F.lead("line").over(Window.partitionBy("file_id").orderBy("line"))).join(lines, "file_id").select("file_id", F.col("line").alias("first"), F.coalesce(F.col("next") - 1, F.col("n_lines")).alias("last"))
