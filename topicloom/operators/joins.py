"""Joins whose keys may be hot: values of hot keys are broadcast, which are fewer than a fixed number whatever the tables' size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.sources.tables import written

#: Fewer than HOT keys can have more than one in HOT of all rows; keys of up to LEAST rows are never hot.
HOT, LEAST = 5_000, 4_096


def with_values(rows: DataFrame, values: DataFrame, key: str, count: str = "_c") -> DataFrame:
    """``rows`` with the columns of ``values`` by an inner join.

    values: key, ``count`` (how many rows of ``rows`` have the key; it is left out of the result), and what is wanted; one row a key.
    """
    values = written(values, "values")
    wanted = [c for c in values.columns if c not in (key, count)]
    n, keys = values.agg(F.coalesce(F.sum(count), F.lit(0)), F.count("*")).first()
    if keys <= HOT:  # few keys: their values are a bounded table
        return rows.join(F.broadcast(values.drop(count)), key).select(*rows.columns, *wanted)
    limit = max(LEAST, n // HOT)
    hot = values.filter(F.col(count) > limit).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in wanted])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    rest = marked.filter("_hot is null").select(*rows.columns).join(values.filter(F.col(count) <= limit).drop(count), key)
    return marked.filter("_hot is not null").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in wanted]).unionByName(rest.select(*rows.columns, *wanted))


def with_counts(rows: DataFrame, key: str, **counts: Column) -> DataFrame:
    """``rows`` with aggregates of their key's rows, which are combined in each task before they meet."""
    return with_values(rows, rows.groupBy(key).agg(F.count("*").alias("_c"), *[c.alias(name) for name, c in counts.items()]), key)


def numbered(rows: DataFrame, order: list[Column], into: str = "number") -> DataFrame:
    """``rows`` with their place from 0 in that order: sorted by range, so no task sees all of them."""
    at = F.monotonically_increasing_id()  # partition, then place in it
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(parts.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    sizes = kept.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(into))
