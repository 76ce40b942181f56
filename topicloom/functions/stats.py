"""Statistics of one group, as aggregate Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(counts: Column) -> Column:
    """Base-2 entropy of an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, (x / total) * F.log2(x / total)).otherwise(0.0))


def cohesion(sims: Column) -> list[Column]:
    """Mean, tenth percentile (linear) and population deviation of similarities."""
    return [F.avg(sims).alias("mean_sim"), F.percentile(sims, F.lit(0.1)).alias("p10_sim"), F.stddev_pop(sims).alias("std_sim")]


def today_value(ratio: Column) -> Column:
    """A freshness of exactly 0 counts as 1, like a missing one, wherever clusters are scored."""
    return F.when(ratio.isNull() | (ratio == 0), 1.0).otherwise(ratio)


def matter(size: Column, entropy_: Column, domains: Column, labels: Column, today: Column, concentration: Column, event: Column | None = None) -> Column:
    """Rank of a topic: size, spread over domains and labels, freshness; stale, one-sided and mixed ones lose."""
    tr = today_value(today)
    score = size + entropy_ * 0.8 + domains * 0.12 + labels * 0.15 + (tr - 0.5) * F.least(F.lit(12.0), size * 0.4)
    score = score - F.when((size >= 12) & (tr < 0.25), 3.0).otherwise(0.0) - F.when((size >= 12) & (F.coalesce(concentration, F.lit(0.0)) >= 0.45), 2.5).otherwise(0.0)
    return score if event is None else score - F.when(event == "MIXED", 1.0).otherwise(0.0)


def suspicious(n: Column, entity: Column, p10: Column, std: Column, today: Column) -> Column:
    """A large cluster whose entities, similarity or dates hint at several stories."""
    tr = today_value(today)
    loose = (entity < 0.10) | (p10 < 0.42) | ((p10 < 0.50) & (std > 0.14)) | ((n >= 25) & (entity < 0.16)) | ((n >= 15) & (tr < 0.25))
    return (n >= 12) & loose


def incoherent(n: Column, texts: Column, p10: Column, std: Column) -> Column:
    """Whether similarity alone drops a cluster: under four articles, or a wide tail in a middling one."""
    return F.when(n < 4, True).when((n > 12) | (texts < 4), False).otherwise((p10 < 0.40) & (std > 0.18))
