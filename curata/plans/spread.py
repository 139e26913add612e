"""Using all cores on small inputs of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table is small up to so many bytes on disk; a larger one is never shuffled here, however many cores there are.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has less than half as many tasks and its table is small.

    A table in one file with one row group is read by one task however many cores wait. What this moves is bounded by
    ``SMALL_BYTES``, so at the scale of a cluster map-only passes stay map-only.
    """
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan":  # it shuffles already, and asking would run it
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * plan.toRdd().getNumPartitions() > cores:
        return df
    leaves = plan.optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return df.repartition(cores) if size <= SMALL_BYTES else df
