"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options that results depend on.

    * UTC: bucket starts and ISO text are defined in UTC.
    * Duplicate JSON keys: the last one wins instead of failing the parse.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors can reach, as named by the cluster, or None."""
    return spark.conf.get("spark.checkpoint.dir", None)


def compute_once(**columns: Column) -> Column:
    """Generator for ``select``: the given columns, safe to filter on.

    The optimizer pushes a filter through a projection by repeating the
    expressions in it, which is costly when they parse or validate. It does not
    look through a generator, here one of a single row.
    """
    return F.inline(F.array(F.struct(*(column.alias(name) for name, column in columns.items()))))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, for a small result that is used several times.

    Goes to the shared checkpoint folder, so losing an executor costs nothing.
    Without such a folder ``df`` is kept in the executors' memory or on their disks; what
    is lost with an executor is then computed again.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df.checkpoint()
