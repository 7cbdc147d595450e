"""Readers of the Parquet tables and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset in a single-machine session (such as the tests) is a local
    folder made and set; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("facetry.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("facetry.checkpoint.dir", found)
    return found


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, with a folder for each value of the column ``by``, if given.

    Cuts the lineage, survives lost executors, and is computed exactly once however
    often the result is used. :func:`drop_stored` removes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/facetry-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _WRITTEN.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Removes a table that :func:`stored` wrote and that nothing will read any more."""
    path = getattr(df, "_stored_at", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _delete(df.sparkSession, path)


def drop_stored(spark: SparkSession) -> int:
    """Removes every table written by :func:`stored`; returns how many."""
    n = 0
    while _WRITTEN:
        n += bool(_delete(spark, _WRITTEN.pop()))
    return n


def latest(df: DataFrame, keys: list[str], values: list[str], at: str = "loaded_at") -> DataFrame:
    """The row of the latest ``at`` for each key, also where a field of it is null.

    A null ``at`` is older than every time. Rows of one key and time are ranked by the
    values themselves, so the result doesn't depend on file order. Null keys are a key
    of their own. Only ``keys`` and ``values`` are read, so other columns, whatever
    their names, cost nothing. Numeric values are pre-aggregated before the shuffle.
    """
    when = F.coalesce(F.col(at).cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800)))
    kinds = dict(df.dtypes)
    if len(values) == 1 and kinds[values[0]] in ("double", "float", "int", "bigint"):
        v = values[0]
        return df.groupBy(*keys).agg(F.max_by(F.col(v), when).alias(v))
    w = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), *[F.col(v).desc_nulls_last() for v in values])
    return (
        df.select(*keys, *values, when.alias("__at"))
        .withColumn("__rn", F.row_number().over(w))
        .where("__rn = 1")
        .drop("__rn", "__at")
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several frames of one row each, side by side."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return united.agg(*[F.max(c).alias(c) for c in united.columns])
