"""Files that keep arriving, merged into the stored catalogue batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from helixspark.sinks.writers import latest_first, merge_into


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions of a stored catalogue, on whatever file system it lies."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(v[1:]) for v in names if v[:1] == "v" and v[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{v}/_SUCCESS")))


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of a stored catalogue."""
    return spark.read.parquet(f"{folder}/v{versions(spark, folder)[-1]}")


def ingest(spark: SparkSession, incoming: str, schema: StructType, folder: str, key: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of parquet files; each batch becomes a new version of the catalogue in ``folder``.

    A version is named by its batch, so a batch that is run again after a
    failure writes the same version again: every file counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in versions(spark, folder) if v < number + 1]
        path = f"{folder}/v{number + 1}"
        if before:
            merge_into(f"{folder}/v{before[-1]}", batch, key, path)
        else:
            merge_into_empty(batch, key, path)

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into_empty(batch: DataFrame, key: str, path: str) -> None:
    """The first version: one row per key."""
    from helixspark.operators.catalogue import first_of

    first_of(batch, [key], latest_first(batch)).write.mode("overwrite").parquet(path)
