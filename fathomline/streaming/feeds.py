"""Tables that arrive slice by slice, and streaming queries that are run to the end of what has arrived.

Each call of `advance` starts the query from its checkpoint, takes the files that came since, and stops, so a job
that is scheduled again goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start within the block keep their state in RocksDB."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class Feed:
    """A folder where slices of a table arrive one after another.

    The table is written once, by slice; a slice arrives when its files are moved into the watched folder, in one
    rename on the shared file system, so a stream never sees half of one.
    """

    def __init__(self, rows: DataFrame, slice_column: str, form: str = "parquet", **options):
        self.spark = rows.sparkSession
        self.form, self.options = form, options
        self.schema = rows.drop(slice_column).schema
        self.path = scratch_path(self.spark, "feed")
        rows.write.format(form).options(**options).partitionBy(slice_column).save(f"{self.path}/waiting")
        self.column = slice_column
        self._files().mkdirs(self._at("here"))

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("here").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def arrive(self, number: int) -> bool:
        """Move a slice in; False if the table has none of that number."""
        source = self._at(f"waiting/{self.column}={number}")
        return bool(self._files().exists(source)) and bool(self._files().rename(source, self._at(f"here/{number:06d}")))

    def stream(self, files: int | None = None) -> DataFrame:
        """What has arrived as a stream, so many files a micro-batch."""
        reader = self.spark.readStream.schema(self.schema).format(self.form).options(**self.options)
        return (reader.option("maxFilesPerTrigger", files) if files else reader).load(f"{self.path}/here/*")


def advance(plan: DataFrame, checkpoint: str, path: str | None = None, batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a streaming plan to the end of what has arrived, into Parquet files under path or by batch(df, id).

    Files of Spark's sink count once however often a micro-batch runs; a function must do the same by id.
    """
    writer = plan.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path)
    with rocksdb(plan.sparkSession):
        query = writer.start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_feed(feed: Feed, slices: int, plan: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The rows that plan gives when slices 0 to slices - 1 arrive one by one and the query is run after each."""
    spark = feed.spark
    out, checkpoint = scratch_path(spark, "streamed"), scratch_path(spark, "checkpoint")
    ran = False
    for k in range(slices):
        if feed.arrive(k):
            advance(plan(feed.stream()), checkpoint, out)
            ran = True
    return spark.read.schema(schema).parquet(out) if ran else spark.createDataFrame([], schema)


def slices_by_time(ts: str, bounds: list[str]):
    """Column: how many of the bounds (ascending times) a row's time has reached."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(F.col(ts) >= F.lit(b).cast("timestamp_ntz"), 1).otherwise(0)
    return out.cast("int")
