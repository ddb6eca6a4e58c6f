"""Running a stream over what is stored and reading the result back as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Event time of the mark that ends a bounded input: the watermark it brings closes all state.
END_MS = 253_370_764_800_000


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Takes in everything there is, with state in RocksDB and checkpoints in the shared
    folder, and returns the emitted rows.

    Update and complete modes go through ``foreachBatch``: each batch is written under its
    number, which makes a repeated batch overwrite itself and so counts it once.
    """
    spark: SparkSession = stream.sparkSession
    folder = folder or shared_dir(spark)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
        if mode == "append":
            w = w.format("parquet").option("path", f"{folder}/out")
        else:
            w = w.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        w.start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def for_each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], state: str) -> None:
    """Hands what there is to ``take(batch, number)``, batch by batch. A batch that failed
    comes again under its number, so what is written by number is written once."""
    stream.writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", state).start().awaitTermination()


def replayed(path: str, at: str, query: Callable[[DataFrame, int], DataFrame], spark: SparkSession, files_per_batch: int | None = None) -> DataFrame:
    """Streams a stored table through ``query(stream, delay_ms)`` and then ends it.

    ``path`` is a folder of parquet files whose timestamp column ``at`` is the event time.
    The delay handed to the query is the whole time the table spans, so whatever the order of
    its files and the number of micro-batches, no row is late. Only when all are taken in is
    a mark with a time beyond every other added, in a run of its own; its watermark closes
    all state, and nothing closes before. The mark has null in every other column and never
    comes out, being the latest itself.
    """
    stored = spark.read.parquet(path)
    # read as a list of files, so that the mark is no part of it
    lo, hi = stored.agg(F.min(F.unix_millis(at)), F.max(F.unix_millis(at))).first()
    delay = (hi - lo if lo is not None else 0) + 1000
    reader = spark.readStream.schema(stored.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder = shared_dir(spark)
    run_available(query(reader.parquet(path), delay), folder=folder)
    mark = spark.range(1).select(*[(F.timestamp_millis(F.lit(END_MS)) if f.name == at else F.lit(None).cast(f.dataType)).alias(f.name) for f in stored.schema])
    mark.write.mode("append").parquet(path)
    return run_available(query(reader.parquet(path), delay), folder=folder)


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    # a table of one file is found by its name in the folder, one of several is a folder
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isFile()
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else r.parquet(path)
