"""Runs a stream over what is there now, into a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import new_folder


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    df = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(df.schema)
    if all(f.rstrip("/").endswith(f"/{name}") for f in df.inputFiles()):  # a stream's source is a folder
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_table(stream: DataFrame) -> DataFrame:
    """The stream's appended rows after all available input, kept in the shared folder.

    Windows are appended once the watermark has passed their end. A stream that can't append, counts without a
    watermark, gives the rows that each batch updates; a batch that is run again replaces its rows.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    started = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    try:
        query = started.format("parquet").outputMode("append").start(f"{folder}/rows")
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith("STREAMING_OUTPUT_MODE"):
            raise
        spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/batches/none")
        query = stream.writeStream.option("checkpointLocation", f"{folder}/updates").trigger(availableNow=True).outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batches/{n}")).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/batches")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
