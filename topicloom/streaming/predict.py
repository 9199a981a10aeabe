"""Prediction as a continuous job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from topicloom.operators.classifier import TopicModel
from topicloom.streaming.models import PublishedModels


def read_page_stream(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    file_format: str = "json",
    max_files: int | None = None,
) -> DataFrame:
    """New page files of a folder (or glob) as a stream; a single file is allowed too."""
    reader = spark.readStream.schema(schema).format(file_format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isFile():
        # The source watches folders; the name filter leaves this one file.
        reader = reader.option("pathGlobFilter", place.getName())
        path = str(place.getParent())
    return reader.load(path)


def stream_predict(
    pages: DataFrame,
    model: TopicModel | PublishedModels,
    output: str,
    checkpoint: str,
    page: str = "html",
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Start scoring a stream of pages into Parquet files, one folder per micro-batch.

    Every micro-batch is scored by ``predict_pages`` as a batch, so a model of any size will
    do. A batch that is repeated after a failure replaces its own folder: each page file is
    scored exactly once in the output.

    With published models the pointer is read at each micro-batch: a model published while the
    stream runs is taken up by the next one, without a restart. Every row then has the
    version of its model as ``modelVersion``.
    """

    def score(batch: DataFrame, number: int) -> None:
        if isinstance(model, PublishedModels):
            version, newest = model.latest()
            scored = newest.predict_pages(batch, page).withColumn("modelVersion", F.lit(version))
        else:
            scored = model.predict_pages(batch, page)
        scored.write.mode("overwrite").parquet(f"{output}/batch={number}")

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        pages.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
