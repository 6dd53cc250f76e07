"""The stateless operators on streams: the same column logic, row by row, so no watermark and no state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from pactlake.operators.stamping import read_stamped
from pactlake.operators.validation import as_record, flag_valid


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of one Parquet table of a folder, new files included."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def validate_stream(stream: DataFrame, contract, columns: list[str] | None = None) -> DataFrame:
    return flag_valid(as_record(stream, columns), "record", contract)


def read_stamped_stream(stream: DataFrame, envelope_col: str, versions: Mapping[int, object]) -> DataFrame:
    return read_stamped(stream, envelope_col, versions)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, then stop. A restart goes on where the checkpoint says."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
