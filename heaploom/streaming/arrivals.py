"""Dumps that arrive in a folder, imported as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import Precision
from ..sources.catalog import Catalog
from ..sources.jsonl import _parsed, last_wins, validate


def import_arrivals(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, precision: Precision | str = Precision.MEDIUM) -> StreamingQuery:
    """Import every .jsonl file that appears in ``folder`` as a dump of its name, numbered if another file has that name.

    The stream's checkpoint remembers which files were read.  A batch that is run again after a failure finds the dumps
    it had published and goes on with the others.
    """
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").load(folder).select("value", F.col("_metadata.file_path").alias("path"))

    def import_batch(batch: DataFrame, _: int) -> None:
        numbered = batch.withColumn("_line", F.monotonically_increasing_id()).persist()
        for row in numbered.select("path").distinct().collect():
            own = numbered.where(F.col("path") == row["path"]).drop("path")
            catalog.import_once(last_wins(validate(_parsed(own)), ["_line"]), row["path"], precision)
        numbered.unpersist()

    return lines.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
