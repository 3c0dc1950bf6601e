"""Change records as a stream: each micro-batch is applied as guarded batches by batch id.

Delivery may repeat; a batch id that was applied returns its stored report, so a restarted
query changes nothing twice.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import catalog

CHANGE = (
    "batch_id string, ordinal long, entity string, id string, expected string, values string, source_id string, collected_on string,"
    " status string, observation_id string, origin string, observation_digest string, review_reference string"
)


def read_changes(spark: SparkSession, folder: str, files_per_trigger=1) -> DataFrame:
    """JSON change records as they arrive in a folder; a batch id must not span files."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def start(stream: DataFrame, root: str, hold_list: DataFrame, checkpoint: str, on_report=None) -> StreamingQuery:
    """Apply arriving batches to the catalog under `root`; `on_report` receives each report."""

    def apply(rows: DataFrame, _epoch: int) -> None:
        spark = rows.sparkSession
        rows.persist()
        try:
            # The ids of the batches in this file, not their rows.
            named = rows.groupBy("batch_id").agg(F.min("ordinal").alias("first")).orderBy("batch_id").collect()
            for row in named:
                batch = rows.where(F.col("batch_id") == row["batch_id"]).drop("batch_id")
                report = catalog.apply_batch(spark, root, row["batch_id"], batch, hold_list, apply=True)
                if on_report:
                    on_report(report)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
