"""Incremental decisions: route query files as they arrive, each query once.

The unit of work is the resume step of the batch code: earlier valid decisions stay, only the
rest is routed, and every new decision goes to an append-only log with its source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalbox.sources.tables import still_open

DECISION_SCHEMA = "id BIGINT, pred_model STRING, decision_source STRING"


def route_stream(
    spark: SparkSession,
    query_folder: str,
    log_folder: str,
    checkpoint: str,
    router: Callable[[DataFrame], DataFrame],
    models: Sequence[str],
    schema: str = "id BIGINT, query STRING",
) -> StreamingQuery:
    """Route all files present in ``query_folder`` and stop; call again when more arrive.

    A batch writes to a folder named after it and overwrites that folder, so a batch replayed
    after a failure does not log its decisions twice.
    """
    arriving = spark.readStream.schema(schema).json(query_folder)

    def route(batch: DataFrame, epoch: int) -> None:
        earlier = earlier_decisions(spark, log_folder, skip=epoch)
        fresh = still_open(batch.dropDuplicates(["id"]), earlier, models)
        routed = router(fresh).select("id", "pred_model", F.lit("router").alias("decision_source"))
        routed.write.mode("overwrite").json(f"{log_folder}/batch={epoch}")

    return (
        arriving.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def earlier_decisions(spark: SparkSession, log_folder: str, skip: int | None = None) -> DataFrame:
    """Decisions logged so far, without those of batch ``skip``."""
    try:
        log = spark.read.schema(DECISION_SCHEMA + ", batch BIGINT").json(log_folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DECISION_SCHEMA)
    if skip is not None:
        log = log.where(F.col("batch") != skip)
    return log.select("id", "pred_model", "decision_source")
