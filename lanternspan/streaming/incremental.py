"""Incremental runs: new files only, each id once, results and error rows to two sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_available(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str, id: str = "record_id") -> StreamingQuery:
    """Process the JSON files not yet seen, then stop. step: rows -> (results, errors).

    The checkpoint remembers files, so a restart goes on where the last run ended, and the ids of earlier batches are
    kept beside the results; a batch's folder is overwritten, so a batch that is repeated after a failure isn't written twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        from pyspark.errors import AnalysisException

        try:  # what earlier batches have written, so that no state grows with the number of ids
            done = spark.read.schema(f"{id} string, batch int").json(f"{out}/ids").where(F.col("batch") < n)
            batch = batch.join(done.select(id).distinct(), id, "left_anti")
        except AnalysisException:
            pass
        batch = batch.dropDuplicates([id]).persist()
        batch.select(id).write.mode("overwrite").json(f"{out}/ids/batch={n}")
        rows, errors = step(batch)
        rows.write.mode("overwrite").json(f"{out}/rows/batch={n}")
        errors.write.mode("overwrite").json(f"{out}/errors/batch={n}")
        batch.unpersist()

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
