"""Contact dedup over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import contacts as O
from ..session import exists


def run(found: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Dedup of the stream `found`, run until it has no new rows; the contacts as they are then, none if nothing came.

    The state store holds one row for each contact. Each batch writes the
    contacts it changed to its own folder, so a batch that is run again replaces
    what it wrote, and a restart continues from folder/state.
    """

    def changed(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    rows = O.dedup(found, order)
    stream = rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
    stream.trigger(availableNow=True).foreachBatch(changed).start().awaitTermination()
    return latest(found.sparkSession, folder, rows.schema)


def latest(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Of each contact the row that the last batch to change it wrote."""
    if not exists(spark, f"{folder}/changes"):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{folder}/changes")
    rest = [c for c in rows.columns if c not in (*O.KEY, "batch")]
    last = rows.groupBy(*O.KEY).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*O.KEY, "r.*")
