"""The append logs as streams: promotions that keep up with new edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.operators import edits
from penprint.storage import exists, remove

EDIT = "ord bigint, draft_id string, reviewed timestamp, classification string, observations array<struct<dimension:string,direction:string,evidence:string>>"


def edit_stream(spark: SparkSession, path: str, delay: str = "7 days") -> DataFrame:
    """New rows of the edit log; a row written twice within the delay is seen once."""
    rows = spark.readStream.schema(EDIT).json(path)
    valid = rows.filter(edits.valid_observations(rows))
    return valid.withWatermark("reviewed", delay).dropDuplicatesWithinWatermark(["draft_id", "ord"])


def daily_observations(stream: DataFrame) -> DataFrame:
    """Observations a day, dimension and direction, as a windowed aggregate over event time."""
    each = stream.select("reviewed", F.explode("observations").alias("o"))
    return each.groupBy(F.window("reviewed", "1 day"), "o.dimension", "o.direction").agg(F.count(F.lit(1)).alias("n"))


def promote_on_arrival(stream: DataFrame, state_path: str, out_path: str, checkpoint: str):
    """Start a query that keeps promotions up to date with each batch.

    The state is what each draft was first seen to do (edits.observed), a table a batch: a batch adds to the table before
    it, so the log isn't read again, and a batch that runs twice writes the same table.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = edits.observed(batch)
        before = f"{state_path}/{number - 1}"
        if number and exists(spark, before):
            seen = edits.earliest(seen.unionByName(spark.read.parquet(before)))
        seen.write.mode("overwrite").parquet(f"{state_path}/{number}")
        edits.promoted(spark.read.parquet(f"{state_path}/{number}")).write.mode("overwrite").parquet(out_path)
        if number > 1:
            remove(spark, f"{state_path}/{number - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
