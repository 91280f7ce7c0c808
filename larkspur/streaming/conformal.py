"""Sequential conformal calibration as a stream: folds close one after the other, each once.

A micro-batch brings forecasts with the demand that came. Its scores and their counts by
bucket, a mergeable sketch, are written under the batch's number, so that a batch that runs again after a
failure replaces what it wrote. The adjustments of the targets behind the batch's folds then
follow from the counts of all batches so far; scores are read only from the buckets that hold a
rank, so results are those of the batch query. Late scores of an earlier fold change the targets after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.forecasting import adjustment_step, adjustments_from, conformal_scores
from larkspur.plans.steps import Step, shared_folder

#: Buckets to a doubling of a score's size; they ascend with the score.
PER_DOUBLING = 8
BUCKET = f"cast(case when score = 0 then 0 else signum(score) * greatest(1, floor(log2(abs(score)) * {PER_DOUBLING}) + {1100 * PER_DOUBLING}) end as int)"


def run(scored: DataFrame, folder: str, targets: tuple[int, ...], checkpoint: str, shrinkage: float = 30.0) -> StreamingQuery:
    """Start the stream over ``scored`` (model, origin, horizon, q10, q90, demand); state and results go
    below ``folder``. It takes what there is and ends."""

    def close(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scores = conformal_scores(batch).withColumn("cell", F.expr(BUCKET))
        scores.write.mode("overwrite").parquet(f"{folder}/scores/batch={number}")
        own = spark.read.parquet(f"{folder}/scores/batch={number}")
        own.groupBy("model", "horizon", "origin", "cell").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        first = own.agg(F.min("origin")).first()[0]
        later = tuple(t for t in targets if first is not None and t > first)
        if later:
            # Nothing of a later batch: one that runs again finds what it found before.
            celled, counts = (spark.read.parquet(f"{folder}/{part}").where(F.col("batch") <= number).drop("batch") for part in ("scores", "counts"))
            done = adjustments_from(celled, counts.groupBy("model", "horizon", "origin", "cell").agg(F.sum("n").alias("n")), later, shrinkage)
            done.write.mode("overwrite").parquet(f"{folder}/adjustments/batch={number}")

    return scored.writeStream.foreachBatch(close).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def adjustments(spark: SparkSession, folder: str) -> DataFrame:
    """The adjustments of each target as of the last batch that changed it."""
    rows = spark.read.parquet(f"{folder}/adjustments")
    last = rows.groupBy("target_origin").agg(F.max("batch").alias("_last")).withColumnRenamed("target_origin", "_target")
    return rows.join(F.broadcast(last), (F.col("target_origin") == F.col("_target")) & (F.col("batch") == F.col("_last"))).drop("_target", "_last", "batch")


def replay(scored: DataFrame, folder: str, origins: tuple[int, ...]) -> DataFrame:
    """``scored`` as a stream that brings the rows of one origin after the other, from files below ``folder``."""
    for k, origin in enumerate(sorted(origins)):
        scored.where(F.col("origin") == origin).coalesce(1).write.mode("overwrite").parquet(f"{folder}/fold={k}")
    return scored.sparkSession.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def streamed_step(origins: tuple[int, ...], targets: tuple[int, ...]) -> Step:
    """The adjustments of a replay of ``origins``; the batch's SELECT is the oracle."""

    def build(forecast: DataFrame, truth: DataFrame) -> DataFrame:
        spark, folder = forecast.sparkSession, f"{shared_folder(forecast.sparkSession)}/conformal-{uuid.uuid4().hex}"
        rows = forecast.join(truth.select("series_id", "date_idx", "demand"), ["series_id", "date_idx"]).select("model", "origin", "horizon", "q10", "q90", "demand")
        run(replay(rows, f"{folder}/in", origins), f"{folder}/out", targets, f"{folder}/checkpoint").awaitTermination()
        return adjustments(spark, f"{folder}/out")

    return Step(("forecast", "truth"), adjustment_step(targets).sql, build)
