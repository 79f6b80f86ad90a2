"""Counts that grow while documents arrive: the associative merge of shard counts as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave import functions as fn


def streaming_bigrams(docs: DataFrame, tags: str = "tags") -> DataFrame:
    """(w1, w2, freq) of a stream of documents with their tags; run it in update or complete mode."""
    pairs = docs.select(F.explode(fn.pairs_of(tags)).alias("p"))
    return pairs.groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("freq"))


def streaming_windows(events: DataFrame, ts: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, key, n): counts by tumbling window; rows later than the watermark are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), key, "n")


def run_available(df: DataFrame, keys: list[str], folder: str, checkpoint: str) -> DataFrame:
    """Process what is there and stop: changed rows of each batch go to ``folder``, the latest of each key is the result.

    Update mode keeps the watermark's rule (late rows are left out), and nothing
    is gathered on the driver. A batch that is run again replaces what it wrote.
    """
    spark, values = df.sparkSession, [c for c in df.columns if c not in keys]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{folder}/batch=-1")
    q = df.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
    q.awaitTermination()
    latest = spark.read.schema(df.schema.add("batch", "long")).parquet(folder).groupBy(*keys)
    return latest.agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
