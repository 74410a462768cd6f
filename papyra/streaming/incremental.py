"""Index maintenance as rows change, for batches and for Structured Streaming (foreachBatch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def index_batch(index: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The index after a batch: all rows of the batch's keys are replaced."""
    return index.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def replace_keys(index: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the keys of the changed ones go; the changed ones come in (also with emptied text)."""
    return index.join(changed, keys, "left_anti").unionByName(changed)


def maintain(stream: DataFrame, index_path: str, checkpoint: str, key: str = "doc_id"):
    """Starts a query that keeps a Parquet index of versions: every batch is appended under its batch number, readers take
    the last version of each key (current_index). Replayed batches overwrite themselves, so the index stays exact."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, index_path: str, key: str = "doc_id") -> DataFrame:
    """Rows of the last version of each key."""
    rows = spark.read.parquet(index_path).drop("batch")
    last = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(last, [key, "version"], "left_semi").drop("version")


#: Allowed transitions of an index job.
NEXT = {"missing": {"queued"}, "queued": {"building", "paused"}, "building": {"ready", "error", "paused"}, "paused": {"queued"}, "ready": {"queued"}, "error": {"queued"}}


def job_states(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """events (doc_id long, ts timestamp, state string) -> doc_id, state, applied, refused: the state of each job after its
    events, transitions that are not allowed refused. Works on streams (update mode) and keeps one small state a job."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("refused", T.IntegerType())])
    kept = T.StructType([T.StructField("state", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("refused", T.IntegerType())])

    def step(key, batches, group):
        state, applied, refused = group.get if group.exists else ("missing", 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for to in rows["state"]:
            if to in NEXT[state]:
                state, applied = to, applied + 1
            else:
                refused += 1
        group.update((state, applied, refused))
        yield pd.DataFrame({"doc_id": [key[0]], "state": [state], "applied": [applied], "refused": [refused]})

    return events.withWatermark("ts", watermark).groupBy("doc_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Tumbling counts by event type with late rows up to the watermark."""
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")
