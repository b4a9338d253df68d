"""Progress of runs as a stream: every event replaces what was known (complete mode)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Order of the stages within a run; unknown stages come last.
STAGES = ["3", "4", "5", "6", "7", "8", "done"]


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events of each key and how far it got; works on a batch and, in complete mode, on a stream."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 2).alias("total")
    )


def stage_rank(stage: Column) -> Column:
    """Place of a stage in ``STAGES``; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), stage.cast("string"))
    return F.when(at > 0, at).otherwise(len(STAGES) + 1).cast("int")


def snapshots(objects: DataFrame, keys: list[str], stage: str = "stage") -> DataFrame:
    """One JSON line a key and stage with counts by type of all objects up to the stage, so each line stands for the
    former ones; the last line of a key is the stage ``done``.  Stages are few, so a key's are paired with each other."""
    rank = stage_rank(F.col(stage))
    per = objects.withColumn("rank", rank).groupBy(*keys, "rank", stage, "zone_type").agg(F.count("*").alias("n"))
    runs = per.select(*keys).distinct().select(*keys, F.lit("done").alias(stage)).withColumn("rank", stage_rank(F.col(stage)))
    at = per.select(*keys, stage, "rank").unionByName(runs).distinct()
    past = per.select(*keys, F.col("rank").alias("r"), "zone_type", "n")
    last = stage_rank(F.lit("done"))
    upto = at.join(past, keys).filter((F.col("r") <= F.col("rank")) | (F.col("rank") == last))
    total = upto.groupBy(*keys, stage, "rank", "zone_type").agg(F.sum("n").alias("n")).groupBy(*keys, stage, "rank").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone_type", "n")))).alias("counts"), F.sum("n").alias("total")
    )
    return total.select(*keys, stage, "rank", "total", F.to_json(F.struct(*keys, stage, "total", "counts")).alias("line"))


def write_ndjson(df: DataFrame, path: str, drop: list[str] | None = None) -> None:
    """JSON lines without internal columns (a leading underscore) or those named."""
    df.drop(*(c for c in df.columns if c.startswith("_")), *(drop or [])).write.mode("overwrite").json(path)


def follow(spark: SparkSession, folder: str, schema: str, keys: list[str], name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Reads JSON lines as they arrive and keeps the progress in an in-memory table of that name; with ``checkpoint``, a
    folder that all executors see, a restart goes on where it stopped."""
    stream = spark.readStream.schema(schema).json(folder)
    w = progress(stream, keys).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
