"""Runs as streams: a keyed state that adds up what a run has brought, and full results published batch by batch.

Events are rows of ``run``, ``stage``, ``kind`` (object, text, call), ``zone_type``, ``text``, ``cost_usd``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .progress import stage_rank

EVENTS = "run long, stage string, kind string, zone_type string, text string, cost_usd double"
TOTALS = "run long, rank int, objects long, texts long, calls long, cost_usd double, closed boolean"
_STATE = "rank int, objects long, seen array<binary>, calls long, cost_micro long"


def _micro(cost: pd.Series) -> int:
    """Millionths of a dollar, so that sums are the same in any order."""
    return int((cost.fillna(0.0) * 1e6).round().astype("int64").sum())


def totals(events: DataFrame) -> DataFrame:
    """What the stream ends with, as a batch: objects, distinct texts, calls and cost of each run, and how far it got."""
    o, t, c = (F.col("kind") == k for k in ("object", "text", "call"))
    micro = F.sum(F.when(c, F.round(F.coalesce("cost_usd", F.lit(0.0)) * 1e6).cast("long")).otherwise(0))
    return events.groupBy("run").agg(
        F.max(stage_rank(F.col("stage"))).alias("rank"), F.count_if(o).alias("objects"), F.count_distinct(F.when(t, F.coalesce("text", F.lit("")))).alias("texts"),
        F.count_if(c).alias("calls"), (micro / 1e6).alias("cost_usd"),
    )


def accumulate(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of ``TOTALS`` in update mode: with every batch the new totals of the runs that it touches.

    The state of a run is its counts, its cost in millionths and 16 bytes for each distinct text; it lives in the query's
    checkpoint, so a restart goes on where it stopped.  With ``idle_ms`` a run without events for so long is told once
    more, as closed, and its state goes; a query with it runs until it is stopped."""
    last = F.col("_rank")
    events = events.withColumn("_rank", stage_rank(F.col("stage")))
    names = [x.split()[0] for x in TOTALS.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, objects, seen, calls, micro = state.get if state.exists else (0, 0, [], 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], rank, objects, len(seen), calls, micro / 1e6, True)], columns=names)
            return
        known = {bytes(x) for x in seen}
        for p in parts:
            rank = max(rank, int(p["_rank"].max()))
            objects += int((p["kind"] == "object").sum())
            known.update(hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in p.loc[p["kind"] == "text", "text"])
            own = p[p["kind"] == "call"]
            calls, micro = calls + len(own), micro + _micro(own["cost_usd"])
        state.update((rank, objects, sorted(known), calls, micro))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], rank, objects, len(known), calls, micro / 1e6, False)], columns=names)

    return events.select("run", "kind", "text", "cost_usd", last).groupBy("run").applyInPandasWithState(
        step, TOTALS, _STATE, "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def results(events: DataFrame) -> DataFrame:
    """run, stage, rank and ``line``: one full result a run and stage it has reached, each standing for the former ones.

    The line has the run, the stage, and of all events up to it: extracted_objects, zone_summary (objects by type),
    extracted_text (distinct), cost_summary (calls, cost).  The last line of a run is the stage ``done``."""
    rank = stage_rank(F.col("stage"))
    e = events.withColumn("rank", rank)
    done = e.select("run").distinct().select("run", F.lit("done").alias("stage"))
    at = e.select("run", "stage").distinct().unionByName(done).distinct().withColumn("rank", rank)
    # stages are few: what each brought is summed first, then added up over those before it
    last = stage_rank(F.lit("done"))
    o = e.filter("kind = 'object'").groupBy("run", "rank", F.coalesce("zone_type", F.lit("unknown")).alias("zone_type")).agg(F.count("*").alias("n"))
    t = e.filter("kind = 'text'").groupBy("run", F.coalesce("text", F.lit("")).alias("text")).agg(F.min("rank").alias("rank"))
    t = t.groupBy("run", "rank").agg(F.count("*").alias("texts"))
    c = e.filter("kind = 'call'").groupBy("run", "rank").agg(F.count("*").alias("calls"), F.sum(F.round(F.coalesce("cost_usd", F.lit(0.0)) * 1e6).cast("long")).alias("micro"))

    def upto(df: DataFrame) -> DataFrame:
        past = df.withColumnRenamed("rank", "r")
        return at.select("run", "rank").distinct().join(past, "run").filter((F.col("r") <= F.col("rank")) | (F.col("rank") == last))

    zones = upto(o).groupBy("run", "rank", "zone_type").agg(F.sum("n").alias("n")).groupBy("run", "rank").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone_type", "n")))).alias("zone_summary"), F.sum("n").alias("extracted_objects")
    )
    texts = upto(t).groupBy("run", "rank").agg(F.sum("texts").alias("extracted_text"))
    calls = upto(c).groupBy("run", "rank").agg(F.sum("calls").alias("calls"), (F.sum("micro") / 1e6).alias("cost"))
    j = at.join(zones, ["run", "rank"], "left").join(texts, ["run", "rank"], "left").join(calls, ["run", "rank"], "left")
    line = F.struct(
        F.lit("success").alias("status"), "run", F.col("stage").alias("node"), F.coalesce("extracted_objects", F.lit(0)).alias("extracted_objects"),
        F.coalesce("zone_summary", F.create_map().cast("map<string,bigint>")).alias("zone_summary"), F.coalesce("extracted_text", F.lit(0)).alias("extracted_text"),
        F.struct(F.coalesce("calls", F.lit(0)).alias("total_calls"), F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("estimated_cost_usd")).alias("cost_summary"),
    )
    return j.select("run", "stage", "rank", F.to_json(line).alias("line"))


def publish(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the results of the runs that a batch touches, batch by batch, under ``folder``.

    Each batch has a folder of its own for its events and one for its lines, both overwritten, so a batch that is run again
    after a failure leaves what it left before; its lines come from the events of all batches up to it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        mine = spark.read.parquet(f"{folder}/events").filter(F.col("batch") <= number)
        touched = mine.filter(F.col("batch") == number).select("run").distinct()
        results(mine.drop("batch").join(touched, "run", "left_semi")).write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(lines: DataFrame) -> DataFrame:
    """Of the published lines (with their batch) the newest of each run and stage, in the order of the stages."""
    return lines.groupBy("run", "stage").agg(F.max_by(F.struct("rank", "line"), "batch").alias("x")).select("run", "stage", "x.rank", "x.line").orderBy("run", "rank")
