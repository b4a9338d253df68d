"""Votes of several agents about shapes: merging, overrides and safety rules.  Votes are input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import VOTE_TYPES


def majority(votes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a shape: the commonest type, ties to the first agent; confidence 0.6 + 0.3 * share.

    ``votes``: id, agent_rank, zone_type (one row an agent).  ``ids`` adds shapes nobody voted on as unknown."""
    n = votes.groupBy("id", "zone_type").agg(F.count("*").alias("n"), F.min("agent_rank").alias("first"))
    won = n.groupBy("id").agg(F.sum("n").alias("total"), F.max_by(F.struct("zone_type", "n"), F.struct("n", -F.col("first"))).alias("w"))
    out = won.select(
        "id",
        F.col("w.zone_type").alias("zone_type"),
        F.round(0.6 + F.col("w.n") / F.col("total") * 0.3, 2).alias("confidence"),
        F.concat(F.lit("majority_vote ("), F.col("w.n").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")")).alias("reason"),
        F.when(F.col("w.n") >= 2, "majority").otherwise("judge_call").alias("agreement"),
    )
    if ids is None:
        return out
    return ids.select("id").join(out, "id", "left").select(
        "id", F.coalesce("zone_type", F.lit("unknown")).alias("zone_type"), F.coalesce("confidence", F.lit(0.3)).alias("confidence"),
        F.coalesce("reason", F.lit("no agent data")).alias("reason"), "agreement",
    )


def override(base: DataFrame, votes: DataFrame) -> DataFrame:
    """Types of ``base`` (id, zone_type, confidence) replaced by valid votes on the same id; an artifact vote on a
    building candidate becomes a building of 0.70."""
    ok = votes.filter(F.col("zone_type").isin(*VOTE_TYPES)).select("id", F.col("zone_type").alias("v_type"), F.col("confidence").alias("v_conf"))
    j = base.join(ok, "id", "left")
    veto = (F.col("v_type") == "artifact") & (F.col("guess") == "building_candidate")
    return j.select(
        "id",
        F.when(veto, "sub_zone").otherwise(F.coalesce("v_type", "zone_type")).alias("zone_type"),
        F.when(veto, F.lit(0.70)).otherwise(F.coalesce("v_conf", "confidence")).alias("confidence"),
    )


def sure_counts(votes: DataFrame, least: float = 0.90) -> DataFrame:
    """Distinct shapes that any agent is sure of, by type."""
    return votes.filter(F.col("confidence") >= least).groupBy("zone_type").agg(F.count_distinct("id").alias("n_ids"))


def safety_net(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Untyped building candidates become buildings where fewer than half of the candidates (two at least) are.

    ``shapes``: keys, id, zone_type (may be null), guess, artifact.  The counts are one small row a key."""
    cand = F.col("guess") == "building_candidate"
    counts = shapes.groupBy(*keys).agg(
        F.count_if(F.col("zone_type") == "sub_zone").alias("found"), F.greatest(F.floor(F.count_if(cand) * 0.5), F.lit(2)).alias("least")
    )
    return shapes.join(counts, keys).select(
        *keys,
        "id",
        F.when(F.col("zone_type").isNull() & cand & ~F.col("artifact") & (F.col("found") < F.col("least")), "sub_zone")
        .otherwise(F.col("zone_type")).alias("zone_type"),
    )


def refine(rounds: DataFrame) -> DataFrame:
    """The last of the refinement rounds (id, round, zone_type, confidence) that says something about a shape."""
    return rounds.filter(F.col("zone_type").isin(*VOTE_TYPES)).groupBy("id").agg(
        F.max_by("zone_type", "round").alias("zone_type"), F.max_by("confidence", "round").alias("confidence"), F.max("round").alias("round")
    )
