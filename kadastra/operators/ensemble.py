"""From votes to the types of a page's shapes: prefilter, majority or judge, refinement, conflicts, hard rules.

Shapes are rows of ``keys``, ``id``, box, ``guess``, ``strategy``, ``realistic`` (boolean) and, from ``apply_votes``
on, ``zone_type`` (null: not told), ``confidence``, ``reason`` and ``artifact`` (boolean).  Model answers are input tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from . import votes
from .spatial import box_area, box_join, common_area, conflicts, containers
from .steps import settled

REBUILT = ["chain_join", "planar_face"]


def prefilter(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``local``: what can be told without votes (struct<zone_type, confidence>), null for those to vote on.
    ``shapes``: valid, aspect_ratio, area, page_area, compactness, has_label besides."""
    c = F.col
    return shapes.withColumn("local", classify.simple_class(c("valid"), c("aspect_ratio"), c("area"), c("page_area"), c("compactness"), c("has_label")))


def apply_votes(shapes: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """Valid verdicts (keys, id, zone_type, confidence, reason, agreement) on shapes; an artifact that was guessed to be a
    building, or was rebuilt from dashes, becomes a building of 0.70."""
    ok = judged.filter(F.col("zone_type").isin(*classify.VOTE_TYPES)).select(
        *keys, "id", F.col("zone_type").alias("v_type"), F.col("confidence").alias("v_conf"), F.col("reason").alias("v_reason"), F.col("agreement").alias("v_agree")
    )
    j = shapes.join(ok, [*keys, "id"], "left")
    out = F.col("v_type") == "artifact"
    house = (F.col("guess") == "building_candidate") | F.coalesce(F.col("strategy").isin(*REBUILT), F.lit(False))
    head = F.concat(F.lit("ensemble("), F.coalesce("v_agree", F.lit("unknown")), F.lit("): "))
    return j.select(
        *shapes.columns,
        F.when(out & house, "sub_zone").when(~out, F.col("v_type")).alias("zone_type"),
        F.when(out & house, F.lit(0.70)).when(~out, F.coalesce("v_conf", F.lit(0.8))).alias("confidence"),
        F.when(out & house, F.concat(head, F.lit("artifact overridden to sub_zone"))).when(~out, F.concat(head, F.coalesce("v_reason", F.lit("")))).alias("reason"),
        F.coalesce(out & ~house, F.lit(False)).alias("artifact"),
    )


def refined(judged: DataFrame, rounds: list[DataFrame], keys: list[str]) -> DataFrame:
    """Verdicts after at most that many refinement rounds: each replaces type, confidence and reason where it names a valid
    type; a round that changes no type is the last one looked at, so a key's later rounds are left."""
    out = judged
    open_keys = judged.select(*keys).distinct()
    for n, r in enumerate(rounds, 1):
        ok = r.filter(F.col("zone_type").isin(*classify.VOTE_TYPES)).join(open_keys, keys, "left_semi").select(
            *keys, "id", F.col("zone_type").alias("r_type"), F.col("confidence").alias("r_conf"), F.col("reason").alias("r_reason")
        )
        j = out.join(ok, [*keys, "id"], "left")
        hit = F.col("r_type").isNotNull()
        changed = j.filter(hit & (F.col("r_type") != F.col("zone_type"))).select(*keys).distinct()
        out = j.select(
            *keys, "id", F.coalesce("r_type", "zone_type").alias("zone_type"), F.coalesce("r_conf", "confidence").alias("confidence"),
            F.coalesce("r_reason", "reason").alias("reason"), F.when(hit, f"refine_{n}").otherwise(F.col("agreement")).alias("agreement"),
        )
        out, open_keys = settled(out), settled(changed)
    return out


def resolve(shapes: DataFrame, keys: list[str], size: float, answers: DataFrame | None = None) -> DataFrame:
    """Buildings that lie in each other: with ``answers`` (keys, id, zone_type, confidence) of a resolver those hold, and a
    building that holds one of under 0.70 of its size, and got no answer, becomes a plinth of 0.75; without, one whose inner
    buildings sum up to under 0.85 of it becomes a plinth of 0.70."""
    houses = shapes.filter("zone_type = 'sub_zone'").select(*keys, "id", "x0", "y0", "x1", "y1")
    inner = conflicts(houses, keys, size).filter("kind = 'containment'")
    sizes = houses.select(*keys, "id", box_area().alias("a"))
    inner = inner.join(sizes.select(*keys, F.col("id").alias("second_id"), F.col("a").alias("inner_area")), [*keys, "second_id"]).join(
        sizes.select(*keys, F.col("id").alias("first_id"), F.col("a").alias("outer_area")), [*keys, "first_id"]
    )
    held = inner.groupBy(*keys, F.col("first_id").alias("id")).agg(
        F.count("*").alias("n_inner"), (F.sum("inner_area") / F.max("outer_area")).alias("share"), F.min(F.round(F.col("inner_area") / F.col("outer_area"), 3)).alias("least")
    )
    j = shapes.join(held, [*keys, "id"], "left")
    n = F.col("n_inner").cast("string")
    if answers is None:
        hit = F.coalesce((F.col("zone_type") == "sub_zone") & (F.col("share") < 0.85), F.lit(False))
        told = F.when(hit, F.struct(F.lit("plinth").alias("t"), F.lit(0.70).alias("c"), F.concat(F.lit("rule_based_plinth: contains "), n, F.lit(" building(s)")).alias("r")))
    else:
        a = answers.select(*keys, "id", F.col("zone_type").alias("a_type"), F.coalesce("confidence", F.lit(0.85)).alias("a_conf"))
        j = j.join(a, [*keys, "id"], "left")
        valid = F.col("a_type").isin(*classify.VOTE_TYPES)
        hit = F.coalesce((F.col("zone_type") == "sub_zone") & F.col("a_type").isNull() & (F.col("least") < 0.70), F.lit(False))
        told = F.when(valid, F.struct(F.col("a_type").alias("t"), F.col("a_conf").alias("c"), F.concat(F.lit("conflict_resolved: "), F.coalesce("zone_type", F.lit("unknown")), F.lit(" to "), F.col("a_type")).alias("r"))).when(
            hit, F.struct(F.lit("plinth").alias("t"), F.lit(0.75).alias("c"), F.concat(F.lit("auto_plinth: contains "), n, F.lit(" building(s)")).alias("r"))
        )
    new = {"zone_type": "t", "confidence": "c", "reason": "r"}
    j = j.withColumn("told", told)
    return j.select(*(F.coalesce(F.col(f"told.{new[c]}"), F.col(c)).alias(c) if c in new else F.col(c) for c in shapes.columns))


def _set(df: DataFrame, hit, zone_type: str | None, confidence, reason: str, artifact: bool = False) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    cols = {
        "zone_type": F.when(hit, F.lit(zone_type)).otherwise(F.col("zone_type")),
        "confidence": F.when(hit, confidence).otherwise(F.col("confidence")),
        "reason": F.when(hit, F.concat(F.coalesce("reason", F.lit("")), F.lit(reason))).otherwise(F.col("reason")),
    }
    if artifact:
        cols["artifact"] = hit | F.col("artifact")
    return df.withColumns(cols)


def hard_rules(shapes: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Rules that hold whatever was voted, in this order: rebuilt shapes are buildings; too few buildings make all untold
    candidates buildings; an envelope without a building takes the realistic untold shapes in it of 0.01 to 0.95 of its
    size; buildings around buildings are plinths; buildings of no realistic shape are artifacts."""
    rebuilt = F.col("strategy").isin(*REBUILT) & F.col("zone_type").isNotNull() & (F.col("zone_type") != "sub_zone") & ~F.col("artifact")
    s = _set(shapes, rebuilt, "sub_zone", F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.70)), " [hard_rule: rebuilt]")
    before = s.select(*keys, "id", F.col("zone_type").alias("was"))
    net = votes.safety_net(s, keys).join(before, [*keys, "id"]).filter(F.col("was").isNull() & F.col("zone_type").isNotNull()).select(*keys, "id", F.lit(True).alias("forced"))
    s = _set(s.join(net, [*keys, "id"], "left"), F.col("forced"), "sub_zone", F.lit(0.65), "safety_net: unclassified building candidate").drop("forced")
    s = settled(s)

    centre = F.expr("x0 + x1 > 2 * r_x0 and x0 + x1 < 2 * r_x1 and y0 + y1 > 2 * r_y0 and y0 + y1 < 2 * r_y1")
    envelopes = s.filter("zone_type = 'buildable_envelope'").select(*keys, "id", "x0", "y0", "x1", "y1")
    built = s.filter("zone_type in ('sub_zone', 'plinth')").select(*keys, "id", "x0", "y0", "x1", "y1")
    taken = box_join(built, envelopes, keys, size, centre).select(*keys, F.col("r_id").alias("id")).distinct()
    empty = envelopes.join(taken, [*keys, "id"], "left_anti")
    free = s.filter("zone_type is null and not artifact and realistic").select(*keys, "id", "x0", "y0", "x1", "y1")
    share = box_area() / F.greatest(box_area("r_").cast("double"), F.lit(1.0))
    moved = box_join(free, empty, keys, size, centre & (F.col("id") != F.col("r_id"))).filter((share > 0.01) & (share < 0.95)).select(*keys, "id", F.lit(True).alias("forced")).distinct()
    s = _set(s.join(moved, [*keys, "id"], "left"), F.col("forced"), "sub_zone", F.lit(0.60), "hard_rule: compact polygon inside buildable_envelope").drop("forced")
    s = settled(s)

    houses = s.filter("zone_type = 'sub_zone'").select(*keys, "id", "x0", "y0", "x1", "y1")
    outer = containers(houses, keys, size).select(*keys, "id", F.lit(True).alias("forced"))
    s = _set(s.join(outer, [*keys, "id"], "left"), F.col("forced"), "plinth", F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.80)), " [plinth]").drop("forced")
    return _set(s, (F.col("zone_type") == "sub_zone") & ~F.col("realistic"), "artifact", F.col("confidence"), "", True)


def classified(
    shapes: DataFrame, ballots: DataFrame, keys: list[str], size: float, judge: DataFrame | None = None, rounds: list[DataFrame] | None = None,
    answers: DataFrame | None = None,
) -> DataFrame:
    """Shapes with their final type: told locally, else by the judge (by majority of the ``ballots``: keys, id, agent_rank,
    zone_type, without one), refined, freed of conflicts and under the hard rules."""
    local = prefilter(shapes)
    open_ = local.filter("local is null").drop("local")
    if judge is None:
        one = F.struct(*keys, "id")
        flat = ballots.withColumn("id", one)
        got = votes.majority(flat, open_.select(one.alias("id")))
        judge = got.select(*(F.col(f"id.{k}").alias(k) for k in keys), F.col("id.id").alias("id"), "zone_type", "confidence", "reason", "agreement")
    done = refined(settled(judge), rounds or [], keys)
    told = hard_rules(settled(resolve(settled(apply_votes(open_, done, keys)), keys, size, answers)), keys, size)
    simple = local.filter("local is not null").select(
        *shapes.columns, F.lit("artifact").alias("zone_type"), F.col("local.confidence").alias("confidence"), F.lit("local_filter").alias("reason"), F.lit(True).alias("artifact")
    )
    return reduce(DataFrame.unionByName, [told, simple])


def overlap_pairs(shapes: DataFrame, keys: list[str], size: float, share: float = 0.8) -> DataFrame:
    """(id, inner) pairs of shapes where ``share`` of the inner one lies in the other."""
    met = box_join(shapes, shapes, keys, size, F.col("id") != F.col("r_id"))
    return met.filter(common_area() > share * box_area("r_")).select(*keys, "id", F.col("r_id").alias("inner"))
