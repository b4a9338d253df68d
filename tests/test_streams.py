"""Keyed run state, published results, and label matching."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from kadastra.operators import matching, volumes
from kadastra.streaming import runs


def events(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind = r.choice(["object", "text", "call"])
        out.append({"run": r.randrange(6), "stage": r.choice("345678"), "kind": kind, "zone_type": r.choice(["sub_zone", "plot", None]), "text": r.choice(["a", "b", "c", None]), "cost_usd": r.choice([0.1, 0.25, None])})
    return out


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def settled_totals(spark, folder):
    got = spark.read.parquet(str(folder)).filter("not closed")
    return {r.run: r[1:] for r in got.groupBy("run").agg(*(F.max(c).alias(c) for c in ("rank", "objects", "texts", "calls", "cost_usd"))).collect()}


def test_run_state_goes_on_after_a_stop(spark, tmp_path):
    """Three batches with a restart between them end where the batch over all ends."""
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.schema(runs.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = (
            runs.accumulate(stream).writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b{k}"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        assert q.exception() is None

    lines(tmp_path / "in/a.json", events(60, 1))
    run()
    lines(tmp_path / "in/b.json", events(40, 2))
    lines(tmp_path / "in/c.json", events(50, 3))
    run()
    batch = spark.read.schema(runs.EVENTS).json(str(tmp_path / "in"))
    want = {r.run: (r["rank"], r.objects, r.texts, r.calls, r.cost_usd) for r in runs.totals(batch).collect()}
    assert settled_totals(spark, tmp_path / "out/*") == want and len(want) == 6


def test_published_results_can_be_replayed(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(cp):
        stream = spark.readStream.schema(runs.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = runs.publish(stream, str(tmp_path / "out"), str(tmp_path / cp))
        q.awaitTermination(120)
        assert q.exception() is None

    lines(tmp_path / "in/a.json", events(50, 4))
    run("cp")
    shutil.copytree(tmp_path / "cp", tmp_path / "old")
    lines(tmp_path / "in/b.json", events(30, 5))
    run("cp")
    read = lambda: [tuple(r) for r in runs.latest(spark.read.parquet(f"{tmp_path}/out/lines")).collect()]
    first = read()
    run("old")  # the second batch once more, from the checkpoint before it
    assert read() == first
    want = {(r.run, r.stage): json.loads(r.line) for r in runs.results(spark.read.schema(runs.EVENTS).json(str(tmp_path / "in"))).collect()}
    got = {(r, s): json.loads(x) for r, s, _, x in first}
    assert got == want
    for k in {r for r, *_ in first}:
        own = [(s, json.loads(x)) for r, s, _, x in first if r == k]
        assert [s for s, _ in own] == sorted((s for s, _ in own), key="345678d".index if all(len(s) == 1 for s, _ in own) else lambda s: "345678".find(s) if s != "done" else 9)
        counts = [x["extracted_objects"] for _, x in own]
        assert counts == sorted(counts) and own[-1][0] == "done"
        assert all(sum(x["zone_summary"].values()) == x["extracted_objects"] for _, x in own)


def test_labels_stand_in_texts_by_force(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab c") for _ in range(r.randrange(n)))
    labels = [(k % 3, k, word(5)) for k in range(60)] + [(0, 100, None), (1, 101, "")]
    texts = [(k % 3, k, word(14)) for k in range(80)] + [(0, 200, None)]
    a = spark.createDataFrame(labels, "site int, label_id int, label string")
    b = spark.createDataFrame(texts, "site int, text_id int, text string")
    got = matching.stands_in(a, b, ["site"])
    rows = [tuple(x) for x in got.collect()]
    want = {(s, i, j) for s, i, x in labels for t, j, y in texts if s == t and x and y is not None and x in y}
    assert sorted(rows) == sorted(want) and len(want) > 50
    x = a.select("site", F.col("label_id").alias("id"), "label")
    y = b.select("site", F.col("text_id").alias("id"), F.col("text").alias("label"))
    both = {tuple(v) for v in matching.either_holds(x, y, ["site"]).collect()}
    assert both == {(s, i, j) for s, i, p in labels for t, j, q in texts if s == t and p and q and (p in q or q in p)}
    assert matching.stands_in(a.filter("false"), b, ["site"]).count() == 0


def test_programmes_by_label(spark):
    """A zone without a programme of its id takes the first whose label and its own are one in the other."""
    envs = spark.createDataFrame([(1, 1, "Blok A", 100.0), (1, 2, "blok b noord", 100.0), (1, 3, "Weide", 100.0), (1, 4, None, 100.0)], "site int, id long, label string, area double")
    p = spark.createDataFrame(
        [(1, 1, "tower", "office", 900.0, 30.0, 1, "x", 0), (1, 90, "infill", "retail", 500.0, 9.0, 0, "Blok B", 2), (1, 91, "villa", "residential", 400.0, 6.0, 0, "blok b", 1)],
        "site int, zone_id long, typology string, use string, target_gfa_m2 double, max_height_m double, parking_levels int, zone_label string, zone_index int",
    )
    limits = volumes.site_limits(spark.createDataFrame([(1, "height", "h", 12.0, 1)], "site int, category string, name string, value double, seq int"), ["site"])
    got = {r.id: (r.typology, r.target_gfa_m2, r.max_height_m) for r in volumes.with_targets(envs, p, limits, ["site"]).collect()}
    assert got == {1: ("tower", 900.0, 30.0), 2: ("villa", 400.0, 6.0), 3: (None, 150.0, 12.0), 4: (None, 150.0, 12.0)}
    plain = {r.id: r.typology for r in volumes.with_targets(envs, p.drop("zone_label", "zone_index"), limits, ["site"]).collect()}
    assert plain == {1: "tower", 2: None, 3: None, 4: None}


def test_zero_events(spark):
    none = spark.createDataFrame([], runs.EVENTS)
    assert runs.totals(none).count() == 0 and runs.results(none).count() == 0


@pytest.mark.parametrize("rows", [[(1, None, "object", None, None, None)], [(1, "9", "call", None, None, 1e-7)]])
def test_odd_events(spark, rows):
    d = spark.createDataFrame(rows, runs.EVENTS)
    assert runs.totals(d).first()["rank"] == 8 and {r.stage for r in runs.results(d).collect()} == {rows[0][1], "done"}
