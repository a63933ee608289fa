from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thalweg.functions import labels
from thalweg.operators import classes, near_images
from thalweg.plans import classify
from thalweg.sources.adapters import predict

NAMES = ["corals", "macroalgae", "rubble", "sand", "seagrass"]


def test_smoothing(spark):
    rows = [([1.0, 0.0], 0, "A"), ([1.0, 0.0], 1, "A"), ([0.0, 1.0], 2, "A"), ([1.0, 0.0], 3, "A"), ([1.0, 0.0], 4, "A"), ([0.0, 1.0], 2, "B")]
    df = spark.createDataFrame([(i, p, t * 1_000_000, g) for i, (p, t, g) in enumerate(rows)], "id int, probs array<double>, t long, recording string")
    got = {r.id: r.probs for r in classes.smooth(df, 2, 3.0).collect()}
    assert got[2] == pytest.approx([2 / 3, 1 / 3]) and got[0] == [1, 0] and got[5] == [0, 1]
    assert classes.smooth(df, 2, 0.0) is df


def test_labels(spark):
    df = spark.createDataFrame([([0.1, 0.6, 0.3],), ([0.4, 0.4, 0.2],), ([1.0, 0.0, 0.0],)], "p array<double>")
    n = ["a", "b", "c"]
    got = df.select(labels.label(n, F.col("p"), 0.45).alias("l"), labels.margin(F.col("p")).alias("m"), labels.text(n, F.col("p")).alias("t")).collect()
    assert [r.l for r in got] == ["b", "uncertain", "a"] and got[0].m == pytest.approx(0.3)
    assert got[1].t == "a 0.400, b 0.400, c 0.200"
    with pytest.raises(ValueError):
        labels.views("sideways")
    assert spark.range(1).select(labels.margin(F.array(F.lit(0.7))).alias("m")).first().m == 0.7


def test_frames_with_stub_model(spark):
    start = datetime(2025, 5, 13, 1)
    frames = [(f"f{k}", f"frame_{k}.jpg", "v", "G", "ok", start + timedelta(seconds=5 * k)) for k in range(5)] + [("x", "x.jpg", "v", "G", "gps_gap", start)]
    fr = spark.createDataFrame(frames, "frame_id string, frame_filename string, parent string, recording string, status string, ts_utc timestamp")

    def load():
        def model(paths, view):
            second = [5 * int(p[1:]) for p in paths]
            return [[0.1, 0.2, 0.2, 0.3, 0.2] if s == 5 else [0.01, 0.01, 0.01, 0.02, 0.95] if s % 2 == 0 else [0.02, 0.02, 0.02, 0.9, 0.04] for s in second]

        return model

    p = predict(fr.select("frame_id", F.col("frame_id").alias("path")).where("frame_id <> 'x'"), load, "none", 2)
    got = classify.classify_frames(fr, p, NAMES, conf=0.5)
    assert {r.benthic_class: r.n for r in classify.summary(got).collect()} == {"seagrass": 3, "sand": 1, "uncertain": 1}
    smooth = {r.frame_id: r for r in classify.classify_frames(got, p, NAMES, conf=0.4, smooth_s=12).collect()}
    assert [smooth[f"f{k}"].raw_class for k in range(5)] == ["seagrass", "uncertain", "seagrass", "sand", "seagrass"]
    assert [smooth[f"f{k}"].benthic_class for k in range(5)] == ["seagrass", "seagrass", "sand", "seagrass", "seagrass"]
    assert smooth["f1"].prob_seagrass == pytest.approx((0.95 + 0.2 + 0.95) / 3, abs=1e-4) and smooth["x"].benthic_class is None


def test_evaluation(spark):
    rows = [("a", "seagrass", "seagrass")] * 2 + [("seagrass_wrong.jpg", "seagrass", "sand"), ("s", "sand", "sand")] + [("c", "corals", "corals")] * 2
    out = classify.evaluate(spark.createDataFrame(rows, "image string, truth string, predicted string"), NAMES)
    r = out["overall"].first()
    assert r.accuracy == pytest.approx(0.8333) and r.macro_f1 == pytest.approx((0.8 + 0.6667 + 1) / 3, abs=1e-4)
    per = {x["class"]: x for x in out["per_class"].collect()}
    assert (per["seagrass"].precision, per["seagrass"].recall, per["seagrass"].f1, per["seagrass"].support) == (1.0, 0.6667, 0.8, 3) and per["rubble"].support == 0
    assert [x.image for x in out["misclassified"].collect()] == ["seagrass_wrong.jpg"]
    assert out["confusion"].count() == 25
    with pytest.raises(ValueError, match="kelp"):
        classify.evaluate(spark.createDataFrame([("k", "kelp", "sand")], "image string, truth string, predicted string"), NAMES)


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 2**32))
def test_near_images_match_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(120):
        h = rng.getrandbits(64) if i < 20 else rows[rng.randrange(20)][2]
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, rng.choice(["train", "test", "valid"]), h))
    signed = [(i, s, h - (1 << 64) if h >> 63 else h) for i, s, h in rows]
    want = {(a[0], b[0], bin(a[2] ^ b[2]).count("1")) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] != b[1] and bin(a[2] ^ b[2]).count("1") <= 4}
    pairs = near_images.near_pairs(spark.createDataFrame(signed, "id int, split string, h long"), 4)
    assert sorted((r.id_a, r.id_b, r.distance) for r in pairs.collect()) == sorted(want)


def test_near_images_broadcast_nothing(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("split"), (F.col("id") % 500 * 77_777_777_777).alias("h"))
    pairs = near_images.near_pairs(rows, 4)
    assert pairs.count() > 0
    for made in (pairs, near_images.involved(pairs), near_images.pair_counts(pairs)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_images_places_deal_out_one_distance(spark):
    pairs = spark.range(4000).select((F.col("id") % 400).alias("id_a"), (1000 + F.col("id")).alias("id_b"), (F.col("id") % 2).cast("int").alias("distance"))
    placed = near_images.by_distance(pairs)
    want = sorted((r.distance, r.id_a, r.id_b) for r in pairs.collect())
    assert [(r.distance, r.id_a, r.id_b) for r in sorted(placed.collect(), key=lambda r: r.place)] == want and placed.agg(F.max("place")).first()[0] == 4000
    assert "CASE WHEN (nearness" in placed._jdf.queryExecution().optimizedPlan().toString()


def test_gradient_hash(spark):
    cells = [float(x) for row in range(8) for x in ([0, 1] * 5)[:9]]
    h = spark.createDataFrame([(cells,)], "c array<double>").select(labels.gradient_hash(F.col("c")).alias("h")).first().h
    assert h & 0xFF == 0b10101010 and h < 0
