import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from thalweg.functions import clock, geo, names
from thalweg.operators import asof, recordings, track
from thalweg.plans import survey
from thalweg.sources import gpx

S = 1_000_000


def brute(points, x, gap):
    ts = [p[0] for p in points]
    i = sum(t <= x for t in ts)
    if i == len(ts) and ts and x == ts[-1]:
        i -= 1
    if i == 0:
        return "before_track", None, None
    if i >= len(ts):
        return "after_track", None, None
    a, b = points[i - 1], points[i]
    if b[0] - a[0] > gap:
        return "gps_gap", None, None
    r = (x - a[0]) / (b[0] - a[0])
    depth = a[2] if b[2] is None else b[2] if a[2] is None else a[2] + r * (b[2] - a[2])
    return "ok", a[1] + r * (b[1] - a[1]), depth


def test_asof_matches_brute_force(spark):
    rng = random.Random(1)
    tracks, probes, want = [], [], {}
    for k, size in enumerate((0, 1, 2, 30, 60)):
        points, t = [], -500 * S
        for _ in range(size):
            t += rng.choice([1, 5, 10, 59, 60, 61, 200]) * S
            points.append((t, rng.uniform(-90, 90), rng.choice([None, rng.uniform(0, 9)])))
        tracks += [(f"t{k}", *p) for p in points]
        xs = [p[0] for p in points] + [rng.randrange(-700, t // S + 100) * S for _ in range(80)] if points else [0]
        for n, x in enumerate(xs):
            probes.append((f"t{k}", k * 1000 + n, x))
            want[k * 1000 + n] = brute(points, x, 60 * S)
    tr = spark.createDataFrame([(a, t, y, 0.0, d) for a, t, y, d in tracks], "track_id string, t long, lat double, lon double, depth double")
    out = asof.interpolate(spark.createDataFrame(probes, "track_id string, id long, t long"), tr, 60.0)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = out.collect()
    assert len(got) == len(probes)
    for r in got:
        status, lat, depth = want[r.id]
        assert r.status == status
        assert r.lat == pytest.approx(lat) and r.depth == pytest.approx(depth)


def test_names(spark):
    rows = [("GH010123", "GH0123", 1), ("gx020123", "GX0123", 2), ("GOPR0123", "GOPR0123", 0), ("GP010123", "GOPR0123", 1), ("GP020123", "GOPR0123", 2), ("clip", "clip", 0)]
    df = spark.createDataFrame(rows, "stem string, r string, c int")
    for r in df.select("*", names.recording_key(F.col("stem")).alias("k")).collect():
        assert (r.k.recording, r.k.chapter) == (r.r, r.c)
    files = spark.createDataFrame([("p", f"p/{s}.MP4", s) for s in ("GP020123", "GOPR0123", "GP010123")], "parent string, path string, stem string")
    (g,) = recordings.group_chapters(files).collect()
    assert [c.path for c in g.chapters] == ["p/GOPR0123.MP4", "p/GP010123.MP4", "p/GP020123.MP4"]
    t = 1747126800 * S + 7_999
    one = spark.range(1).select(names.frame_name(F.lit(t), 1).alias("a"), names.frame_name(F.lit(t), 0.5).alias("b"), names.local_tag(F.lit("{http://x}TrkPt")).alias("c"), names.setting_label(F.lit(" my-key 2 ")).alias("d"), names.parent_folder(F.lit("a/b/c.jpg")).alias("e"))
    assert tuple(one.first()) == ("frame_2025-05-13_09-00-00.jpg", "frame_2025-05-13_09-00-00_007.jpg", "trkpt", "MY_KEY_2", "a/b")


def test_positions(spark):
    df = spark.createDataFrame([(-14.123456, 121.654321)], "lat double, lon double")
    r = df.select(geo.from_dms(geo.dms(F.col("lat")), F.col("lat") < 0).alias("a"), geo.from_dms(geo.dms(F.col("lon")), F.lit(False)).alias("b"), geo.description(F.lit(3.456)).alias("d"), geo.with_class(F.lit("x; benthic class sand"), F.lit("rubble")).alias("c")).first()
    assert r.a == pytest.approx(-14.123456, abs=1e-7) and r.b == pytest.approx(121.654321, abs=1e-7)
    assert r.d == "benthic survey frame; echosounder depth 3.46 m" and r.c == "x; benthic class rubble"
    z = spark.createDataFrame([(datetime(2025, 5, 13, 9),)], "t timestamp_ntz").select(clock.local_to_utc(F.col("t"), "Asia/Manila").alias("u"), clock.iso_with_offset(F.col("t"), "America/St_Johns").alias("i")).first()
    assert z.u == datetime(2025, 5, 13, 1) and z.i == "2025-05-13T09:00:00-02:30"


def test_merge_and_summary(spark):
    schema = "t long, lat double"
    a = spark.createDataFrame([(2 * S, 1.0), (1 * S, 1.0)], schema)
    b = spark.createDataFrame([(2 * S, 9.0), (5 * S, 9.0)], schema)
    assert sorted((r.t, r.lat) for r in track.merge([a, b]).collect()) == [(1 * S, 1.0), (2 * S, 1.0), (5 * S, 9.0)]
    tr = track.merge([a, b]).withColumn("track_id", F.lit("m")).withColumn("depth", F.lit(None).cast("double"))
    s = track.summary(tr).first()
    assert (s.points, s.points_with_depth, s.median_interval_s) == (3, 0, 2.0)


GPX = """<gpx xmlns="http://x" xmlns:e="http://y"><trk><trkseg>
<trkpt lat="14.5" lon="121.0"><time>2025-05-13T01:00:00Z</time></trkpt>
<trkpt lat="14.502" lon="121.002"><time>2025-05-13T01:00:20</time><extensions><e:depth>bad</e:depth><e:x><e:Depth>6.0</e:Depth></e:x></extensions></trkpt>
<trkpt lat="14.501" lon="121.001"><time>2025-05-13T01:00:10Z</time><depth>5.0</depth></trkpt>
<trkpt lat="0" lon="0"></trkpt></trkseg></trk></gpx>"""


def test_survey(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gpx").write_text(GPX)
    tr = gpx.read_gpx(spark, str(tmp_path / "in"))
    assert [(r.lat, r.depth) for r in tr.orderBy("t").collect()] == [(14.5, None), (14.501, 5.0), (14.502, 6.0)]
    tr = tr.drop("track_id")
    files = spark.createDataFrame([("v", "v/GH010001.MP4", "GH010001", datetime(2025, 5, 13, 9), 25.0)], "parent string, path string, stem string, start_local timestamp_ntz, duration_s double")
    frames = survey.process(files, [tr], interval_s=5.0)
    survey.write(frames, str(tmp_path / "out"), {"interval_s": 5})
    r = spark.read.json(str(tmp_path / "out/report")).first()
    assert r.status_counts.ok == 5 and r.frames == 5
    rows = spark.read.parquet(str(tmp_path / "out/frames")).orderBy("frame_filename").collect()
    assert [(x.frame_filename, x.depth_m) for x in rows][:2] == [("frame_2025-05-13_09-00-00.jpg", 5.0), ("frame_2025-05-13_09-00-05.jpg", 5.0)]
    assert rows[0].frame_datetime == "2025-05-13T09:00:00+08:00" and rows[4].depth_m == 6.0
    seen = survey.inspect(files, [tr])
    assert seen["overlap"].first().note == "partial" and seen["track"].first().points == 3
    with pytest.raises(ValueError, match="start time"):
        survey.process(files.withColumn("start_local", F.lit(None).cast("timestamp_ntz")), [tr])
    with pytest.raises(ValueError, match="inside"):
        survey.check_output("/a", "/a/b")


def test_geojson_numbers_as_in_sql(spark):
    import duckdb

    from thalweg.operators import reports

    x = [0.0, -0.0005, 0.0001, 5e-05, 1.25e-05, 9999999.5, 1e7, 12345678.1234567, -98765432.0000001, 1e15, 1.5e16, 1e17, 0.1, 300.0]
    want = [r[0] for r in duckdb.sql(f"SELECT unnest({x}::DOUBLE[])::VARCHAR").fetchall()]
    rows = [("ok", v, v, 'a"b', v) for v in x] + [("ok", None, 1.0, None, float("nan")), ("gps_gap", 1.0, 1.0, "", 1.0)]
    got = reports.geojson_features(spark.createDataFrame(rows, "status string, latitude double, longitude double, note string, depth double").coalesce(1)).collect()
    made = ['{"type":"Feature","geometry":{"type":"Point","coordinates":[%s,%s]},"properties":{"status":"ok","note":"a\\"b","depth":%s}}' % (v, v, v) for v in want]
    last = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,null]},"properties":{"status":"ok","note":null,"depth":"NaN"}}'
    assert [r.feature for r in got] == [*made, last]


def test_rounded_as_in_sql(spark):
    import random

    import duckdb

    from thalweg.functions import geo

    rng = random.Random(2)
    x = [rng.uniform(-1e8, 1e8) for _ in range(20000)]
    want = [r[0] for r in duckdb.sql(f"SELECT round(x, 7) FROM (SELECT unnest({x}::DOUBLE[]) AS x)").fetchall()]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(geo.rounded("x", 7)).collect()] == want
