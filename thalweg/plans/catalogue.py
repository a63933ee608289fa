"""Named queries over the driver's tables, each with the SQL that states it.

The tables stand in for the engine's own: events for tracks, probes and recordings, embeddings for
class probabilities, documents for chunks, orders for files, pages for folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, geo, labels, names
from ..functions import text as texts
from ..operators import asof, classes, near_images, recordings, reports, search
from ..operators import track as tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MAX_GAP_S = 3600
CLASSES = list(range(10))


def named(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of one kind as points of one track: t in microseconds, lat, lon, depth (null for each third id)."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    depth = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value") / 7)
    return e.select(F.lit("all").alias("track_id"), "event_id", "user_id", clock.micros(F.col("ts")).alias("t"), F.col("value").alias("lat"), F.col("user_id").cast("double").alias("lon"), depth.cast("double").alias("depth"))


# ------------------------------------------------------------------ tracks and positions
TRACK_SQL = """track AS (
  SELECT t, lat, lon, depth, lead(t) OVER (ORDER BY t) AS tb, lead(lat) OVER (ORDER BY t) AS latb, lead(lon) OVER (ORDER BY t) AS lonb,
         lead(depth) OVER (ORDER BY t) AS depthb
  FROM (SELECT epoch_us(ts) AS t, value AS lat, user_id::DOUBLE AS lon, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 7 END AS depth,
               row_number() OVER (PARTITION BY ts ORDER BY value, user_id) AS k FROM events WHERE event_type = 'view') WHERE k = 1),
edge AS (SELECT min(t) AS g0, max(t) AS g1, count(*) AS n FROM track),"""
ASOF_SQL = f"""WITH {TRACK_SQL}
probe AS (SELECT event_id, epoch_us(ts) AS x FROM events WHERE event_type = 'PROBE'),
hit AS (
  SELECT event_id, x, g0, g1, n, s.t, s.tb, s.lat, s.latb, s.lon, s.lonb, s.depth, s.depthb FROM probe CROSS JOIN edge
  ASOF LEFT JOIN (SELECT * FROM track WHERE tb IS NOT NULL) s ON probe.x >= s.t),
judged AS (
  SELECT *, CASE WHEN x < g0 OR (n = 1 AND x = g0) THEN 'before_track' WHEN x > g1 OR n = 1 THEN 'after_track'
    WHEN tb - t > {MAX_GAP_S * 1_000_000} THEN 'gps_gap' ELSE 'ok' END AS status, (x - t) / (tb - t) AS r FROM hit)
"""


def _asof(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    probes = events(spark, sf_dir, kind).select("track_id", "event_id", "t")
    return asof.interpolate(probes, events(spark, sf_dir, "view").select("track_id", "t", "lat", "lon", "depth"), MAX_GAP_S)


POSITION_SQL = """SELECT event_id, status, CASE WHEN status = 'ok' THEN round(lat + r * (latb - lat), 7) END AS latitude,
  CASE WHEN status = 'ok' THEN round(lon + r * (lonb - lon), 7) END AS longitude,
  CASE WHEN status = 'ok' THEN round(coalesce(depth + r * (depthb - depth), depth, depthb), 2) END AS depth_m FROM judged"""


@named(ASOF_SQL.replace("PROBE", "click") + POSITION_SQL)
def asof_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asof(spark, sf_dir, "click")
    return rows.select("event_id", "status", geo.rounded("lat", 7).alias("latitude"), geo.rounded("lon", 7).alias("longitude"), geo.rounded("depth", 2).alias("depth_m"))


@named(ASOF_SQL.replace("PROBE", "view") + POSITION_SQL)
def gap_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asof(spark, sf_dir, "view")
    return rows.select("event_id", "status", F.round("lat", 7).alias("latitude"), F.round("lon", 7).alias("longitude"), F.round("depth", 2).alias("depth_m"))


@named(ASOF_SQL.replace("PROBE", "click") + "SELECT status, count(*) AS n FROM judged GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(_asof(spark, sf_dir, "click"))


@named(ASOF_SQL.replace("PROBE", "click") + "SELECT event_id % 7 AS recording, count(*) FILTER (status = 'ok') AS n_ok, count(*) AS n FROM judged GROUP BY 1")
def frames_per_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asof(spark, sf_dir, "click").withColumn("recording", F.col("event_id") % 7)
    return rows.groupBy("recording").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count("*").alias("n"))


@named("""WITH p AS (SELECT user_id, epoch_us(ts) AS t, min(value) AS lat FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT * FROM (SELECT user_id, t AS ta, lead(t) OVER w AS tb, lat AS lat_a, lead(lat) OVER w AS lat_b, lead(t, 2) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE tb IS NOT NULL""")
def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "view")
    seg = tracks.segments(e.withColumn("track_id", F.col("user_id")))
    return seg.select(F.col("track_id").alias("user_id"), "ta", "tb", F.col("a.lat").alias("lat_a"), F.col("b.lat").alias("lat_b"), "last")


@named("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS depth,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000 AS gap FROM events WHERE event_type = 'view')
SELECT user_id, count(*) AS points, count(depth) AS points_with_depth, min(t) AS first_t, max(t) AS last_t, round(quantile_cont(gap, 0.5), 3) AS median_interval_s FROM g GROUP BY user_id""")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks.summary(events(spark, sf_dir, "view").withColumn("track_id", F.col("user_id")))
    return s.select(F.col("track_id").alias("user_id"), "points", "points_with_depth", "first_t", "last_t", F.round("median_interval_s", 3).alias("median_interval_s"))


@named("""WITH u AS (SELECT epoch_us(date_trunc('minute', ts)) AS t, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS source, value AS lat, user_id::DOUBLE AS lon FROM events WHERE event_type IN ('view', 'signup'))
SELECT t, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY source, lat, lon) AS k FROM u) WHERE k = 1""")
def merge_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.col("t") / 60_000_000) * 60_000_000
    both = [events(spark, sf_dir, k).select(minute.alias("t"), "lat", "lon") for k in ("view", "signup")]
    return tracks.merge(both)


@named("""WITH g AS (SELECT min(epoch_us(ts)) AS g0, max(epoch_us(ts)) AS g1 FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00'),
r AS (SELECT user_id, date_trunc('day', ts) AS d, min(epoch_us(ts)) AS v0, max(epoch_us(ts)) AS v1 FROM events GROUP BY 1, 2),
o AS (SELECT user_id, epoch_us(d) AS day_us, v0, v1, g0, g1, CASE WHEN v1 > v0 THEN 100.0::DOUBLE * greatest(0, least(v1, g1) - greatest(v0, g0)) / (v1 - v0) ELSE 0.0 END AS pct FROM r CROSS JOIN g)
SELECT user_id, day_us, round(pct, 1) AS pct_inside, CASE WHEN pct = 0 THEN 'none' WHEN pct < 90 THEN 'partial' ELSE 'ok' END AS note,
  CASE WHEN pct = 0 THEN round(((v0 + v1) / 2 - (g0 + g1) / 2) / 3600000000, 2) END AS hours_off FROM o""")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", clock.micros(F.col("ts")))
    span = e.where("event_type = 'purchase' AND ts BETWEEN TIMESTAMP_NTZ '2024-01-10 12:00:00' AND TIMESTAMP_NTZ '2024-01-20 12:00:00'").agg(F.min("t").alias("g0"), F.max("t").alias("g1")).first()
    recs = e.groupBy("user_id", clock.micros(F.date_trunc("day", "ts")).alias("day_us")).agg(F.min("t").alias("v0"), F.max("t").alias("v1"))
    return recordings.overlap(recs, span.g0, span.g1).select("user_id", "day_us", "pct_inside", "note", "hours_off")


# ------------------------------------------------------------------ recordings, frames, clocks
@named("""WITH r AS (SELECT user_id, min(epoch_us(ts)) AS start, 1 + max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n FROM events GROUP BY user_id),
f AS (SELECT user_id, i, start + CAST(0.5 * 1000000 AS BIGINT) * i AS t FROM r, generate_series(0, n - 1) AS g(i)),
m AS (SELECT *, strftime(make_timestamp(t - t % 1000000), 'frame_%Y-%m-%d_%H-%M-%S') || '_' || lpad(((t % 1000000) // 1000)::VARCHAR, 3, '0') AS stem FROM f)
SELECT user_id, i, t, CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY user_id, i) > 1 THEN stem || '_' || user_id || '.jpg' ELSE stem || '.jpg' END AS frame_filename FROM m""")
def frame_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    recs = e.groupBy("user_id").agg(F.min(clock.micros(F.col("ts"))).alias("start"), (F.max(k) + 1).alias("n_frames"))
    rows = recordings.frames(recs, interval_s=0.5).withColumn("name", names.frame_name(F.col("t"), 0.5))
    return rows.select("user_id", "i", "t", names.without_collisions(F.col("name"), F.col("user_id").cast("string"), "user_id", "i").alias("frame_filename"))


@named("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'GOPR' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') WHEN o_orderkey % 11 = 1 THEN 'GP' || lpad((o_orderkey % 7)::VARCHAR, 2, '0') || lpad((o_custkey % 10000)::VARCHAR, 4, '0')
  WHEN o_orderkey % 11 = 2 THEN 'clip' || o_custkey ELSE 'gh' || lpad((o_orderkey % 7)::VARCHAR, 2, '0') || lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS stem FROM orders),
k AS (SELECT o_orderkey, stem, CASE WHEN regexp_matches(stem, '^GOPR[0-9]{4}$') THEN stem WHEN regexp_matches(stem, '^GP[0-9]{6}$') THEN 'GOPR' || stem[5:] WHEN regexp_matches(stem, '^gh[0-9]{6}$') THEN 'GH' || stem[5:] ELSE stem END AS recording,
  CASE WHEN regexp_matches(stem, '^(GP|gh)[0-9]{6}$') THEN stem[3:4]::INT ELSE 0 END AS chapter FROM s)
SELECT recording, count(*) AS n_chapters, string_agg(chapter || ':' || o_orderkey, ',' ORDER BY chapter, lpad(o_orderkey::VARCHAR, 12, '0')) AS chapters FROM k GROUP BY recording""")
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def padded(c: Column, n: int) -> Column:
        return F.lpad(c.cast("string"), n, "0")

    number, chapter = padded(F.col("o_custkey") % 10000, 4), padded(key % 7, 2)
    stem = (
        F.when(key % 11 == 0, F.concat(F.lit("GOPR"), number)).when(key % 11 == 1, F.concat(F.lit("GP"), chapter, number))
        .when(key % 11 == 2, F.concat(F.lit("clip"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("gh"), chapter, number))
    )
    grouped = recordings.group_chapters(o.select(F.lit("").alias("parent"), padded(key, 12).alias("path"), stem.alias("stem")))
    shown = F.transform("chapters", lambda c: F.concat(c["chapter"].cast("string"), F.lit(":"), c["path"].cast("long").cast("string")))
    return grouped.select("recording", F.col("n_chapters").cast("long").alias("n_chapters"), F.array_join(shown, ",").alias("chapters"))


@named("SELECT o_orderkey, (o_orderdate AT TIME ZONE 'Asia/Manila') AT TIME ZONE 'UTC' AS utc, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS iso FROM orders")
def local_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", clock.local_to_utc(F.col("o_orderdate"), "Asia/Manila").alias("utc"), clock.iso_with_offset(F.col("o_orderdate"), "Asia/Manila").alias("iso"))


@named("""WITH a AS (SELECT s_suppkey, s_acctbal / 100 AS deg, abs(s_acctbal / 100) AS x FROM supplier),
b AS (SELECT *, floor(x)::BIGINT AS d, (x - floor(x)) * 60 AS mf FROM a), c AS (SELECT *, floor(mf)::BIGINT AS m, round_even((mf - floor(mf)) * 60 * 10000, 0)::BIGINT AS s FROM b),
e AS (SELECT *, (CASE WHEN deg < 0 THEN -1 ELSE 1 END) * (d::DOUBLE + m::DOUBLE / 60 + s::DOUBLE / 10000 / 3600) AS back FROM c)
SELECT s_suppkey, d, m, s, round(back, 6) AS back, abs(back - deg) < 1e-7 AS close FROM e""")
def dms_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = F.col("s_acctbal") / 100
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", deg.alias("deg"), geo.dms(deg).alias("parts"))
    back = geo.from_dms(F.col("parts"), F.col("deg") < 0)
    num = [F.get(F.col("parts.num"), k).alias(c) for k, c in enumerate(("d", "m", "s"))]
    return rows.select("s_suppkey", *num, F.round(back, 6).alias("back"), (F.abs(back - F.col("deg")) < 1e-7).alias("close"))


@named("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, round(greatest(abs(o_totalprice - floor(o_totalprice)), abs(o_custkey - o_custkey)) * 111000, 2) AS error_m FROM o WHERE (k - 1) % greatest(1, n // 5) = 0 AND k <= greatest(1, n // 5) * 5""")
def verify_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    rows = reports.systematic_sample(o, "o_orderkey", 5)
    err = geo.position_error_m(F.col("o_totalprice"), F.col("o_custkey"), F.floor("o_totalprice"), F.col("o_custkey"))
    return rows.select("o_orderkey", err.alias("error_m"))


# ------------------------------------------------------------------ class probabilities
PROBS = 5
NAMES = ["corals", "macroalgae", "rubble", "sand", "seagrass"]
PROB_SQL = """p AS (SELECT vec_id, label, [abs(x::DOUBLE) FOR x IN embedding[1:5]] AS a FROM embeddings),
q AS (SELECT vec_id, label, [x / (a[1] + a[2] + a[3] + a[4] + a[5]) FOR x IN a] AS probs FROM p)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform(F.slice("embedding", 1, PROBS), lambda x: F.abs(x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", a.alias("a"))
    total = sum((F.get("a", k) for k in range(1, PROBS)), F.get("a", 0))
    return e.select("vec_id", "label", F.array(*(F.get("a", k) / total for k in range(PROBS))).alias("probs"))


SMOOTH = ", ".join(f"round(avg(probs[{k + 1}]) OVER w, 6) AS prob_{k}" for k in range(PROBS))


@named(f"WITH {PROB_SQL} SELECT vec_id, {SMOOTH} FROM q WINDOW w AS (PARTITION BY label ORDER BY vec_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def smooth_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("t", F.col("vec_id") * 1_000_000)
    s = classes.smooth(rows, PROBS, 10.0, by="label")
    return s.select("vec_id", *(F.round(F.get("probs", k), 6).alias(f"prob_{k}") for k in range(PROBS)))


LABEL_SQL = f"""{PROB_SQL}, r AS (SELECT vec_id, label, probs, list_max(probs) AS top, list_reverse_sort(probs) AS s FROM q),
l AS (SELECT vec_id, label AS folder, CASE WHEN top >= 0.4 THEN (['corals', 'macroalgae', 'rubble', 'sand', 'seagrass'])[list_position(probs, top)] ELSE 'uncertain' END AS label, top, s[1] - s[2] AS m FROM r)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.select("vec_id", F.col("label").alias("folder"), labels.label(NAMES, F.col("probs"), 0.4).alias("label"), F.array_max("probs").alias("top"), labels.margin(F.col("probs")).alias("m"))


@named(f"WITH {LABEL_SQL} SELECT vec_id, label, round(top, 4) AS class_conf, round(m, 4) AS class_margin FROM l")
def label_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("vec_id", "label", F.round("top", 4).alias("class_conf"), F.round("m", 4).alias("class_margin"))


@named(f"WITH {LABEL_SQL} SELECT label, count(*) AS n, count(*) FILTER (round(m, 4) < 0.2) AS low_margin FROM l GROUP BY label")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.round("m", 4) < 0.2).alias("low_margin"))


@named(f"WITH {LABEL_SQL} SELECT label, vec_id, round(top, 4) AS class_conf FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY top DESC, vec_id) AS k FROM l) WHERE k = 1")
def top1_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = classes.top_per_class(labelled(spark, sf_dir).select("label", "vec_id", "top"), "label", "top", "vec_id")
    return best.select("label", "vec_id", F.round("top", 4).alias("class_conf"))


TTA = ", ".join(f"round((abs(embedding[{k}]::DOUBLE) + abs(embedding[{k + 5}]::DOUBLE) + abs(embedding[{k + 10}]::DOUBLE) + abs(embedding[{k + 15}]::DOUBLE)) / 4, 6) AS p{k}" for k in range(1, 6))


@named(f"SELECT vec_id, {TTA} FROM embeddings")
def tta_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = [F.transform(F.slice("embedding", 1 + 5 * v, 5), lambda x: F.abs(x.cast("double"))) for v in range(labels.views("flips"))]
    e = table(spark, sf_dir, "embeddings").select("vec_id", labels.mean(views).alias("p"))
    return e.select("vec_id", *(F.round(F.get("p", k - 1), 6).alias(f"p{k}") for k in range(1, 6)))


@named("""SELECT lang, count(*) FILTER (source IN ('src0', 'src1')) AS train, count(*) FILTER (source = 'src2') AS valid, count(*) FILTER (source NOT IN ('src0', 'src1', 'src2')) AS test,
  round(100.0::DOUBLE * count(*) FILTER (source IN ('src0', 'src1')) / sum(count(*) FILTER (source IN ('src0', 'src1'))) OVER (), 1) AS train_pct FROM documents GROUP BY lang""")
def class_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("source").isin("src0", "src1"), "train").when(F.col("source") == "src2", "valid").otherwise("test")
    t = classes.crosstab(table(spark, sf_dir, "documents").withColumn("split", split), "lang", "split", ["train", "valid", "test"])
    total = t.agg(F.sum("train").alias("n")).first()["n"]
    return t.withColumn("train_pct", F.round(100.0 * F.col("train") / F.lit(total), 1))


# ------------------------------------------------------------------ model evaluation
def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = F.slice("embedding", 1, len(CLASSES))
    return e.select("vec_id", F.col("label").alias("truth"), (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("predicted"))


TRUTH_SQL = """t AS (SELECT vec_id, label AS truth, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INT AS predicted FROM embeddings),
m AS (SELECT a::INT AS truth, b::INT AS predicted, (SELECT count(*) FROM t WHERE t.truth = a AND t.predicted = b) AS n FROM generate_series(0, 9) x(a), generate_series(0, 9) y(b)),
c AS (SELECT k::INT AS class, (SELECT sum(n) FROM m WHERE truth = k AND predicted = k)::DOUBLE AS tp, (SELECT sum(n) FROM m WHERE truth = k)::BIGINT AS support, (SELECT sum(n) FROM m WHERE predicted = k)::DOUBLE AS guessed FROM generate_series(0, 9) z(k)),
d AS (SELECT class, support, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM c),
f AS (SELECT class, support, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM d)"""


@named(f"WITH {TRUTH_SQL} SELECT truth, predicted, n, round(CASE WHEN sum(n) OVER (PARTITION BY truth) > 0 THEN n::DOUBLE / sum(n) OVER (PARTITION BY truth) ELSE 0 END, 6) AS row_share FROM m")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = classes.confusion(truth(spark, sf_dir), CLASSES)
    return m.select("truth", "predicted", "n", F.round("row_share", 6).alias("row_share"))


@named(f"WITH {TRUTH_SQL} SELECT class, precision, recall, f1, support FROM f")
def per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.per_class(classes.confusion(truth(spark, sf_dir), CLASSES))


@named(f"WITH {TRUTH_SQL} SELECT round((SELECT sum(n) FROM m WHERE truth = predicted)::DOUBLE / (SELECT sum(n) FROM m), 4) AS accuracy, (SELECT round(avg(f1), 4) FROM f WHERE support > 0) AS macro_f1, (SELECT sum(n) FROM m)::BIGINT AS n")
def overall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.overall(classes.confusion(truth(spark, sf_dir), CLASSES))


@named(f"WITH {TRUTH_SQL} SELECT vec_id, truth, predicted FROM t WHERE truth <> predicted")
def misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes.misclassified(truth(spark, sf_dir))


HASH_SQL = """w AS (SELECT doc_id, CAST('0x' || md5(x)[1:4] AS INT) % 64 AS cell FROM (SELECT doc_id, unnest(string_split_regex(trim(text), '[\\x09-\\x0D\\x20]+')) AS x FROM documents) WHERE x <> ''),
n AS (SELECT doc_id, cell, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT d.doc_id, k.k, coalesce(n.n, 0) AS v FROM (SELECT DISTINCT doc_id FROM w) d CROSS JOIN generate_series(0, 63) AS k(k) LEFT JOIN n ON n.doc_id = d.doc_id AND n.cell = k.k),
b AS (SELECT doc_id, k, v > lag(v) OVER (PARTITION BY doc_id ORDER BY k) AS up FROM g),
h AS (SELECT doc_id AS id, doc_id % 3 AS split, sum(CASE WHEN up THEN 1::BIGINT << (k - 1)::BIGINT ELSE 0 END)::BIGINT AS h FROM b WHERE k > 0 GROUP BY doc_id),
pair AS (SELECT a.id AS id_a, a.split AS split_a, b.id AS id_b, b.split AS split_b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.id < b.id AND a.split <> b.split AND bit_count(xor(a.h, b.h)) <= 4)"""


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 63-bit gradient hash of each document's token histogram in 64 cells; split by doc_id."""
    words = F.filter(F.split("text", r"[\x09-\x0D\x20]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 64)
    counts = table(spark, sf_dir, "documents").select("doc_id", F.explode(cells).alias("cell")).groupBy("doc_id").agg(*(F.count_if(F.col("cell") == k).alias(f"c{k}") for k in range(64)))
    bits = [F.when(F.col(f"c{k}") > F.col(f"c{k - 1}"), F.lit(1 << (k - 1))).otherwise(F.lit(0)).cast("long") for k in range(1, 64)]
    h = bits[0]
    for b in bits[1:]:
        h = h.bitwiseOR(b)
    return counts.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("split"), h.alias("h"))


@named(f"WITH {HASH_SQL} SELECT * FROM pair")
def near_images_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_images.near_pairs(document_hashes(spark, sf_dir), 4)


@named(f"WITH {HASH_SQL} SELECT split, count(DISTINCT id) AS images FROM (SELECT split_a AS split, id_a AS id FROM pair UNION ALL SELECT split_b, id_b FROM pair) GROUP BY split")
def near_images_involved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_images.involved(near_images.near_pairs(document_hashes(spark, sf_dir), 4))


@named(f"WITH {HASH_SQL} SELECT least(split_a, split_b) AS split_a, greatest(split_a, split_b) AS split_b, count(*) AS pairs FROM pair GROUP BY 1, 2")
def near_images_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_images.pair_counts(near_images.near_pairs(document_hashes(spark, sf_dir), 4))


# ------------------------------------------------------------------ retrieval
STOP_SQL = ", ".join(f"'{w}'" for w in texts.STOP)


def token_sql(source: str, key: str, text: str) -> str:
    """SQL for (key, term) of every token, in the order-free form of functions.text.tokens."""
    spaced = "regexp_replace(word, '[_.]+', ' ', 'g')"
    for seam in texts.SEAMS:
        spaced = f"regexp_replace({spaced}, '{seam}', '\\1 \\2', 'g')"
    return f"""word AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?')) AS word FROM {source}),
split AS (SELECT {key}, word, list_filter(string_split(lower({spaced}), ' '), lambda p: p <> '') AS sub FROM word),
token AS (SELECT {key}, term FROM (SELECT {key}, unnest(CASE WHEN len(sub) > 1 THEN list_concat([CASE WHEN regexp_matches(word, '^[0-9]') THEN lower(word) ELSE trim(lower(word), '_') END], sub) WHEN len(sub) = 0 THEN [lower(word)] ELSE sub END) AS term FROM split)
  WHERE length(term) > 1 AND term NOT IN ({STOP_SQL}))"""


BM25_SQL = f"""{token_sql("documents", "doc_id", "text")},
tf AS (SELECT doc_id, term, count(*) AS tf FROM token GROUP BY ALL),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN token t USING (doc_id) GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN corpus GROUP BY term, n)"""


@named(f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.term_stats(search.postings(docs), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


QUERY_SQL = f"""{BM25_SQL},
qword AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?')) AS w FROM benchmark WHERE item_id % 20 = 0),
qsplit AS (SELECT item_id, w, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[_.]+', ' ', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')), ' '), lambda p: p <> '') AS sub FROM qword),
q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(CASE WHEN len(sub) > 1 THEN list_concat([CASE WHEN regexp_matches(w, '^[0-9]') THEN lower(w) ELSE trim(lower(w), '_') END], sub) WHEN len(sub) = 0 THEN [lower(w)] ELSE sub END) AS term FROM qsplit) WHERE length(term) > 1 AND term NOT IN ({STOP_SQL})),
score AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id) CROSS JOIN corpus GROUP BY 1, 2)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of the searches: every benchmark row whose id is divisible by 20."""
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_over(table(spark, sf_dir, "documents"), questions(spark, sf_dir))


@named(f"WITH {QUERY_SQL} SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM score")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@named(f"WITH {QUERY_SQL} SELECT query_id, doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS k FROM score) WHERE k <= 8")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "doc_id")
    return scored(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 8").select("query_id", "doc_id", F.col("k").cast("long").alias("k"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@named("""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT query_id, doc_id, round(dense, 6) AS dense FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, doc_id) AS k FROM d) WHERE k <= 8""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    best = search.dense_over(v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 8)
    return best.select("query_id", "doc_id", F.round("dense", 6).alias("dense"))


FUSE_SQL = f"""{QUERY_SQL},
dense AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS dense
  FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)) q WHERE e.vec_id IN (SELECT doc_id FROM documents)),
lex AS (SELECT query_id, doc_id, round(coalesce(bm25, 0), 9) AS bm25, dense FROM dense LEFT JOIN score USING (query_id, doc_id)),
fused AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id)) AS fused FROM lex)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with a vector of its own id against all documents with one."""
    v, asked = vectors(spark, sf_dir), questions(spark, sf_dir)
    docs = v.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    own = v.withColumnRenamed("doc_id", "query_id").join(asked.select("query_id"), "query_id", "left_semi")
    dense = search.dense_over(docs, own).withColumn("dense", F.round("dense", 9)).persist(StorageLevel.MEMORY_AND_DISK)
    lexical = dense.select("query_id", "doc_id").join(scored(spark, sf_dir), ["query_id", "doc_id"], "left")
    return search.fuse(lexical.select("query_id", "doc_id", F.round(F.coalesce("bm25", F.lit(0.0)), 9).alias("bm25")), dense, by=("query_id",))


@named(f"WITH {FUSE_SQL} SELECT query_id, doc_id, round(fused, 8) AS fused FROM fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "doc_id", F.round("fused", 8).alias("fused"))


@named(f"""WITH {FUSE_SQL}, named AS (SELECT query_id, doc_id, source || ' part' AS name, lang || '/' || source || '.txt' AS path, lower(benchmark.text || ' in src1 and src12') AS query, source, fused FROM fused JOIN documents USING (doc_id) JOIN benchmark ON item_id = query_id),
boosted AS (SELECT query_id, doc_id, path, fused + CASE WHEN length(source) > 3 AND contains(query, lower(source)) THEN 0.02 ELSE 0 END + CASE WHEN contains(query, lower(source)) THEN 0.01 ELSE 0 END AS fused FROM named)
SELECT query_id, doc_id, path, round(fused, 8) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS k FROM boosted WHERE fused > 0 AND contains(path, 'en/')) WHERE k <= 8""")
def hybrid_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" part")).alias("name"), F.concat("lang", F.lit("/"), "source", F.lit(".txt")).alias("path"))
    rows = fused(spark, sf_dir).join(d, "doc_id").join(questions(spark, sf_dir), "query_id")
    rows = rows.withColumn("fused", F.col("fused") + search.boost(F.col("name"), F.col("path"), F.concat("query", F.lit(" in src1 and src12"))))
    return search.top(rows, 8, "en/", by=("query_id",)).select("query_id", "doc_id", "path", F.round("fused", 8).alias("fused"))


@named("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '((?:api[_-]?key|token|secret|password|passwd)\\s*[=:]\\s*)''[^''"\\s]{6,}''', '\\1''<REDACTED>''', 'gi'),
  '((?:api[_-]?key|token|secret|password|passwd)\\s*[=:]\\s*)"[^''"\\s]{6,}"', '\\1"<REDACTED>"', 'gi'), 'sk-[A-Za-z0-9_\\-]{16,}', '<REDACTED>', 'g'), 'AKIA[0-9A-Z]{16}', '<REDACTED>', 'g') AS text FROM documents""")
def redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.redact(F.col("text")).alias("text"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.chunks import chunk_files

    d = table(spark, sf_dir, "documents")
    return chunk_files(d.select("doc_id", F.lit("corpus").alias("repo"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text"))


@named()
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(spark, sf_dir).select("path", "kind", "name", "start_line", "end_line", F.length("text").alias("n_chars"))


@named()
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of the best 24 of all chunks, for each benchmark row whose id is divisible by 20."""
    chunks = chunk_rows(spark, sf_dir).select("repo", "path", "kind", "name", F.col("meta.cell").alias("cell"), "text", "start_line", "end_line")
    # read twice, by the search and for the texts of the best, and dear to make
    chunks = chunks.withColumn("doc_id", F.xxhash64("path", "name", "cell", "start_line", "end_line")).persist(StorageLevel.MEMORY_AND_DISK)
    scores = search.bm25_over(chunks, questions(spark, sf_dir))
    best = search.top(scores.select("query_id", "doc_id", F.round("bm25", 9).alias("fused")), 24, by=("query_id",))
    return search.excerpts(chunks.join(best, "doc_id"), 8, by=("query_id",)).select("query_id", "group_no", "path", "name", "start_line", "end_line", "pieces", "text")


@named("""WITH s AS (SELECT source, lang, min(doc_id) AS o FROM documents GROUP BY ALL)
SELECT '- corpus/' || source || ': ' || string_agg(lang, '; ' ORDER BY o) AS line FROM s GROUP BY source""")
def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("repo"), F.col("source").alias("path"), F.col("doc_id").alias("ord"), F.col("lang").alias("symbol"))
    return reports.symbol_map(d).select("line")


# ------------------------------------------------------------------ listings, histories, logs
@named("""WITH p AS (SELECT regexp_replace(url, '^https?://([^/?#]+)[^?#]*?/?([^/?#]*)([?#].*)?$', '\\1') AS host, page_id FROM pages)
SELECT host AS dir, count(*) FILTER (page_id % 3 = 0) AS videos, count(*) FILTER (page_id % 3 = 1) AS gpx, count(*) FILTER (page_id % 3 = 2) AS jpg FROM p WHERE NOT regexp_matches(host, '(^|/)\\.') GROUP BY host ORDER BY host LIMIT 200""")
def list_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".gpx", ".jpg"))), (F.col("page_id") % 3 + 1).cast("int"))
    return reports.folder_counts(table(spark, sf_dir, "pages").select(F.concat(host, F.lit("/"), F.col("page_id").cast("string"), ext).alias("path")))


@named("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@named("""WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, count(*) AS acc FROM events GROUP BY ALL)
SELECT event_type, epoch, acc FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY acc DESC, epoch) AS k FROM d) WHERE k = 1""")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    d = table(spark, sf_dir, "events").groupBy("event_type", day.alias("epoch")).agg(F.count("*").alias("acc"))
    return reports.best_row(d, "acc", "epoch", ["event_type"])


@named("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@named()
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof_interpolate(spark, sf_dir).withColumn("path", F.lit(""))
    return reports.geojson_features(rows)


from . import catalogue_rows  # noqa: E402, F401  its queries join those above
