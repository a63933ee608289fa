"""More named queries, for operators that work on single rows or small reports, each with its SQL.

As in catalogue.py the tables stand in for the engine's own: orders for media files and their metadata,
embeddings for predictions, documents for chunks and log outputs, pages for image files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, geo, labels, names
from ..functions import text as texts
from ..operators import near_images, recordings, reports, search, track
from ..sources import adapters, listings
from . import catalogue as c
from . import classify, survey
from .catalogue import ASOF_SQL, CLASSES, NAMES, POSITION_SQL, PROB_SQL, named, table


# ------------------------------------------------------------------ media files and recordings
@named("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '0000:00:00 00:00:00' WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS cd,
  CASE WHEN o_orderkey % 5 IN (0, 3) THEN strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.000000Z') END AS ct, o_custkey % 4 AS fps, o_custkey AS n FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN cd NOT LIKE '0000%' THEN strptime(cd, '%Y:%m:%d %H:%M:%S') END, strptime(replace(left(ct, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')) AS start_local,
  CASE WHEN fps > 0 THEN n::DOUBLE / fps ELSE 0.0 END AS duration_s FROM m""")
def media_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    create = F.when(k % 5 == 0, "0000:00:00 00:00:00").when(k % 5 < 3, F.date_format(at, "yyyy:MM:dd HH:mm:ss"))
    creation = F.when((k % 5).isin(0, 3), F.concat(F.date_format(at + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", adapters.start_time(create, creation).alias("start_local"), adapters.duration(F.col("o_custkey"), F.col("o_custkey") % 4).alias("duration_s"))


CHAPTERS_SQL = """f AS (SELECT o_custkey % 50 AS parent, o_orderkey, 'GH' || lpad((o_orderkey % 4)::VARCHAR, 2, '0') || lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS stem, o_orderdate AS shot, (o_custkey % 90 + 5)::DOUBLE AS dur FROM orders),
g AS (SELECT parent::VARCHAR AS parent, 'GH' || stem[5:] AS recording, stem[3:4]::INT AS chapter, lpad(o_orderkey::VARCHAR, 12, '0') AS path, shot, dur FROM f),
r AS (SELECT parent, recording, count(*) AS n_chapters, arg_min(shot, (chapter, path)) AS start_local, sum(dur) AS duration_s, list(path ORDER BY chapter, path) AS paths FROM g GROUP BY ALL)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stem = F.concat(F.lit("GH"), F.lpad((k % 4).cast("string"), 2, "0"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    files = o.select((F.col("o_custkey") % 50).cast("string").alias("parent"), F.lpad(k.cast("string"), 12, "0").alias("path"), stem.alias("stem"), F.col("o_orderdate").alias("start_local"), (F.col("o_custkey") % 90 + 5).cast("double").alias("duration_s"))
    return recordings.group_chapters(files)


@named(f"WITH {CHAPTERS_SQL} SELECT parent, recording, n_chapters, start_local, round(duration_s / 60, 1) AS duration_min, start_local + to_microseconds((duration_s * 1000000)::BIGINT) AS end_local FROM r")
def recording_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.timestamp_micros(clock.micros(F.col("start_local")) + (F.col("duration_s") * 1_000_000).cast("long")).cast("timestamp_ntz")
    rows = chapters(spark, sf_dir)
    return rows.select("parent", "recording", F.col("n_chapters").cast("long").alias("n_chapters"), "start_local", F.round(F.col("duration_s") / 60, 1).alias("duration_min"), end.alias("end_local"))


@named(f"WITH {CHAPTERS_SQL} SELECT parent, recording, CASE WHEN n_chapters > 1 THEN 'concatenate' ELSE 'skip' END AS action, array_to_string(paths, ',') AS paths FROM r")
def concat_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.concat_manifest(chapters(spark, sf_dir))
    return m.select("parent", "recording", "action", F.array_join("paths", ",").alias("paths"))


@named(f"WITH {CHAPTERS_SQL} SELECT parent, recording, n_chapters FROM r WHERE recording IN ('GH0001', 'GH0007', 'GH0130')")
def recordings_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.only_recordings(chapters(spark, sf_dir), ["GH0001", "GH0007", "GH0130"]).select("parent", "recording", F.col("n_chapters").cast("long").alias("n_chapters"))


@named("""WITH p AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, a + INTERVAL 8 HOUR AS first_local, b + INTERVAL 8 HOUR AS last_local FROM p""")
def track_local_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = c.events(spark, sf_dir, "view").withColumn("track_id", F.col("user_id"))
    return track.local_range(e, "Asia/Manila").withColumnRenamed("track_id", "user_id")


@named("""SELECT event_id, epoch_us(ts) AS t, value AS lat, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 7 END AS depth FROM events WHERE event_type = 'view' AND event_id % 4 <> 0""")
def timed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = c.events(spark, sf_dir, "view")
    e = e.withColumn("t", F.when(F.col("event_id") % 4 != 0, F.col("t"))).withColumn("depth", F.coalesce("depth", F.lit(float("nan"))))
    return track.timed(e).select("event_id", "t", "lat", "depth")


# ------------------------------------------------------------------ geotags
TAGGED_SQL = ASOF_SQL.replace("PROBE", "click") + f", pos AS ({POSITION_SQL})"


@named(TAGGED_SQL + """, x AS (SELECT event_id, latitude, longitude, depth_m, abs(latitude) AS a, abs(longitude) AS o FROM pos WHERE status = 'ok'),
y AS (SELECT *, floor(a)::BIGINT AS ad, (a - floor(a)) * 60 AS am, floor(o)::BIGINT AS od, (o - floor(o)) * 60 AS om FROM x)
SELECT event_id, CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END AS lat_ref, CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS lon_ref, ad AS lat_d, floor(am)::BIGINT AS lat_m, od AS lon_d, floor(om)::BIGINT AS lon_m,
  'benthic survey frame' || CASE WHEN depth_m IS NOT NULL THEN '; echosounder depth ' || printf('%d.%02d', (round(depth_m * 100)::BIGINT // 100), (round(depth_m * 100)::BIGINT % 100)) || ' m' ELSE '' END AS image_description FROM y""")
def geotag_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = adapters.exif_columns(c.asof_interpolate(spark, sf_dir))
    part = [F.get(F.col(f"{k}_dms.num"), i).alias(f"{k}_{n}") for k in ("lat", "lon") for i, n in enumerate("dm")]
    return x.select("event_id", "lat_ref", "lon_ref", *part, "image_description")


@named("""WITH d AS (SELECT o_orderkey, 'frame; note ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '; benthic class old' ELSE '' END AS t FROM orders)
SELECT o_orderkey, string_split(t, '; benthic class ')[1] || '; benthic class sand' AS once, string_split(t, '; benthic class ')[1] || '; benthic class sand' AS twice FROM d""")
def class_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("frame; note "), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "; benthic class old").otherwise(""))
    once = geo.with_class(t, F.lit("sand"))
    return table(spark, sf_dir, "orders").select("o_orderkey", once.alias("once"), geo.with_class(once, F.lit("sand")).alias("twice"))


@named(TAGGED_SQL + """, e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE floor(latitude * 1000) / 1000 END AS elat, floor(longitude * 1000) / 1000 AS elon, latitude, longitude FROM pos WHERE status = 'ok')
SELECT event_id, elat IS NOT NULL AS has_gps, CASE WHEN elat IS NOT NULL THEN round(greatest(abs(latitude - elat), abs(longitude - elon)) * 111000, 2) END AS max_error_m FROM e""")
def verify_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.asof_interpolate(spark, sf_dir).where("status = 'ok'")
    tags = rows.where("event_id % 5 <> 0").select("event_id", (F.floor(F.col("latitude") * 1000) / 1000).alias("lat"), (F.floor(F.col("longitude") * 1000) / 1000).alias("lon"))
    return reports.verified(rows, tags, "event_id").select("event_id", "has_gps", "max_error_m")


@named(TAGGED_SQL + """SELECT event_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']},"properties":{"event_id":' || event_id || ',"status":"ok","depth_m":' || coalesce(depth_m::VARCHAR, 'null') || '}}' AS feature
  FROM pos WHERE status = 'ok' AND latitude > 0.001""")
def geojson_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.asof_interpolate(spark, sf_dir).where("latitude > 0.001").select("event_id", "status", "latitude", "longitude", "depth_m", F.lit("").alias("path"))
    made = reports.geojson_features(rows)
    return made.select(F.get_json_object("feature", "$.properties.event_id").cast("long").alias("event_id"), "feature")


# ------------------------------------------------------------------ classes
TEXT_SQL = f"""{PROB_SQL}, e AS (SELECT vec_id, unnest([{{'k': k, 'p': probs[k + 1]}} FOR k IN range(5)]) AS x FROM q)"""


@named(f"""WITH {TEXT_SQL} SELECT vec_id, string_agg((['corals', 'macroalgae', 'rubble', 'sand', 'seagrass'])[x.k + 1], ', ' ORDER BY x.p DESC, x.k) AS ranked FROM e GROUP BY vec_id""")
def prob_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = labels.text(NAMES, F.col("probs"))
    return c.predictions(spark, sf_dir).select("vec_id", F.regexp_replace(said, r" [0-9.]+(?=,|$)", "").alias("ranked"))


@named("""WITH b AS (SELECT vec_id, embedding || embedding[1:8] AS e, unnest(range(64)) AS k FROM embeddings),
h AS (SELECT vec_id, sum(CASE WHEN k > 0 AND e[(k // 8) * 9 + k % 8 + 2] > e[(k // 8) * 9 + k % 8 + 1] THEN 1::BIGINT << (63 - k) ELSE 0 END)::BIGINT AS low,
  bool_or(k = 0 AND e[2] > e[1]) AS top FROM b GROUP BY vec_id)
SELECT vec_id, CASE WHEN top THEN (low - 9223372036854775807) - 1 ELSE low END AS h FROM h""")
def gradient_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.concat("embedding", F.slice("embedding", 1, 8))
    return table(spark, sf_dir, "embeddings").select("vec_id", labels.gradient_hash(cells).alias("h"))


FRAME_SQL = f"""{PROB_SQL}, k AS (SELECT vec_id, label, probs, CASE WHEN vec_id % 7 = 0 THEN 'gps_gap' ELSE 'ok' END AS status FROM q),
s AS (SELECT vec_id, label, probs, [{", ".join(f"avg(probs[{k}]) OVER w" for k in range(1, 6))}] AS sm FROM k WHERE status = 'ok' WINDOW w AS (PARTITION BY label ORDER BY vec_id RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
l AS (SELECT vec_id, CASE WHEN round(list_max(probs), 12) >= 0.4 THEN (['corals', 'macroalgae', 'rubble', 'sand', 'seagrass'])[list_position(probs, list_max(probs))] ELSE 'uncertain' END AS raw_class,
  CASE WHEN round(list_max(sm), 12) >= 0.4 THEN (['corals', 'macroalgae', 'rubble', 'sand', 'seagrass'])[list_position(sm, list_max(sm))] ELSE 'uncertain' END AS benthic_class,
  round(list_max(sm), 4) AS class_conf, round(list_reverse_sort(sm)[1] - list_reverse_sort(sm)[2], 4) AS class_margin, round(sm[1], 4) AS prob_corals FROM s),
f AS (SELECT vec_id::VARCHAR AS frame_id, status, raw_class, benthic_class, class_conf, class_margin, prob_corals,
  CASE WHEN benthic_class IS NOT NULL THEN 'classified/' || benthic_class || '/' || benthic_class || '_f' || vec_id || '.jpg' END AS classified_path FROM k LEFT JOIN l USING (vec_id))"""


def frames_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = c.predictions(spark, sf_dir).withColumn("frame_id", F.col("vec_id").cast("string"))
    at = F.timestamp_seconds("vec_id")
    frames = p.select(
        "frame_id", F.concat(F.lit("f"), "frame_id", F.lit(".jpg")).alias("frame_filename"), F.lit("dive").alias("parent"), F.col("label").cast("string").alias("recording"), at.alias("ts_utc"),
        F.when(F.col("vec_id") % 7 == 0, "gps_gap").otherwise("ok").alias("status"), F.lit("stale").alias("benthic_class"), F.lit(0.5).alias("prob_kelp"),
    )
    return frames, p.select("frame_id", "probs")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_frames(*frames_and_predictions(spark, sf_dir), NAMES, conf=0.4, smooth_s=6.0)


@named(f"WITH {FRAME_SQL} SELECT frame_id, status, raw_class, benthic_class, class_conf, class_margin, prob_corals, classified_path FROM f")
def classified_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("frame_id", "status", "raw_class", "benthic_class", "class_conf", "class_margin", "prob_corals", "classified_path")


@named(f"WITH {FRAME_SQL} SELECT benthic_class, count(*) AS n, count(*) FILTER (class_margin < 0.2) AS low_margin FROM f WHERE benthic_class IS NOT NULL GROUP BY benthic_class")
def classified_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.summary(classified(spark, sf_dir))


@named(f"""WITH {FRAME_SQL} SELECT frame_id, '{{"frame_id":"' || frame_id || '","class":"' || benthic_class || '"}}' AS feature FROM f WHERE status = 'ok'""")
def classified_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes joined into features written earlier, by frame."""
    rows = classified(spark, sf_dir)
    features = rows.where("status = 'ok'").select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("frame_id").alias("properties"))).alias("feature"))
    merged = reports.merge_features(features, rows.select("frame_id", F.col("benthic_class").alias("class")), "frame_id")
    return merged.select(F.get_json_object("feature", "$.properties.frame_id").alias("frame_id"), F.get_json_object("feature", "$.properties").alias("feature"))


IMAGE_SQL = f"""{PROB_SQL}, i AS (SELECT vec_id, 'data/' || CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'dive' || label || '/' END || 'i' || vec_id || '.png' AS path, probs, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id / 100.0::DOUBLE END AS latitude FROM q)"""


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c.predictions(spark, sf_dir)
    name = F.concat(F.lit("i"), F.col("vec_id").cast("string"), F.lit(".png"))
    path = F.concat(F.lit("data/"), F.when(F.col("vec_id") % 3 == 0, "").otherwise(F.concat(F.lit("dive"), F.col("label").cast("string"), F.lit("/"))), name)
    return classify.classify_images(p.select(path.alias("path"), name.alias("name"), "probs", F.when(F.col("vec_id") % 4 != 0, F.col("vec_id") / 100.0).alias("latitude")), NAMES, "data", 0.3)


@named(f"""WITH {IMAGE_SQL} SELECT 'i' || vec_id || '.png' AS filename, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'dive' || label END AS folder,
  CASE WHEN list_max(probs) >= 0.3 THEN (['corals', 'macroalgae', 'rubble', 'sand', 'seagrass'])[list_position(probs, list_max(probs))] ELSE 'uncertain' END AS predicted_class, round(list_max(probs), 4) AS confidence, latitude FROM i JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)""")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_rows(spark, sf_dir).select("filename", "folder", "predicted_class", "confidence", "latitude")


@named(f"WITH {IMAGE_SQL} SELECT count(*) AS images, count(latitude) AS with_gps FROM i")
def image_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.image_totals(image_rows(spark, sf_dir)).select("images", "with_gps")


@named("""WITH v AS (SELECT label AS run, CASE vec_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'hflip' ELSE 'flips' END AS tta, round(avg(vec_id % 5), 1) AS macro_f1 FROM embeddings GROUP BY ALL)
SELECT run, tta, macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY macro_f1 DESC, tta = 'hflip' DESC, tta DESC) AS k FROM v) WHERE k = 1""")
def best_tta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tta = F.element_at(F.array(*map(F.lit, ("none", "hflip", "flips"))), (F.col("vec_id") % 3 + 1).cast("int"))
    runs = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("run"), tta.alias("tta")).agg(F.round(F.avg(F.col("vec_id") % 5), 1).alias("macro_f1"))
    return reports.best_views(runs, ["run"]).select("run", "tta", "macro_f1")


@named("SELECT DISTINCT label AS truth FROM embeddings WHERE label NOT IN (0, 1, 2, 5)")
def unknown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.classes import unknown

    return unknown(c.truth(spark, sf_dir), [0, 1, 2, 5])


@named(f"WITH {c.TRUTH_SQL} SELECT 'per_class' AS part, class::VARCHAR AS name, f1 AS value FROM f UNION ALL SELECT 'overall', 'accuracy', round((SELECT sum(n) FROM m WHERE truth = predicted)::DOUBLE / (SELECT sum(n) FROM m), 4) UNION ALL SELECT 'misclassified', truth::VARCHAR, count(*)::DOUBLE FROM t WHERE truth <> predicted GROUP BY truth")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = classify.evaluate(c.truth(spark, sf_dir), CLASSES)
    per = e["per_class"].select(F.lit("per_class").alias("part"), F.col("class").cast("string").alias("name"), F.col("f1").alias("value"))
    wrong = e["misclassified"].groupBy(F.col("truth").cast("string")).agg(F.count("*").cast("double").alias("value"))
    return per.union(e["overall"].select(F.lit("overall"), F.lit("accuracy"), "accuracy")).union(wrong.select(F.lit("misclassified"), "truth", "value"))


@named(f"WITH {c.HASH_SQL} SELECT id_a, id_b, distance, row_number() OVER (ORDER BY distance, id_a, id_b) AS place FROM pair")
def near_images_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_images.near_pairs(c.document_hashes(spark, sf_dir), 4)
    return near_images.by_distance(pairs).select("id_a", "id_b", "distance", "place")


# ------------------------------------------------------------------ listings and settings
@named("""WITH p AS (SELECT page_id, '/data/set/' || (['train', 'valid', 'test'])[page_id % 3 + 1] || '/class' || page_id % 7 || '/' || CASE WHEN page_id % 11 = 0 THEN '._' ELSE '' END || 'p' || page_id || (['.jpg', '.PNG', '.txt'])[page_id % 5 % 3 + 1] AS path FROM pages)
SELECT path, (['train', 'valid', 'test'])[page_id % 3 + 1] AS split, 'class' || page_id % 7 AS class FROM p WHERE page_id % 5 % 3 < 2 AND page_id % 11 <> 0""")
def image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")

    def one_of(values: tuple[str, ...], at) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))

    name = F.concat(F.when(k % 11 == 0, "._").otherwise(""), F.lit("p"), k.cast("string"), one_of((".jpg", ".PNG", ".txt"), k % 5 % 3))
    path = F.concat(F.lit("/data/set/"), one_of(("train", "valid", "test"), k % 3), F.lit("/class"), (k % 7).cast("string"), F.lit("/"), name)
    found = listings.matching(table(spark, sf_dir, "pages").select(path.alias("path")), listings.IMAGE)
    return listings.by_folder(found, "/data/set").select("path", "split", "class")


@named("""WITH p AS (SELECT page_id, length(html) * 400 AS size, CASE page_id % 4 WHEN 0 THEN '.git/x.py' WHEN 1 THEN 'pkg/m.py' WHEN 2 THEN 'docs/n.ipynb' ELSE 'a/venv/y.md' END AS path FROM pages)
SELECT page_id, path FROM p WHERE page_id % 4 IN (1, 2) AND (size <= 5000000 OR page_id % 4 = 2)""")
def repository_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    path = F.when(k == 0, ".git/x.py").when(k == 1, "pkg/m.py").when(k == 2, "docs/n.ipynb").otherwise("a/venv/y.md")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), (F.length("html") * 400).cast("long").alias("length"))
    return rows.where(listings.worth_chunking(F.col("path"), F.col("length"))).select("page_id", "path")


@named("""SELECT p_partkey, trim(regexp_replace(upper(trim(p_name || ' (' || p_brand || ')')), '[^A-Z0-9]+', '_', 'g'), '_') AS label, lower(regexp_replace('{http://x/1}' || p_type, '^.*[}:]', '')) AS tag,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE 'a/' || p_size END AS folder FROM part""")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    relative = F.concat(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("a/"), F.col("p_size").cast("string"), F.lit("/"))), F.lit("f.jpg"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", names.setting_label(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("label"), names.local_tag(F.concat(F.lit("{http://x/1}"), "p_type")).alias("tag"), names.parent_folder(relative).alias("folder")
    )


# ------------------------------------------------------------------ texts and chunks
@named("""SELECT doc_id, source || '.md' || CASE doc_id % 6 WHEN 0 THEN ' (cell 3, lines 2-9)' WHEN 1 THEN ' (cell 3)' WHEN 2 THEN ' (page 4)' WHEN 3 THEN ' (slide 5)' WHEN 4 THEN ' (lines 2-9)' ELSE '' END AS cite FROM documents""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    lined = F.when(k.isin(0, 4), F.lit(2)).otherwise(F.lit(0))
    none = F.lit(None).cast("int")
    cite = texts.cite(F.concat("source", F.lit(".md")), lined, F.lit(9), F.when(k < 2, 3).otherwise(none), F.when(k == 2, 4).otherwise(none), F.when(k == 3, 5).otherwise(none))
    return table(spark, sf_dir, "documents").select("doc_id", cite.alias("cite"))


@named("""SELECT doc_id, source || '/' || doc_id || '.md s' || doc_id || ' section def f(x)  near ' || lang || chr(10) || text AS said FROM documents""")
def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct(F.lit("def f(x)").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.concat(F.lit("near "), "lang").alias("context"))
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name"), F.lit("section").alias("kind"), meta.alias("meta"), "text")
    return rows.select("doc_id", texts.index_text().alias("said"))


@named("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, len(x) AS lines, array_to_string(CASE WHEN len(x) > 70 THEN x[1:15] || ['... [log truncated] ...'] || x[len(x) - 54:] ELSE x END, chr(10)) AS shown FROM l""")
def log_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.array_join(texts.trimmed_log(lines), "\n").alias("shown"))


@named("""SELECT doc_id, length(text) > 20000 AS truncated, CASE WHEN length(text) > 20000 THEN left(text, 20000) ELSE text END AS preview FROM documents""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = texts.preview(F.col("text"))
    cut = F.length("text") > 20_000
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("truncated"), F.when(cut, F.get_json_object(said, "$.preview")).otherwise(said).alias("preview"))


@named("""SELECT source, string_agg('[' || k || '] ' || 'corpus/' || source || ' ' || lang || chr(10) || '```' || chr(10) || doc_id || chr(10) || '```', chr(10) || chr(10) ORDER BY k) AS context
FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY source""")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("repo"), F.col("source").alias("path"), F.col("lang").alias("name"), F.col("doc_id").cast("string").alias("text"), place.alias("group_no")).where("group_no <= 3")
    return search.context(d, by=("path",)).select(F.col("path").alias("source"), "context")


@named("""WITH d AS (SELECT doc_id, text, lang FROM documents WHERE lang IN ('en', 'de')) SELECT lang AS repo, count(*) AS files, sum(length(text))::BIGINT AS chars FROM d GROUP BY lang""")
def library_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .library import union_files

    d = table(spark, sf_dir, "documents")
    parts = [d.where(F.col("lang") == x).select(F.lit(x).alias("repo"), F.col("doc_id").cast("string").alias("path"), "text") for x in ("en", "de")]
    return union_files(parts).groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))
