"""Files in and out: EXIF, outputs, tools, backends, the command line."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_geotag import GPX
from thalweg import __main__ as cli
from thalweg import log
from thalweg.plans import backends, classify, outputs, survey
from thalweg.plans.assistant import Assistant, BackendError, Tools
from thalweg.plans.tools import SurveyTools, survey_tools
from thalweg.plans.training import Training
from thalweg.sources import adapters, exif, gpx, media, repositories

JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xda\x00\x02image data\xff\xd9"
NAMES = ["sand", "seagrass"]


def test_exif_round_trip(spark, tmp_path):
    tagged = exif.write(JPEG, [(14, 1), (7, 1), (244416, 10000)], "S", [(121, 1), (39, 1), (155556, 10000)], "E", "a note", "2025:05:13 09:00:00", "+08:00")
    assert tagged.endswith(b"image data\xff\xd9") and b"JFIF" in tagged
    found = exif.read(tagged)
    assert found["lat"] == [(14, 1), (7, 1), (244416, 10000)] and found["description"] == "a note" and found["taken"] == "2025:05:13 09:00:00" and found["offset"] == "+08:00"
    again = exif.read(exif.write(tagged, description="b"))
    assert again == {"description": "b"}
    (tmp_path / "a.jpg").write_bytes(tagged)
    (tmp_path / "b.jpg").write_bytes(JPEG)
    (tmp_path / "c.jpg").write_bytes(b"nonsense")
    rows = {r.path[-5:]: r for r in exif.read_tags(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.jpg"].lat == pytest.approx(-14.123456, abs=1e-7) and rows["a.jpg"].lon == pytest.approx(121.654321, abs=1e-7)
    assert rows["b.jpg"].lat is None and rows["c.jpg"].description is None


def stubs():
    """Local functions: they go to executors by value, as this module isn't there."""

    def model():
        return lambda paths, view: np.array([[0.9, 0.1] if "05" in p[-6:] else [0.2, 0.8] for p in paths])

    def probe(path):
        return {"create_date": "2025:05:13 09:00:00", "creation_time": None, "duration_s": 10.0}

    return model, probe


model, probe = stubs()


def survey_folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gpx").write_text(GPX)
    for name in ("GH010001.MP4", "GH020001.MP4", "clip.mp4", "._x.mp4"):
        (tmp_path / "in" / name).write_bytes(b"x")
    return str(tmp_path / "in")


def test_tools_process_verify_and_classify(spark, tmp_path):
    videos, out = survey_folder(tmp_path), str(tmp_path / "out")
    own = SurveyTools(spark, model=model, class_names=NAMES, probe=probe)
    tools = survey_tools(own)
    assert len(tools.schemas) == 7 and all(s["description"] and s["parameters"]["required"] for s in tools.schemas)
    assert tools("list_folder", {"path": str(tmp_path)})["folders"] == [{"dir": "in", "videos": 3, "gpx": 1, "jpg": 0}]
    seen = tools("inspect_survey", {"videos_dir": videos})
    assert {r["recording"]: r["n_chapters"] for r in seen["recordings"]} == {"GH0001": 2, "clip": 1}
    assert "error" in tools("process_survey", {"videos_dir": videos, "output_dir": videos + "/x"})
    (tmp_path / "out").mkdir()
    (tmp_path / "out/notes.txt").write_text("mine")
    said = tools("process_survey", {"videos_dir": videos, "output_dir": out, "interval_s": 5, "recordings": ["GH0001"]})
    assert said["status_counts"] == {"ok": 4} and said["classification"]["class_counts"] == {"sand": 1, "seagrass": 3}
    assert (tmp_path / "out/notes.txt").read_text() == "mine"
    report = json.loads(spark.read.text(out + "/report").first().value)
    assert report["classification"] == said["classification"] and report["frames"] == 4
    features = [json.loads(r.value) for r in spark.read.text(out + "/frames_geojson").collect()]
    assert {f["properties"]["benthic_class"] for f in features} == {"sand", "seagrass"} and all(f["geometry"]["coordinates"] for f in features)
    rows = spark.read.option("header", "true").csv(out + "/frames_csv").collect()
    assert len(rows) == 4 and {r.benthic_class for r in rows} == {"sand", "seagrass"}
    # pictures with the tags of the table, but one
    frames = adapters.exif_columns(spark.read.parquet(out + "/frames")).withColumn("content", F.lit(bytearray(JPEG)))
    (tmp_path / "out/geotagged").mkdir()
    for r in exif.tagged_images(frames.select("frame_filename", "content", "lat_dms", "lat_ref", "lon_dms", "lon_ref", "image_description")).collect():
        (tmp_path / "out/geotagged" / r.frame_filename).write_bytes(r.content if "00.jpg" not in r.frame_filename else JPEG)
    checks = tools("verify_geotags", {"output_dir": out, "n": 4})
    assert checks.get("checked") == 4, checks
    assert not checks["all_have_gps"]
    assert [c["has_gps"] for c in sorted(checks["samples"], key=lambda c: c["frame_filename"])] == [False, True, True, True]
    assert all(c["max_error_m"] <= 0.1 for c in checks["samples"] if c["has_gps"])
    joined = tools("concatenate_recordings", {"videos_dir": videos, "output_dir": str(tmp_path / "joined")})
    assert joined["single_chapter_recordings_skipped"] == ["clip"] and [r["recording"] for r in joined["concatenated"]] == ["GH0001"]
    assert "error" in tools("search_documents", {"query": "x"}) and "error" in survey_tools(SurveyTools(spark))("classify_frames", {"output_dir": out})
    gone = outputs.clear(spark, out)
    assert {"frames", "report", "geotagged"} <= set(gone) and (tmp_path / "out/notes.txt").exists()
    with pytest.raises(ValueError):
        outputs.clear(spark, out, ("notes.txt",))


def test_reclassification_and_failed_classification(spark, tmp_path):
    videos, out = survey_folder(tmp_path), str(tmp_path / "out")
    own = SurveyTools(spark, model=model, class_names=NAMES, probe=probe)
    own.process_survey(videos, out, interval_s=5)
    again = own.classify_frames(out, conf=0.95)
    assert again["class_counts"] == {"uncertain": 6}
    assert {r.benthic_class for r in spark.read.parquet(out + "/frames").where("status = 'ok'").collect()} == {"uncertain"}

    def broken():
        raise RuntimeError("no weights")

    said = SurveyTools(spark, model=broken, class_names=NAMES, probe=probe).process_survey(videos, out, interval_s=5)
    assert "no weights" in said["classification"]["error"] and said["status_counts"]["ok"] > 0


def test_metrics_summary_and_plots(spark, tmp_path):
    truth = [("seagrass", "seagrass"), ("seagrass", "seagrass"), ("seagrass", "sand"), ("sand", "sand")]
    rows = spark.createDataFrame([(f"i{k}", t, p) for k, (t, p) in enumerate(truth)], "image string, truth string, predicted string")
    e = classify.evaluate(rows, NAMES)
    outputs.write_metrics(e, str(tmp_path))
    m = spark.read.json(f"{tmp_path}/metrics").first()
    assert m.accuracy == 0.75 and len(m.confusion) == 4 and [c["class"] for c in m.per_class] == NAMES
    assert [r.image for r in spark.read.option("header", "true").csv(f"{tmp_path}/misclassified").collect()] == ["i2"]
    images = spark.createDataFrame([(f"/d/dive{k % 2}/{k}.jpg", f"{k}.jpg", [0.9, 0.1], None if k == 5 else 1.0) for k in range(6)], "path string, name string, probs array<double>, latitude double")
    said = outputs.write_image_summary(classify.classify_images(images, NAMES, "/d"), str(tmp_path))
    assert said == {"images": 6, "with_gps": 5, "class_counts": {"sand": 6}}
    frames = spark.createDataFrame([("ok", 1.0, 2.0, None, "sand")], "status string, latitude double, longitude double, depth_m double, benthic_class string")
    track = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lon double, depth double")
    tables = outputs.plot_tables(frames, track, e["confusion"])
    assert {k: v.count() for k, v in tables.items()} == {"positions": 2, "classes": 1, "confusion": 4}
    bad = tables["classes"].select(F.raise_error(F.lit("no")).alias("x"))
    assert outputs.write_plot_tables(tables | {"bad": bad}, str(tmp_path))["classes"] == "written"
    assert Training().arguments()["epochs"] == 100 and "fliplr" in Training().arguments()


def test_fallback_stays_for_the_request():
    calls = []

    class Backend:
        def __init__(self, name, replies):
            self.name, self.replies = name, iter(replies)

        def __call__(self, messages, schemas):
            calls.append(self.name)
            r = next(self.replies)
            if isinstance(r, Exception):
                raise r
            return r

    busy, tool = BackendError("busy", 503), {"content": "", "tool_calls": [{"id": "1", "name": "nope", "arguments": {}}]}
    first = Backend("first", [busy, busy, busy, {"content": "hello"}])
    second = Backend("second", [tool, tool, {"content": "done"}])
    said, waits = [], []
    a = Assistant([first, second], Tools(), sleep=waits.append, verbose=said.append)
    assert a.run("x") == "done" and calls == ["first"] * 3 + ["second"] * 3 and waits == [2, 4] and any("gave up" in s for s in said)
    assert a.run("y") == "hello" and calls[-1] == "first"
    assert "No model" in Assistant([Backend("b", [BackendError("gone", 404)])], Tools(), sleep=waits.append).run("z")
    lines = iter(["hi", "reset", "exit"])
    out = []
    b = Assistant([Backend("c", [{"content": "yo"}])], Tools())
    b.chat(lambda _: next(lines), out.append)
    assert out == ["yo"] and b.messages == []
    assert log.switch(False)("x") is None and log.switch(said.append) == said.append


def test_backends():
    sent = []

    def send(reply):
        def f(url, body, headers):
            sent.append((url, body, headers))
            return reply

        return f

    talk = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "", "tool_calls": [{"id": "c1", "name": "f", "arguments": {"x": 1}}]}, {"role": "tool", "id": "c1", "name": "f", "content": "{}"}]
    schemas = [{"name": "f", "description": "", "parameters": {"type": "object", "properties": {}}}]
    chat = backends.make("chat", "m", "k", "https://h/v1/", send({"choices": [{"message": {"content": None, "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": '{"x": 2}'}}]}}]}))
    assert chat(talk, schemas) == {"content": "", "tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 2}}]}
    url, body, headers = sent[-1]
    assert url == "https://h/v1/chat/completions" and headers == {"Authorization": "Bearer k"} and body["messages"][3] == {"role": "tool", "tool_call_id": "c1", "content": "{}"}
    gen = backends.make("generate", "m", "k", "https://h/v1", send({"candidates": [{"content": {"parts": [{"text": "a"}, {"functionCall": {"name": "f", "args": {"x": 3}}}]}}]}))
    assert gen(talk, schemas) == {"content": "a", "tool_calls": [{"id": "call-1", "name": "f", "arguments": {"x": 3}}]}
    url, body, _ = sent[-1]
    assert url.endswith("/models/m:generateContent") and body["systemInstruction"] == {"parts": [{"text": "s"}]} and [c["role"] for c in body["contents"]] == ["user", "model", "user"]
    for kind, reply, code in (("chat", {"choices": []}, 502), ("generate", {}, 502), ("chat", {"error": {"message": "slow", "code": 429}}, 429)):
        with pytest.raises(BackendError) as e:
            backends.make(kind, "m", "k", "https://h", send(reply))(talk, [])
        assert e.value.code == code
    with pytest.raises(BackendError) as e:
        backends.post("http://127.0.0.1:9/x", {}, {})
    assert e.value.code == 503
    for bad in (("other", "k"), ("chat", None)):
        with pytest.raises(ValueError):
            backends.make(bad[0], "m", bad[1], "https://h")


def test_repositories_and_media(tmp_path, spark):
    ran = []

    def execute(args, timeout):
        ran.append(args[1:])
        return ""

    assert repositories.resolve(str(tmp_path)) == tmp_path
    got = repositories.resolve("https://h/a/tools.git", str(tmp_path / "r"), execute)
    assert got == tmp_path / "r/tools" and ran[-1][:3] == ["clone", "--depth", "1"]
    (got / ".git").mkdir(parents=True)
    repositories.resolve("https://h/a/tools.git", str(tmp_path / "r"), execute)
    assert ran[-1][2:] == ["pull", "--ff-only"]
    with pytest.raises(FileNotFoundError):
        repositories.resolve("nowhere")
    with pytest.raises(RuntimeError):
        repositories.resolve("https://h/b", str(tmp_path / "r"), lambda *_: None)
    assert media.chapter_list(["file:/a/b'c.mp4"]) == "file '/a/b'\\''c.mp4'\n"
    assert "fps=1/0.5,scale='min(800,iw)':-2" in media.frame_command("l", "t", 0.5, 800)
    recs = spark.createDataFrame([("r1", ["a", "b"])], "recording string, paths array<string>")
    done = media.each_recording(recs, media.concat_command, str(tmp_path / "o"), ".mp4", lambda a, t: "").first()
    assert done.done and done.target.endswith("/o/r1.mp4")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    monkeypatch.setattr("thalweg.session.build", lambda *a, **k: spark)
    assert cli.main(["query"]) == 0 and "asof_interpolate" in capsys.readouterr().out
    assert cli.main(["query", "nope", "x"]) == 2
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "a.py").write_text("def survey_track(x):\n    return x  # of the track\n")
    assert cli.main(["build", str(tmp_path / "lib"), str(repo)]) == 0 and json.loads(capsys.readouterr().out)["chunks"] == 1
    assert cli.main(["search", str(tmp_path / "lib"), "survey_track", "--only", "a.py"]) == 0
    assert json.loads(capsys.readouterr().out)["hits"][0]["cite"] == "a.py (lines 1-2)"
    assert cli.main(["ask", str(tmp_path / "lib"), "survey_track"]) == 0 and "survey_track" in json.loads(capsys.readouterr().out)["context"]
    monkeypatch.setattr("sys.stdin", iter(["survey_track\n", "\n"]))
    assert cli.main(["chat", str(tmp_path / "lib")]) == 0 and "survey_track" in capsys.readouterr().out
    images = tmp_path / "pics/dive"
    images.mkdir(parents=True)
    (images / "x_05.jpg").write_bytes(exif.write(JPEG, [(1, 1), (0, 1), (0, 1)], "N", [(2, 1), (0, 1), (0, 1)], "E"))
    (images / "y.jpg").write_bytes(JPEG)
    monkeypatch.setattr(cli, "loader", lambda spec: (model, NAMES) if spec else (None, []))
    assert cli.main(["classify-images", str(tmp_path / "pics"), str(tmp_path / "done"), "--model", "m"]) == 0
    assert json.loads(capsys.readouterr().out) == {"class_counts": {"sand": 1, "seagrass": 1}, "images": 2, "with_gps": 1}
    assert cli.main(["classify", str(tmp_path / "done")]) == 1
    assert "error" in json.loads(capsys.readouterr().out)


def test_only_named_recordings(spark):
    tr = spark.createDataFrame([(0, 1.0, 1.0, None)], "t long, lat double, lon double, depth double")
    files = spark.createDataFrame([("v", f"v/{s}.MP4", s, datetime(2025, 5, 13, 9), 2.0) for s in ("GH010001", "GH010002")], "parent string, path string, stem string, start_local timestamp_ntz, duration_s double")
    assert {r.recording for r in survey.process(files, [tr], only=["GH0002"]).collect()} == {"GH0002"}
    assert gpx.points(GPX)[0][1] == 14.5
