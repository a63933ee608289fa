import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thalweg.functions import text as T
from thalweg.operators import search
from thalweg.plans.assistant import Assistant, BackendError, Tools
from thalweg.plans.library import Library
from thalweg.sources import chunks, settings as conf


def plain_tokens(text):
    out = []
    for word in re.findall(T.WORD, text):
        sub = []
        for part in re.split("[_.]+", word):
            sub += [p.lower() for p in re.findall(r"[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[A-Z]+|[0-9]+", part)]
        if len(sub) > 1:
            out.append(word.lower().strip("_"))
        out += sub or [word.lower()]
    return [t for t in out if len(t) > 1 and t not in T.STOP]


def test_tokens(spark):
    said = ["read_gpsTrack HTTPServer2 x 2.50 the __ _a_b_ parseXML3Files camelCase", "", None, "ABcd12Ef_gH"]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(T.tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [plain_tokens(s or "") for s in said]


def test_redact(spark):
    said = ["api_key = 'abcdefgh' x", 'Password: "longsecret"', "token='short'", "sk-" + "a" * 20, "AKIA" + "B" * 16, "secret = \"mixed'quote\""]
    got = [r.x for r in spark.createDataFrame([(s,) for s in said], "t string").select(T.redact(F.col("t")).alias("x")).collect()]
    assert got == ["api_key = '<REDACTED>' x", 'Password: "<REDACTED>"', "token='short'", "<REDACTED>", "<REDACTED>", said[5]]


def test_bm25_by_hand(spark):
    docs = [(0, "reef coral coral"), (1, "sand coral"), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(0, "coral reef coral")], "query_id long, query string")
    got = {r.doc_id: r.bm25 for r in search.bm25(search.postings(df), search.doc_lengths(df), q).collect()}
    bags, avg = [Counter(plain_tokens(t)) for _, t in docs], 5 / 3
    for i in (0, 1):
        want = 0.0
        for term in ("coral", "reef"):
            df_ = sum(term in b for b in bags)
            f = bags[i][term]
            want += math.log(1 + (3 - df_ + 0.5) / (df_ + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * sum(bags[i].values()) / avg))
        assert math.isclose(got[i], want)
    assert 2 not in got


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200))
def test_ranks(spark, scores):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "doc_id long, s double")
    got = {r.doc_id: r.k for r in search.ranked(df, "s", "doc_id", "k").collect()}
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    assert [got[i] for i in order] == list(range(1, len(scores) + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2500), max_size=80))
def test_pieces_cover_and_progress(sizes):
    lines = ["x" * n for n in sizes]
    cuts = chunks.pieces(lines)
    assert [a for a, _ in cuts] == sorted({a for a, _ in cuts})
    assert {k for a, b in cuts for k in range(a, b)} == set(range(len(lines)))
    assert all(b - a == 1 or sum(map(len, lines[a:b])) + b - a - 1 <= chunks.CAP for a, b in cuts)


PY = '''"""About."""
import os
from math import sqrt

LIMIT = 10_000_000_000

# adds one
@decorated
def add(x, y=1):
    """Adds."""
    return helper(x) + y

class Box:
    pass

if __name__ == "__main__":
    add(1)
'''


def test_chunks():
    found = {c["kind"]: c for c in chunks.chunks_of("pkg/a.py", PY)}
    assert found["function"]["start_line"] == 7 and found["function"]["meta"]["signature"] == "def add(x, y=1)" and found["function"]["meta"]["calls"] == ["helper"]
    assert found["module"]["meta"]["docstring"] == "About." and found["class"]["name"] == "Box" and found["script-main"]["name"].startswith("a.py __main__")
    assert found["class"]["meta"]["imports"] == ["from math import sqrt", "import os"]
    assert [c["kind"] for c in chunks.chunks_of("a.py", "def broken(:\n")] == ["module"]
    md = chunks.chunks_of("r/a.md", "intro\n# A\nx\n```\n# no\n```\n## B\ny\n# C\nz")
    assert [c["name"] for c in md] == ["a.md", "A", "A > B", "C"]
    nb = '{"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": ["!ls\\n", "def f():\\n", "  return 1\\n"], "outputs": [{"output_type": "stream", "text": ["%s"]}]}]}' % ("w" * 90)
    kinds = [(c["kind"], c["name"]) for c in chunks.chunks_of("n.ipynb", nb)]
    assert kinds == [("cell", "markdown cell 0"), ("function", "f"), ("cell-output", "output of code cell 1")]
    assert chunks.chunks_of("a.bin", "x") == [] and chunks.chunks_of("a.json", "{}")[0]["kind"] == "file"


def test_library(spark, tmp_path):
    long = "def survey_track():\n" + "\n".join(f"    step_{k} = 'track point number {k} in the survey track'" for k in range(120))
    files = spark.createDataFrame([("r", "pkg/tracks.py", long), ("r", "pkg/other.py", "def colour(x):\n    return x  # nothing of interest here"), ("r", "bad.ipynb", "{")], "repo string, path string, text string")
    lib = Library.build(files, str(tmp_path / "lib"))
    hits = lib.search("how does survey_track work", k=3).collect()
    assert hits and all(h.path == "pkg/tracks.py" and h.fused > 0 for h in hits)
    got = lib.retrieve("survey_track point", k=2).collect()
    assert got[0].name == "survey_track (3 relevant parts)" and got[0].pieces == 3
    assert lib.search("colour", path_filter="tracks").count() == 0
    assert [r.line for r in lib.repo_map().collect()] == ["- r/pkg/other.py: def colour(x)", "- r/pkg/tracks.py: def survey_track()"]
    reply = lib.ask("what is colour", answer=lambda m: f"{len(m)} messages")
    assert reply["answer"] == "1 messages" and "colour" in reply["context"]
    assert chunks.chunk_files(files, errors=True).where("error IS NOT NULL").count() == 1


def test_excerpt_gaps(spark):
    rows = [(1, "f (part 1/4)", "a\nb\nc", 1, 3, 0.9), (2, "f (part 2/4)", "c\nd", 3, 4, 0.5), (3, "f (part 4/4)", "z", 9, 9, 0.7), (4, "g", "g", 1, 1, 0.8)]
    df = spark.createDataFrame([(i, "r", "p", "function", n, None, t, s, e, x) for i, n, t, s, e, x in rows], "doc_id long, repo string, path string, kind string, name string, cell int, text string, start_line int, end_line int, fused double")
    got = search.excerpts(df, 2).collect()
    assert got[0].text == "a\nb\nc\nd\n    # ... (lines omitted) ...\nz" and (got[0].start_line, got[0].end_line) == (1, 9)
    assert (got[1].name, got[1].text) == ("g", "g")


def test_assistant():
    tools = Tools()

    def double(x):
        return {"value": 2 * x}

    tools.add(double, "doubles", {"x": {"type": "number"}}, ("x",))
    assert "error" in tools("nope", {}) and "error" in tools("double", {})
    waits, calls = [], []

    def shaky(messages, schemas):
        calls.append("shaky")
        raise BackendError("busy", 503)

    def gone(messages, schemas):
        calls.append("gone")
        raise BackendError("no model", 404)

    def good(messages, schemas):
        if messages[-1]["role"] == "tool":
            return {"content": messages[-1]["content"]}
        return {"content": "", "tool_calls": [{"id": "1", "name": "double", "arguments": {"x": 4}}]}

    a = Assistant([shaky, gone, good], tools, sleep=waits.append)
    assert a.run("please") == '{"value": 8}'
    assert waits[:2] == [2, 4] and calls[:4] == ["shaky"] * 3 + ["gone"]
    assert [m["role"] for m in a.messages] == ["user", "assistant", "tool", "assistant"]


def test_settings(tmp_path, monkeypatch):
    f = tmp_path / "s.txt"
    f.write_text("# x\nexport LLM KEY: 'abc' \nmodel=m1 # note\n\nbase-url: https://h/v1\n")
    assert conf.parse(f) == {"LLM_API_KEY": "abc", "LLM_MODEL": "m1", "LLM_BASE_URL": "https://h/v1"}
    monkeypatch.setenv("LLM_MODEL", "kept")
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    monkeypatch.delenv("LLM_BASE_URL", raising=False)
    assert sorted(conf.load(str(f))) == ["LLM_API_KEY", "LLM_BASE_URL"]
    f.write_text("nonsense: 1")
    try:
        conf.parse(f)
        raise AssertionError
    except ValueError as e:
        assert "nonsense" in str(e)
    assert conf.take_option(["a", "--settings=x", "b"]) == ("x", ["a", "b"])


def test_merge_parts_searches_all_chunks(spark, tmp_path):
    from thalweg.plans import catalogue

    long = "\n".join(f"line {k} about reefs and sand" for k in range(400)) + "\nzebra walrus"
    docs = [(1, "zebra walrus heron", "src1"), (2, "walrus only", "src7"), (3, long, "src9"), (4, "nothing here", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    padded = "so " * 30 + "heron"  # its term comes late in the text
    spark.createDataFrame([(0, "zebra walrus"), (20, padded), (7, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.path) for r in catalogue.merge_parts(spark, str(tmp_path)).collect()}
    assert got == {(0, "src1/1.md"), (0, "src7/2.md"), (0, "src9/3.md"), (20, "src1/1.md")}


def test_dense_search_in_small_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in rng.permutation(300)] + [(900, None), (901, [1.0])]
    docs = spark.createDataFrame(v, "doc_id long, vector array<double>").repartition(3)
    asked = docs.where("doc_id % 20 = 0 AND doc_id < 900").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(search, "CELLS", 40)  # two vectors at once for 15 queries
    got = {(r.query_id, r.doc_id): r.dense for r in search.dense_over(docs, asked, 8).collect()}
    rows = {i: np.array(x) for i, x in v[:300]}
    want = {(q, d): float(rows[q] @ rows[d]) for q in range(0, 300, 20) for d in sorted(rows, key=lambda d: (-(rows[q] @ rows[d]), d))[:8]}
    assert got == want
    best, d = search.Best(15, 8), rng.integers(-3, 3, (15, 500)) / 7
    for at in range(0, 500, 9):
        best.add(d[:, at : at + 9], np.arange(500)[at : at + 9])
    assert (best.doc == np.lexsort((np.broadcast_to(np.arange(500), d.shape), -np.round(d, 9)), axis=1)[:, :8]).all()


def test_chunks_come_in_bounded_tables(spark, monkeypatch):
    text = "\n".join(f"# part {k}\nline {k}" for k in range(100))
    files = spark.createDataFrame([("r", f"{k}.md", text) for k in range(4)], "repo string, path string, text string").coalesce(1)
    monkeypatch.setattr(chunks, "AT_ONCE", 7)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = chunks.chunk_files(files)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "250"
    assert sorted((r.path, r.start_line) for r in got.select("path", "start_line").collect()) == [(f"{k}.md", 2 * i + 1) for k in range(4) for i in range(100)]


def test_merge_parts_chunks_files_once(spark, tmp_path):
    from thalweg.plans import catalogue

    docs = [(k, f"zebra walrus {k}", "src1") for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaves = catalogue.merge_parts(spark, str(tmp_path))._jdf.queryExecution().withCachedData().collectLeaves()
    read = [leaves.apply(k).output().mkString() for k in range(leaves.size())]
    assert len(read) > 1 and not [x for x in read if "source#" in x]  # documents only below what is cached
