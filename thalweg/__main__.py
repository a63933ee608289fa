"""python -m thalweg VERB ...: surveys, classification, documents, the assistant, and named queries.

Settings files (--settings PATH, anywhere) fill the environment before options take their defaults from it.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from .sources import settings


def loader(spec: str | None):
    """module:function, which loads a classifier and has class_names, as (function, names)."""
    if not spec:
        return None, []
    module, _, name = spec.partition(":")
    f = getattr(importlib.import_module(module), name)
    return f, list(f.class_names)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m thalweg", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *places: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for x in places:
            v.add_argument(x.rstrip("?"), nargs="?" if x.endswith("?") else None)
        return v

    model = os.environ.get("CLASSIFIER_MODEL")
    for v in (verb("inspect", "videos_dir"), verb("process", "videos_dir", "output_dir")):
        v.add_argument("--gpx")
        v.add_argument("--tz", default="Asia/Manila")
        v.add_argument("--clock-offset", type=float, default=0.0)
        if v.prog.endswith("process"):
            v.add_argument("--interval", type=float, default=1.0)
            v.add_argument("--max-gap", type=float, default=60.0)
            v.add_argument("--recording", action="append")
            v.add_argument("--model", default=model)
    for v in (verb("classify", "output_dir"), verb("classify-images", "input_dir", "output_dir")):
        v.add_argument("--model", default=model)
        v.add_argument("--conf", type=float, default=0.0)
        v.add_argument("--tta", choices=["none", "hflip", "flips"], default="hflip")
        v.add_argument("--smooth", type=float, default=0.0)
    v = verb("build", "folder")
    v.add_argument("repositories", nargs="+")
    for v in (verb("search", "folder", "question"), verb("ask", "folder", "question"), verb("chat", "folder")):
        v.add_argument("-k", type=int, default=8)
        v.add_argument("--only", help="a part of the path")
    v = verb("agent", "request?")
    v.add_argument("--documents", help="a folder made by build")
    v.add_argument("--model", default=model)
    v.add_argument("--verbose", action="store_true")
    verb("query", "name?", "sf_dir?", "out?")
    return p


def backend():
    from .plans.backends import make

    kind = os.environ.get("LLM_KIND", "chat")
    return make(kind, os.environ.get("LLM_MODEL", ""), os.environ.get("LLM_API_KEY"), os.environ.get("LLM_BASE_URL", ""))


def answerer():
    """A function from messages to text if a model is set, else none."""
    if not os.environ.get("LLM_API_KEY"):
        return None
    b = backend()
    return lambda messages: b(messages, [])["content"]


def main(argv: list[str]) -> int:
    given, argv = settings.take_option(argv)
    settings.load(given)
    a = parser().parse_args(argv)
    if a.verb == "query" and not (a.name and a.sf_dir):
        from .plans.catalogue import QUERIES

        print(*sorted(QUERIES), sep="\n")
        return 0
    from .session import build

    spark = build()

    def show(result: dict) -> int:
        print(json.dumps(result, indent=2, default=str))
        return 1 if "error" in result else 0

    if a.verb == "query":
        from .plans.catalogue import QUERIES

        if a.name not in QUERIES:
            print(f"no query {a.name!r}", file=sys.stderr)
            return 2
        rows = QUERIES[a.name](spark, a.sf_dir)
        rows.write.mode("overwrite").parquet(a.out) if a.out else rows.show(50, truncate=False)
        return 0
    if a.verb in ("build", "search", "ask", "chat"):
        return documents(a, spark, show)
    from .plans.tools import SurveyTools, survey_tools

    load, names = loader(getattr(a, "model", None))
    tools = SurveyTools(spark, model=load, class_names=names)
    if a.verb == "inspect":
        return show(tools.inspect_survey(a.videos_dir, a.gpx, a.tz, a.clock_offset))
    if a.verb == "process":
        return show(tools.process_survey(a.videos_dir, a.output_dir, a.gpx, a.interval, a.tz, a.clock_offset, a.max_gap, a.recording))
    if a.verb == "classify":
        return show(tools.classify_frames(a.output_dir, a.conf, a.smooth))
    if a.verb == "classify-images":
        from .plans import classify, outputs
        from .sources import adapters, exif, listings

        if not load:
            return show({"error": "no model is set to classify with"})
        found = listings.find_files(spark, a.input_dir, listings.IMAGE, outside=a.output_dir)
        if not found.limit(1).count():
            return show({"error": f"no images in {a.input_dir}"})
        tags = exif.read_tags(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.input_dir).where("lower(path) rlike '[.]jpe?g$'"))
        positions = tags.selectExpr("path", "lat AS latitude", "lon AS longitude")
        images = adapters.predict(found.select("path", "name"), load, a.tta).join(positions, "path", "left")
        return show(outputs.write_image_summary(classify.classify_images(images, names, a.input_dir, a.conf), a.output_dir))
    from .plans.assistant import Assistant
    from .plans.library import Library

    if a.documents:
        tools.library = Library.load(spark, a.documents)
    helper = Assistant([backend()], survey_tools(tools), verbose=a.verbose)
    print(helper.run(a.request)) if a.request else helper.chat()
    return 0


def documents(a: argparse.Namespace, spark, show) -> int:
    from .plans.library import Library, union_files
    from .sources import listings
    from .sources.repositories import resolve

    if a.verb == "build":
        found = union_files([listings.repository_files(spark, str(resolve(r))) for r in a.repositories])
        return show({"chunks": Library.build(found, a.folder).chunks.count()})
    library = Library.load(spark, a.folder)
    if a.verb == "search":
        return show({"hits": [r.asDict() for r in library.cites(library.search(a.question, a.k, path_filter=a.only)).select("cite", "name", "fused").collect()]})
    if a.verb == "ask":
        return show(library.ask(a.question, a.k, a.only, answer=answerer()))
    history: list[dict] = []
    for line in sys.stdin:
        if not (question := line.strip()):
            break
        reply = library.ask(question, a.k, a.only, history, answerer())
        print(reply["answer"] or reply["context"], flush=True)
        history += [{"role": "user", "content": question}, {"role": "assistant", "content": reply["answer"] or ""}]
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
