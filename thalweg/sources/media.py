"""Frames and joined videos by ffmpeg, where it is there: command lines as plain functions, one recording per row."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from .adapters import find_tool, run


def chapter_list(paths: list[str]) -> str:
    """The list file of the concat demuxer."""
    return "".join("file '{}'\n".format(p.removeprefix("file:").replace("'", "'\\''")) for p in paths)


def frame_command(listing: str, target: str, interval_s: float = 1.0, max_width: int | None = None, quality: int = 2) -> list[str]:
    """One picture each interval_s of the chapters in a row, made smaller if they are wider than max_width."""
    scale = f",scale='min({max_width},iw)':-2" if max_width else ""
    return ["-v", "error", "-f", "concat", "-safe", "0", "-i", listing, "-vf", f"fps=1/{interval_s:g}{scale}", "-q:v", str(quality), f"{target}/%06d.jpg"]


def concat_command(listing: str, target: str) -> list[str]:
    """The chapters as one file, streams copied."""
    return ["-v", "error", "-y", "-f", "concat", "-safe", "0", "-i", listing, "-c", "copy", target]


def each_recording(recordings: DataFrame, command: Callable[[str, str], list[str]], output: str, suffix: str, execute: Callable[[list[str], int], str | None] = run) -> DataFrame:
    """recordings(recording, paths) → recording, target, done: ffmpeg with command(list file, target) on the executors.

    output is a folder that executors and driver share. Without ffmpeg, or where it fails, done is false.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = find_tool("ffmpeg")
        for f in frames:
            out = []
            for name, paths in zip(f["recording"], f["paths"], strict=True):
                target = f"{output}/{name}{suffix}"
                done = False
                if tool or execute is not run:
                    (Path(target) if not suffix else Path(output)).mkdir(parents=True, exist_ok=True)
                    with tempfile.NamedTemporaryFile("w", suffix=".txt") as listing:
                        listing.write(chapter_list(list(paths)))
                        listing.flush()
                        done = execute([tool or "ffmpeg", *command(listing.name, target)], 7200) is not None
                out.append((name, target, done))
            yield pd.DataFrame(out, columns=["recording", "target", "done"])

    return recordings.select("recording", "paths").mapInPandas(rows, "recording string, target string, done boolean")
