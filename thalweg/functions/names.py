"""File names: recording keys, frame names, label normalisation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

FIRST, LATER, NEWER = r"(?i)^GOPR([0-9]{4})$", r"(?i)^GP([0-9]{2})([0-9]{4})$", r"(?i)^G([HXL])([0-9]{2})([0-9]{4})$"


def recording_key(stem: Column) -> Column:
    """struct(recording, chapter) of an action-camera file stem; other names are recordings of their own."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(stem, pattern, group)

    key = (
        F.when(stem.rlike(FIRST), F.concat(F.lit("GOPR"), part(FIRST, 1)))
        .when(stem.rlike(LATER), F.concat(F.lit("GOPR"), part(LATER, 2)))
        .when(stem.rlike(NEWER), F.concat(F.lit("G"), F.upper(part(NEWER, 1)), part(NEWER, 3)))
        .otherwise(stem)
    )
    chapter = F.when(stem.rlike(LATER), part(LATER, 1).cast("int")).when(~stem.rlike(FIRST) & stem.rlike(NEWER), part(NEWER, 2).cast("int")).otherwise(0)
    return F.struct(key.alias("recording"), chapter.alias("chapter"))


def frame_name(micros: Column, interval_s: float) -> Column:
    """frame_<date>_<time>.jpg of a local clock in microseconds; below one second with milliseconds."""
    second = F.floor(micros / 1_000_000)
    stamp = F.date_format(F.timestamp_seconds(second), "'frame_'yyyy-MM-dd_HH-mm-ss")
    if interval_s >= 1:
        return F.concat(stamp, F.lit(".jpg"))
    milli = F.floor((micros - second * 1_000_000) / 1000)
    return F.concat(stamp, F.lit("_"), F.lpad(milli.cast("string"), 3, "0"), F.lit(".jpg"))


def without_collisions(name: Column, recording: Column, *order: str) -> Column:
    """The name, with the recording appended for all but the first frame that has it."""
    again = F.row_number().over(Window.partitionBy(name).orderBy(*order)) > 1
    return F.when(again, F.concat(F.regexp_replace(name, r"\.jpg$", ""), F.lit("_"), recording, F.lit(".jpg"))).otherwise(name)


def setting_label(label: Column) -> Column:
    """Upper case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def local_tag(tag: Column) -> Column:
    """An XML tag without its namespace, in lower case."""
    return F.lower(F.regexp_replace(tag, r"^.*[}:]", ""))


def parent_folder(relative: Column) -> Column:
    """The folder of a relative path; empty at the top."""
    return F.when(F.instr(relative, "/") > 0, F.regexp_replace(relative, "/[^/]*$", "")).otherwise("")


def classified_name(label: Column, filename: Column) -> Column:
    """<label>/<label>_<file>; the extension stays in the stem so that a.jpg and a.png don't meet."""
    stem = F.regexp_replace(filename, r"(?i)\.jpe?g$", "")
    return F.concat(label, F.lit("/"), label, F.lit("_"), F.regexp_replace(stem, r"\.", "_"), F.lit(".jpg"))
