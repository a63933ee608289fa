"""EXIF of JPEG files in plain Python: positions, times and descriptions, read and written without other tools.

A JPEG's EXIF is an APP1 segment with a TIFF structure: directories of tags that hold values or point to them,
the position in a directory of its own. Writing replaces the segment and leaves the image data as it is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import from_dms

# tag numbers and value sizes of the EXIF standard
DESCRIPTION, EXIF_IFD, GPS_IFD, TAKEN, DIGITIZED, OFFSET = 0x010E, 0x8769, 0x8825, 0x9003, 0x9004, 0x9011
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
ASCII, LONG, RATIONAL = 2, 4, 5
HEADER = b"Exif\0\0"


def segments(jpeg: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of each segment before the image data."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] not in (0xDA, 0xD9):
        size = struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        yield jpeg[at + 1], at, at + 2 + size
        at += 2 + size


def directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """Values by tag: text, a whole number, or (num, den) pairs."""
    out: dict[int, object] = {}
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size, where = SIZES.get(kind, 1) * n, at + 10 + 12 * k
        if size > 4:
            where = struct.unpack_from(order + "I", tiff, where)[0]
        raw = tiff[where : where + size]
        if kind == ASCII:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (3, 4) and n:
            out[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: SIZES[kind]])[0]
        elif kind == RATIONAL:
            flat = struct.unpack(f"{order}{2 * n}I", raw)
            out[tag] = list(zip(flat[::2], flat[1::2], strict=True))
    return out


def read(jpeg: bytes) -> dict[str, object]:
    """lat_ref, lat, lon_ref, lon (rationals), description, taken, offset: those that are there."""
    for marker, start, end in segments(jpeg):
        if marker == 0xE1 and jpeg[start + 4 : start + 10] == HEADER:
            tiff = jpeg[start + 10 : end]
            order = "<" if tiff[:2] == b"II" else ">"
            main = directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
            own = directory(tiff, main[EXIF_IFD], order) if EXIF_IFD in main else {}
            gps = directory(tiff, main[GPS_IFD], order) if GPS_IFD in main else {}
            found = {"description": main.get(DESCRIPTION), "taken": own.get(TAKEN), "offset": own.get(OFFSET)}
            found |= {"lat_ref": gps.get(LAT_REF), "lat": gps.get(LAT), "lon_ref": gps.get(LON_REF), "lon": gps.get(LON)}
            return {k: v for k, v in found.items() if v is not None}
    return {}


def built(entries: dict[int, tuple[int, int, bytes]], at: int) -> bytes:
    """A directory that starts at `at`, its long values behind it."""
    head, tail = struct.pack("<H", len(entries)), b""
    behind = at + 2 + 12 * len(entries) + 4
    for tag, (kind, n, raw) in sorted(entries.items()):
        head += struct.pack("<HHI", tag, kind, n)
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack("<I", behind + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<I", 0) + tail


def write(jpeg: bytes, lat: list | None = None, lat_ref: str = "N", lon: list | None = None, lon_ref: str = "E", description: str | None = None, taken: str | None = None, offset: str | None = None) -> bytes:
    """jpeg with an EXIF segment of these values in place of any it has."""

    def text(s: str) -> tuple[int, int, bytes]:
        raw = s.encode() + b"\0"
        return ASCII, len(raw), raw

    def ratios(pairs: list) -> tuple[int, int, bytes]:
        return RATIONAL, len(pairs), b"".join(struct.pack("<II", *p) for p in pairs)

    own = {k: text(v) for k, v in ((TAKEN, taken), (DIGITIZED, taken), (OFFSET, offset)) if v}
    gps = {LAT_REF: text(lat_ref), LAT: ratios(lat), LON_REF: text(lon_ref), LON: ratios(lon)} if lat and lon else {}
    main = {DESCRIPTION: text(description)} if description else {}
    main |= {tag: (LONG, 1, struct.pack("<I", 0)) for tag, part in ((EXIF_IFD, own), (GPS_IFD, gps)) if part}
    size, parts = len(built(main, 8)), b""
    for tag, part in ((EXIF_IFD, own), (GPS_IFD, gps)):
        if part:
            at = 8 + size + len(parts)
            main[tag] = (LONG, 1, struct.pack("<I", at))
            parts += built(part, at)
    tiff = b"II*\0" + struct.pack("<I", 8) + built(main, 8) + parts
    if len(HEADER + tiff) + 2 > 0xFFFF:
        raise ValueError("the values are too long for an EXIF segment")
    kept = b"".join(jpeg[a:b] for m, a, b in segments(jpeg) if not (m == 0xE1 and jpeg[a + 4 : a + 10] == HEADER))
    rest = max((b for *_, b in segments(jpeg)), default=2)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(HEADER + tiff) + 2) + HEADER + tiff + kept + jpeg[rest:]


RATIONALS = "array<struct<num:long,den:long>>"


def read_tags(files: DataFrame) -> DataFrame:
    """files(path, content) of JPEG images → path, lat, lon (degrees, null without a position), description.

    A file that can't be read has nulls.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for content in f["content"]:
                try:
                    found = read(bytes(content))
                except (ValueError, struct.error, KeyError, IndexError):
                    found = {}
                as_pairs = {k: [{"num": n, "den": d} for n, d in found[k]] if k in found else None for k in ("lat", "lon")}
                rows.append((as_pairs["lat"], found.get("lat_ref"), as_pairs["lon"], found.get("lon_ref"), found.get("description")))
            yield pd.DataFrame({"path": f["path"].to_numpy()}).join(pd.DataFrame(rows, columns=["lat", "lat_ref", "lon", "lon_ref", "description"]))

    rows = files.select("path", "content").mapInPandas(each, f"path string, lat {RATIONALS}, lat_ref string, lon {RATIONALS}, lon_ref string, description string")
    degrees = [F.when(F.col(k).isNotNull(), from_dms(F.col(k), F.coalesce(F.col(f"{k}_ref") == minus, F.lit(False)))).alias(k) for k, minus in (("lat", "S"), ("lon", "W"))]
    return rows.select("path", *degrees, "description")


def tagged_images(images: DataFrame) -> DataFrame:
    """images(content, lat_dms, lat_ref, lon_dms, lon_ref, image_description, ...) with the tags written into content."""
    cols = images.columns

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                lat, lon = ([(int(p["num"]), int(p["den"])) for p in r[k]] for k in ("lat_dms", "lon_dms"))
                out.append(write(bytes(r["content"]), lat, r["lat_ref"], lon, r["lon_ref"], r["image_description"], r.get("taken"), r.get("offset")))
            yield f.assign(content=out)[cols]

    return images.mapInPandas(each, images.schema)
