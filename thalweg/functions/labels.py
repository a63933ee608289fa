"""Class probabilities: labels, margins, texts, means over views, image hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEWS = {"none": 1, "hflip": 2, "flips": 4}
UNCERTAIN = "uncertain"


def label(names: list[str], p: Column, conf: float = 0.0) -> Column:
    """The first class with the largest probability, or uncertain below conf."""
    top = F.array_max(p)
    return F.when(top >= conf, F.element_at(F.array(*map(F.lit, names)), F.array_position(p, top).cast("int"))).otherwise(UNCERTAIN)


def margin(p: Column) -> Column:
    """Largest less second largest; the largest alone if there is one class."""
    s = F.sort_array(p, asc=False)
    return F.get(s, 0) - F.coalesce(F.get(s, 1), F.lit(0.0))


def text(names: list[str], p: Column) -> Column:
    """'name 0.951, ...' by falling probability, class order on ties."""
    each = F.transform(p, lambda x, i: F.struct((-x).alias("k"), i.alias("i"), F.get(F.array(*map(F.lit, names)), i).alias("name"), x.alias("p")))
    return F.array_join(F.transform(F.array_sort(each), lambda e: F.format_string("%s %.3f", e["name"], e["p"])), ", ")


def views(tta: str) -> int:
    if tta not in VIEWS:
        raise ValueError(f"unknown test-time augmentation {tta!r}; one of {sorted(VIEWS)}")
    return VIEWS[tta]


def mean(arrays: list[Column]) -> Column:
    """Class by class mean of probability arrays of one image's views."""
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(arrays))


def gradient_hash(cells: Column, width: int = 9, bits: int = 64) -> Column:
    """Bit k, highest first: whether a cell is less than its right neighbour, over rows of width cells."""
    at = [(k // (width - 1)) * width + k % (width - 1) for k in range(bits)]
    pairs = F.array(*(F.struct(F.lit(a).alias("l"), F.lit(a + 1).alias("r")) for a in at))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR((F.get(cells, x["r"]) > F.get(cells, x["l"])).cast("long")))
