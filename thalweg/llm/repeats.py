"""Removing byte strings of LENGTH bytes that occur more than once, by hash-compared suffix sorting.

1. Anchors. Of the GRAM-byte strings inside each LENGTH-byte window the one with the smallest hash is
   the window's anchor (the leftmost on a tie), so equal windows have equal anchors at equal offsets.
   Neighbouring windows mostly share an anchor: a text yields a row per run of windows with one
   anchor (about one for 110 bytes), with a 128-bit digest of the bytes that the run covers, its context.
2. An anchor that occurs once cannot belong to a repeat. If all contexts of an anchor are the same,
   all their windows repeat; so do those of any context that occurs twice. Both are plain
   aggregations with map-side combine. What is left are anchors with different contexts: the ends
   of copied passages. One example of each such context gets its bytes from the texts.
3. Suffix sort. The suffixes at each offset from an anchor are merge-sorted: prefix polynomial hashes
   and binary search give two suffixes' common extension in logarithmic steps, which decides the
   order. Neighbours with a common extension of LENGTH are repeats, after the bytes are compared.
4. An anchor with more than GROUP different contexts is first split: its offsets are cut into cells,
   and contexts go on together only if they agree on all bytes that any window of the cell has.
   Cells narrow until a group is small enough to sort, or a cell is one offset and equality decides.

Beside the bytes, remove_repeats() counts the words of passages of WORDS words and more that other rows hold
too (n_shared_words, see passages.py): 50 words may be fewer than LENGTH bytes. These are counted, not removed.

Null and empty texts and texts shorter than LENGTH have no repeats. Rows are told apart by doc_id and
a hash of the text, so repeated rows are copies of each other. Empty tables give an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small_arrow_batches
from .passages import WORDS, shared_words
from .shingles import mixed, powers, prefix_hash

LENGTH, GROUP, CELLS, PIECE, BUFFER = 400, 64, (13, 4, 1), 1 << 19, 1 << 18
ANCHORS = "doc_id long, tid int, lo int, hi int, off int, key long, ctx long, ctx2 long"
ITEMS = "doc_id long, tid int, lo int, hi int, off int, key long, ctx long, ctx2 long, n long, x binary"
CONTEXT = ["key", "ctx", "ctx2"]
LOW = np.uint64(0xFFFFFF)


def runs(data: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, anchor, hash): windows lo..hi share the anchor that starts at anchor."""
    gram = length // 2
    width = length - gram + 1
    for base in range(0, len(data) - length + 1, PIECE):
        part = data[base : base + PIECE + length - 1]
        n = len(part) - length + 1
        sums, down = prefix_hash(part), powers(len(part) + 1)[1]
        h = mixed((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        keyed = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        full = np.concatenate([keyed, np.full(-len(keyed) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(full, axis=1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        hi = np.concatenate([lo[1:], [n]]) - 1
        at = (least[lo] & LOW).astype(np.int64)
        yield from zip((lo + base).tolist(), (hi + base).tolist(), (at + base).tolist(), h[at].view(np.int64).tolist(), strict=True)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digest(data: bytes, seed: int) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(data, seed=seed)
    return signed(d >> 64), signed(d & 0xFFFFFFFFFFFFFFFF)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in ANCHORS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, tid, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                found = list(runs(np.frombuffer(raw, np.uint8), length))
                lo, hi, at, h = zip(*found, strict=True)
                cols[0] += [doc.as_py()] * len(found)
                cols[1] += [tid.as_py()] * len(found)
                cols[2] += lo
                cols[3] += hi
                cols[4] += [p - q for p, q in zip(at, lo, strict=True)]
                cols[5] += h
                first, second = zip(*(digest(raw[q : r + length], p - q) for q, r, p in zip(lo, hi, at, strict=True)), strict=True)
                cols[6] += first
                cols[7] += second
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.mapInArrow(run, ANCHORS)


class Suffixes:
    """Windows of the items of many groups, sorted within each (group, offset)."""

    def __init__(self, items: list[dict], length: int):
        self.items, self.length = items, length
        self.data = b"".join(i["x"] for i in items)
        sizes = np.array([len(i["x"]) for i in items])
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.sums, self.down = prefix_hash(np.frombuffer(self.data, np.uint8)), powers(len(self.data) + 1)[1]
        self.bytes = np.frombuffer(self.data, np.uint8)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a is before, equal to or after that at b, over length bytes."""
        out = np.zeros(len(a), np.int8)
        open_ = np.flatnonzero(~self.same(a, b, np.int64(self.length)))
        p, q = a[open_], b[open_]
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), self.length, np.int64)  # agree on lo bytes, not on hi
        for _ in range(int(self.length).bit_length()):
            mid = (lo + hi) >> 1
            ok = self.same(p, q, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, np.maximum(mid, lo + 1))
        out[open_] = np.where(self.bytes[p + lo] < self.bytes[q + lo], -1, 1)
        return out

    def repeats(self) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): windows of the item, counted from its start, that occur in another item of its group."""
        items = self.items
        counts = np.array([i["hi"] - i["lo"] + 1 for i in items])
        item = np.repeat(np.arange(len(items)), counts)
        step = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        group = np.array([i["group"] for i in items])[item]
        offset = np.array([i["off"] for i in items])[item] - step
        order = np.lexsort((item, offset, group))
        item, step, group, offset = item[order], step[order], group[order], offset[order]
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (offset[1:] != offset[:-1])])
        begin = np.flatnonzero(first)
        size = np.diff(np.concatenate([begin, [len(item)]]))
        keep = np.repeat(size > 1, size)
        item, step, offset = item[keep], step[keep], offset[keep]
        size = size[size > 1]
        if not len(item):
            return
        begin = np.repeat(np.cumsum(size) - size, size)
        size = np.repeat(size, size)
        at, where = np.arange(len(item)), self.start[item] + step
        width = 1
        while width < size.max():
            run = (at - begin) // width
            mine = begin + run * width
            other = begin + (run ^ 1) * width
            end = np.minimum(other + width, begin + size)
            lo, hi = np.minimum(other, end), end  # how many of the other run go before this one
            right = (run & 1) == 1
            while len(live := np.flatnonzero(lo < hi)):
                mid = (lo[live] + hi[live]) >> 1
                c = self.less(where[mid], where[live])
                ahead = (c < 0) | ((c == 0) & right[live])
                lo[live] = np.where(ahead, mid + 1, lo[live])
                hi[live] = np.where(ahead, hi[live], mid)
            to = np.minimum(mine, other) + (at - mine) + np.where(other < end, lo - other, 0)
            for column in (item, step, where, offset):
                column[to] = column.copy()
            width *= 2
        a, b = np.flatnonzero(begin[:-1] == begin[1:]), None
        a = a[self.same(where[a], where[a + 1], np.int64(self.length))]
        b = a + 1
        yield from self.verified(item[a], item[b], step[a], step[b])

    def verified(self, i: np.ndarray, j: np.ndarray, s: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Compares the bytes of each run of matching windows of two items once."""
        if not len(i):
            return
        order = np.lexsort((s, t - s, j, i))
        i, j, s, t = i[order], j[order], s[order], t[order]
        fresh = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (t[1:] - s[1:] != t[:-1] - s[:-1]) | (s[1:] != s[:-1] + 1)])
        head = np.flatnonzero(fresh)
        tail = np.concatenate([head[1:], [len(i)]]) - 1
        for h, e in zip(head.tolist(), tail.tolist(), strict=True):
            pieces = [(int(s[h]), int(t[h]), int(e - h))]
            x, y = self.items[i[h]]["x"], self.items[j[h]]["x"]
            if x[s[h] : s[e] + self.length] != y[t[h] : t[e] + self.length]:  # a collision: each window for itself
                pieces = [(p, q, 0) for p, q in zip(s[h : e + 1].tolist(), t[h : e + 1].tolist(), strict=True) if x[p : p + self.length] == y[q : q + self.length]]
            for p, q, more in pieces:
                yield int(i[h]), p, p + more
                yield int(j[h]), q, q + more


def sorted_repeats(items: DataFrame, length: int) -> DataFrame:
    """(doc_id, tid, lo, hi) of repeated windows, items of one key in one partition and next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            found = [(rows[i]["doc_id"], rows[i]["tid"], rows[i]["lo"] + s, rows[i]["lo"] + t) for i, s, t in Suffixes(rows, length).repeats() if rows[i]["n"] == 1]
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "tid", "lo", "hi"])

        held: list[dict] = []
        total = group = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["key"] != held[-1]["key"]:
                    group += 1
                    if total >= BUFFER:
                        yield out(held)
                        held, total = [], 0
                held.append(row | {"group": group})
                total += len(row["x"])
        if held:
            yield out(held)

    return items.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, tid int, lo int, hi int")


def split_cells(items: DataFrame, width: int, length: int) -> DataFrame:
    """Each item cut at the cells' borders; key: the bytes that all windows of the cell share, ctx: all it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, off, last = r["x"], r["off"], r["hi"] - r["lo"]
                for cell in range((off - last) // width, off // width + 1):
                    c1, c2 = cell * width, cell * width + width - 1
                    d1, d2 = max(c1, off - last), min(c2, off)
                    part = x[off - d2 : off - d1 + length]
                    common = x[off - c1 : off - c2 + length]
                    seed = r["key"] & 0x7FFFFFFFFFFFFFFF
                    key = signed(xxhash.xxh3_64_intdigest(common, seed=seed ^ (cell * 0x9E3779B1)))
                    ctx, ctx2 = digest(part, d2 % (1 << 64))
                    rows.append(r | {"lo": r["lo"] + off - d2, "hi": r["lo"] + off - d1, "off": d2, "key": key, "ctx": ctx, "ctx2": ctx2, "x": part})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return items.select(*(c.split(" ")[0] for c in ITEMS.split(", "))).mapInArrow(run, ITEMS)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tid, lo, hi): the windows of docs(doc_id, tid, text) that start at lo..hi occur elsewhere too."""
    span = ["doc_id", "tid", "lo", "hi"]
    every = cut(anchors(docs.select("doc_id", "tid", "text"), length), "anchors")
    ends = [f(c).alias(f"{name}_{c}") for c in ("ctx", "ctx2") for name, f in (("least", F.min), ("most", F.max))]
    often = every.groupBy("key").agg(F.count("*").alias("times"), *ends).where("times > 1")
    # sums are written before they are joined: then both sides are plain shuffles and a hot anchor can be split
    often = cut(often.select("key", F.expr("least_ctx = most_ctx AND least_ctx2 = most_ctx2").alias("alike")), "often")
    members = cut(every.join(often, "key"), "members")
    drop(every, often, shuffles=True)
    found = [members.where("alike").select(span)]
    mixed_ = members.where("NOT alike").drop("alike")
    per = mixed_.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tid", "lo")).alias("rep"))
    per = cut(per, "per")
    mixed_ = cut(mixed_.join(per, CONTEXT), "contexts")
    found.append(mixed_.where("n > 1").select(span))
    one = mixed_.where(F.struct("doc_id", "tid", "lo").eqNullSafe(F.col("rep"))).dropDuplicates(CONTEXT).select(*span, "off", *CONTEXT, "n")
    todo = cut(with_bytes(one, docs, length), "items")
    drop(per, shuffles=True)
    for width in CELLS:
        sizes = cut(todo.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        sized = todo.join(sizes, "key")
        found.append(cut(sorted_repeats(sized.where(F.col("m") <= GROUP).drop("m"), length), "sorted"))
        large = cut(sized.where(F.col("m") > GROUP).drop("m"), "large")
        if not large.limit(1).count():
            break
        parts = cut(split_cells(large, width, length), "cells")
        per = parts.groupBy(*CONTEXT).agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "tid", "lo")).alias("rep"))
        parts = parts.join(cut(per, "per"), CONTEXT)
        found.append(cut(parts.where("times > 1 AND n = 1").select(span), "equal"))
        if width > 1:
            known = F.when(F.col("times") > 1, F.greatest("n", F.lit(2))).otherwise(F.col("n"))
            todo = cut(parts.where(F.struct("doc_id", "tid", "lo").eqNullSafe(F.col("rep"))).dropDuplicates(CONTEXT).select(*span, "off", *CONTEXT, known.cast("long").alias("n"), "x"), "items")
    return reduce(DataFrame.union, found)


def spans_of(rows: DataFrame) -> Column:
    """Joins rows(doc_id, tid) with what is found of them, (of, of_tid)."""
    return rows["doc_id"].eqNullSafe(F.col("of")) & (rows["tid"] == F.col("of_tid"))


def with_bytes(items: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds x, the bytes that the windows of each item cover."""
    per_doc = items.groupBy(F.col("doc_id").alias("of"), F.col("tid").alias("of_tid")).agg(F.collect_list(F.struct("lo", "hi", "off", *CONTEXT, "n")).alias("wanted"))
    texts = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tid") == F.col("of_tid"))).dropDuplicates(["doc_id", "tid"]).select("doc_id", "tid", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in ITEMS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for doc, tid, text, wanted in zip(*(c for c in batch.columns), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    rows.append((doc.as_py(), tid.as_py(), w["lo"], w["hi"], w["off"], w["key"], w["ctx"], w["ctx2"], w["n"], raw[w["lo"] : w["hi"] + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts.mapInArrow(run, ITEMS)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words[, kept_bytes]) for each row of docs(doc_id, text)."""
    small_arrow_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tid", F.hash("text"))
    shared = shared_words(keyed, words)
    spans = repeated_windows(keyed, length).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    found = spans.join(shared, spans_of(spans), "full")
    found = found.select(F.coalesce(spans["doc_id"], F.col("of")).alias("of"), F.coalesce(spans["tid"], F.col("of_tid")).alias("of_tid"), "spans", "n_shared_words")
    rows = keyed.join(found, spans_of(keyed), "left").select("doc_id", "text", "spans", F.coalesce("n_shared_words", F.lit(0)).cast("long").alias("n_shared_words"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long" + ", kept_bytes binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        for batch in batches:
            out = []
            for doc, text, found, shared in zip(*batch.columns, strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"] + length) for s in found.as_py() or []):
                    if lo > end:
                        kept.append(raw[at:lo])
                        n += 1
                        end = lo
                    removed += max(0, hi - max(lo, end))
                    at = end = max(end, hi)
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc.as_py(), len(raw), removed, n, hashlib.sha256(left).hexdigest(), shared.as_py(), left)[: len(names)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)
