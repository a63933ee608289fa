"""Words of passages that more than one row holds: runs of WORDS words and more.

Like repeats.py, with words for bytes and counts for removal. Of the GRAM-word grams inside each window of
`words` words the one with the smallest hash is the window's anchor; windows that follow each other with one
anchor are a run. Anchors that one row alone has can't belong to a shared passage, and runs of the same words in
several rows are shared as a whole. The windows of the other runs, and of one of each group of equal ones, are
hashed, to 128 bits, and those in more than one row are shared; shared windows together cover a row's shared
words. Words are runs without white space, compared as they are, by 64-bit hashes.

Rows are told apart by doc_id and a hash of the text; repeated rows share all their passages. Null and empty
texts and those with fewer words share nothing. A window that repeats inside one row only isn't shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .shingles import BASE, mixed, powers, word_hashes

WORDS = 50


def grams(words: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of the n words from each position on, by doubling."""
    h, span, at = words + np.uint64(salt), 1, np.zeros(len(words), np.uint64)
    done, size = 0, len(words) - n + 1
    while True:
        if n & span:
            at = mixed(at[:size] * BASE + h[done : done + size])
            done += span
        span *= 2
        if span > n:
            return at
        h = mixed(h[: len(h) - span // 2] * BASE + h[span // 2 :])


def anchored(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of text, hashed, and the anchor of each window of n of them."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if len(words) < n:
        return words, np.zeros(0, np.uint64)
    gram = max(1, n // 2)
    h = grams(words, gram, 1)
    return words, np.lib.stride_tricks.sliding_window_view(h, n - gram + 1).min(axis=1)


def runs(words: np.ndarray, anchor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run, and a hash of the run's words."""
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    hi = np.concatenate([lo[1:], [len(anchor)]]) - 1
    up, down = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * up[: len(words)], dtype=np.uint64)])
    return lo, hi, mixed((sums[hi + n] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def shared_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(of, of_tid, n_shared_words) of each row of docs(doc_id, tid, text) with a passage that another row has."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(2):
                codes, anchor = anchored(t.as_py(), words)
                lo, _, ctx = runs(codes, anchor, words)
                found.append(np.unique(np.stack([anchor[lo], ctx]), axis=1).view(np.int64))
            at = pa.array(np.repeat(np.arange(len(found)), [f.shape[1] for f in found]))
            key, ctx = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(key), pa.array(ctx)], ["doc_id", "tid", "key", "ctx"])

    every = cut(docs.select("doc_id", "tid", "text").mapInArrow(anchors, "doc_id long, tid int, key long, ctx long"), "passage_anchors")
    often = every.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("least"), F.max("ctx").alias("most")).where("n > 1")
    often = cut(often.select("key", F.expr("least = most").alias("alike")), "passage_keys")
    members = cut(every.join(often, "key"), "passage_members")
    drop(every, often, shuffles=True)
    apart, me = members.where("NOT alike"), F.struct("doc_id", "tid")
    groups = cut(apart.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(me).alias("rep")), "passage_runs")
    apart = apart.join(groups, ["key", "ctx"]).select("doc_id", "tid", "ctx", (F.col("n") > 1).alias("whole"), ((F.col("n") == 1) | me.eqNullSafe(F.col("rep"))).alias("open"))
    wanted = apart.union(members.where("alike").select("doc_id", "tid", "ctx", F.lit(True), F.lit(False)))
    wanted = wanted.groupBy(F.col("doc_id").alias("of"), F.col("tid").alias("of_tid")).agg(*(F.collect_set(F.when(F.col(k), F.col("ctx"))).alias(k) for k in ("whole", "open")))
    wanted = cut(wanted, "passage_wanted")
    drop(members, groups, shuffles=True)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for k, (text, *asked) in enumerate(zip(*b.columns[2:], strict=True)):
                codes, anchor = anchored(text.as_py(), words)
                lo, hi, ctx = runs(codes, anchor, words)
                whole, open_ = (np.isin(ctx.view(np.int64), np.array(x.as_py(), np.int64)) for x in asked)
                at = np.flatnonzero(np.repeat(open_, hi - lo + 1))
                one, two = (grams(codes, words, salt)[at].view(np.int64) for salt in (2, 3))
                first = np.zeros(len(at), np.int8)
                first[np.unique(one, return_index=True)[1]] = 1
                none = np.zeros(int(whole.sum()), np.int64)
                rows.append(np.full(len(none) + len(at), k))
                # a run that is shared as a whole has no hash and 2 for first
                found.append((np.concatenate([lo[whole], at]).astype(np.int32), np.concatenate([hi[whole], at]).astype(np.int32) + words, np.concatenate([none, one]), np.concatenate([none, two]), np.concatenate([none.astype(np.int8) + 2, first])))
            kinds = (np.int32, np.int32, np.int64, np.int64, np.int8)
            cols = [np.concatenate(c).astype(t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)] if found else [np.zeros(0, t) for t in kinds]
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *map(pa.array, cols)], ["of", "of_tid", "at", "to", "h", "h2", "first"])

    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("of")) & (docs["tid"] == F.col("of_tid"))).select("of", "of_tid", "text", "whole", "open")
    seen = cut(texts.mapInArrow(windows, "of long, of_tid int, at int, to int, h long, h2 long, first byte"), "passage_windows")
    apart = seen.where("first < 2")
    shared = cut(apart.groupBy("h", "h2").agg(F.sum("first").alias("rows")).where("rows > 1").select("h", "h2"), "passages")
    spots = seen.where("first = 2").select("of", "of_tid", "at", "to").union(apart.join(shared, ["h", "h2"]).select("of", "of_tid", "at", "to"))
    # a row has no more of them than words
    spots = spots.groupBy("of", "of_tid").agg(F.array_sort(F.collect_set(F.struct("at", "to"))).alias("spots"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["end"], x["to"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["at"], s["end"]))).alias("n"))

    out = cut(spots.select("of", "of_tid", F.aggregate("spots", start, cover, lambda s: s["n"]).alias("n_shared_words")), "shared_words")
    drop(wanted, seen, shared, shuffles=True)
    return out
