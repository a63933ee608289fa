"""Quality scores by co-training a text classifier and a page-metadata classifier.

The text view hashes whitespace-separated words, their last characters and pairs of neighbouring last
characters. The metadata view has language, source and coarse page measures: length, lines, line
length, shares of marks, capitals, digits and repeated lines. Both are FTRL-proximal logistic models.

Both start from at most TRAIN labelled rows outside the held-out fold (crc32 of the doc_id as text, mod 4,
is 2), in hash order; a fifth of them is kept for calibration. In each round every row of the table outside
that fold is scored by both views where it is; a view that is sure of a row (SURE) labels it for the other
view. The pseudo-labelled rows' gradients are summed per slot of the other view's table, in whole numbers so
that partitions don't matter, and are one FTRL step of that view: what reaches the driver is bounded by the
tables' slots, however many rows take part. Pseudo-labels of a class together weigh no more than its labelled
rows. Then each view's margins are calibrated and the two are combined by logistic regression on the
calibration rows. A document is kept from a score of CUT on, below one half: dropping a good document is the
worse error. Every row of the table is scored, from its whole text.

Null and empty texts, null languages, sources and lengths have features of their own ("absent").
Rows are scored one by one: repeated rows score alike. Labels that are null or of other documents are
not used; without labels of both classes every score is 1 (nothing is rejected). Empty tables give an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches
from .linear import SPACE, Ftrl, Sparse, sigmoid, slots, tokens
from .shingles import BASE, mixed
from .toxicity import bounded_rows, fold, labelled_sample

TEXT_BITS, META_BITS, TRAIN, ROUNDS, SURE, EPOCHS, CUT, UNIT = 18, 14, 6000, 2, 0.95, 6, 0.3, 1 << 20
BITS = (TEXT_BITS, META_BITS)
SHAPE = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def text_view(data: bytes) -> np.ndarray:
    words, tails = tokens(data, SPACE)
    pairs = mixed((tails[:-1] & np.uint64(0xFFFF)) * BASE + (tails[1:] & np.uint64(0xFFFF))) if len(tails) > 1 else np.zeros(0, np.uint64)
    return slots([words, tails, tails & np.uint64(0xFFFF), pairs], TEXT_BITS)


def meta_view(data: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    n = len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    b = np.frombuffer(data, np.uint8)
    counts = np.bincount(b, minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()

    def step(x: float) -> int:
        return -1 if x < 0 else int(2 * math.log2(1 + x))

    def share(x: float) -> int:
        return int(20 * x / max(1, n))

    named = [
        f"lang={lang}", f"source={source}", f"chars={step(n_chars) if n_chars is not None else None}", f"bytes={step(n)}", f"lines={step(len(lines))}",
        f"line={step(n / max(1, len(lines)))}", f"upper={int(20 * upper / max(1, upper + lower))}", f"digits={share(digits)}", f"marks={share(marks)}",
        f"repeated={int(10 * (1 - len(set(lines)) / max(1, len(lines))))}", f"top={share(max((int(counts[c]) for c in range(33, 127)), default=0))}",
    ]
    codes = [int.from_bytes(x.encode("utf-8", "surrogatepass"), "little") % ((1 << 61) - 1) for x in named]
    return slots([np.array(codes, np.uint64)], META_BITS)


def views(text, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return text_view(data), meta_view(data, lang, source, n_chars)


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a ridge logistic regression on the columns of margins and a constant, by Newton's method."""
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 1e-2
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sure_gradients(rows: DataFrame, models: list[tuple], weight: np.ndarray, sure: float = SURE) -> list[np.ndarray]:
    """For each view the gradient over rows(text, lang, source, n_chars) that the other view is sure of.

    Each task returns sums per (view, label, slot); they are added up in the cluster. weight has the most
    that the rows of a label may count for in all.
    """
    told = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Sparse(bits, *w) for bits, w in zip(BITS, told.value, strict=True)]
        # the last two entries are for the bias and the number of rows
        sums = [[np.zeros((1 << bits) + 2, np.int64) for _ in (0, 1)] for bits in BITS]
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = [np.unique(v) for v in views(*row)]
                p = [float(sigmoid(t.margin(f))) for t, f in zip(tables, found, strict=True)]
                for v in (0, 1):
                    if p[v] >= sure or p[v] <= 1 - sure:
                        into = sums[1 - v][label := int(p[v] >= 0.5)]
                        step = round((p[1 - v] - label) * UNIT)
                        into[found[1 - v]] += step
                        into[-2:] += (step, 1)
        for v in (0, 1):
            for label in (0, 1):
                at = np.flatnonzero(sums[v][label])
                cols = [np.full(len(at), v, np.int8), np.full(len(at), label, np.int8), at.astype(np.int32), sums[v][label][at]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["view", "label", "slot", "g"])

    summed = rows.mapInArrow(run, "view byte, label byte, slot int, g long").groupBy("view", "label", "slot").agg(F.sum("g").alias("g")).toArrow()
    view, label, slot, g = (summed.column(k).to_numpy() for k in range(4))
    out = []
    for v, bits in enumerate(BITS):
        total = np.zeros((1 << bits) + 1)
        for y in (0, 1):
            mine = (view == v) & (label == y)
            dense = np.zeros((1 << bits) + 2)
            dense[slot[mine]] = g[mine]
            total += dense[:-1] / UNIT * min(1.0, weight[y] / max(1.0, dense[-1]))
        out.append(total)
    told.unpersist()
    return out


def cotrain(labelled: list[tuple[np.ndarray, np.ndarray, int]], exchange: Callable[[list[tuple], np.ndarray], list[np.ndarray]], rounds: int = ROUNDS) -> dict | None:
    """Compact weights of both views, their calibrations and the combination; exchange gives sure_gradients."""
    y = np.array([r[2] for r in labelled], float)
    if len(set(y)) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    rows = [[labelled[k][v] for k in fit] for v in (0, 1)]
    models = [Ftrl(bits, alpha=0.5, l1=l1, l2=0.05).fit(rows[v], y[fit], EPOCHS) for v, (bits, l1) in enumerate(zip(BITS, (2.0, 0.5), strict=True))]
    weight = np.array([(y[fit] == label).sum() for label in (0, 1)], float)
    for k in range(rounds):
        steps = exchange([m.compact() for m in models], weight)
        for v in (0, 1):
            models[v].step(steps[v]).fit(rows[v], y[fit], 1, seed=k + 2)
    check = np.flatnonzero(held) if held.any() else fit
    final = [Sparse(bits, *m.compact()) for bits, m in zip(BITS, models, strict=True)]
    margins = np.array([[final[v].margin(labelled[k][v]) for v in (0, 1)] for k in check])
    each = [platt(margins[:, [v]], y[check]) for v in (0, 1)]
    logits = np.column_stack([margins[:, v] * each[v][0] + each[v][1] for v in (0, 1)])
    return {"models": [m.compact() for m in models], "each": each, "both": platt(logits, y[check])}


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN, rounds: int = ROUNDS) -> dict | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(2, 6)]
            found = [tuple(np.unique(v).tobytes() for v in views(*row)) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["doc_id", "y", "t", "m"])

    shaped = [F.col(c).cast(kind) for c, kind in SHAPE.items()]
    known = labelled_sample(docs, labels, "quality", list(SHAPE), most).select("doc_id", "y", *shaped)
    labelled = [(np.frombuffer(r.t, np.int32), np.frombuffer(r.m, np.int32), r.y) for r in bounded_rows(known.mapInArrow(run, "doc_id long, y int, t binary, m binary"), ["t", "m"])]
    every = docs.where(F.coalesce(fold(F.col("doc_id")) != 2, F.lit(False))).select(*shaped)
    return cotrain(labelled, lambda models, weight: sure_gradients(every, models, weight), rounds)


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, most: int = TRAIN, rounds: int = ROUNDS, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of each row (doc_id if not given) and text_score, metadata_score, quality_score, keep."""
    small_arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, rounds))
    carried = docs.select(F.struct(*(carry or ["doc_id"])).alias("own"), *(F.col(c).cast(kind) for c, kind in SHAPE.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tables = m and [Sparse(bits, *w) for bits, w in zip(BITS, m["models"], strict=True)]
        for b in batches:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if not m:
                    out.append((1.0, 1.0, 1.0))
                    continue
                logits = [t.margin(v) * e[0] + e[1] for t, v, e in zip(tables, views(*row), m["each"], strict=True)]
                out.append((float(sigmoid(logits[0])), float(sigmoid(logits[1])), float(sigmoid(logits[0] * m["both"][0] + logits[1] * m["both"][1] + m["both"][2]))))
            scores = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s, pa.float64()) for s in scores), pa.array([s >= cut for s in scores[2]], pa.bool_())], ["own", "text_score", "metadata_score", "quality_score", "keep"])

    own = carried.schema["own"].dataType.simpleString()
    scored = carried.mapInArrow(run, f"own {own}, text_score double, metadata_score double, quality_score double, keep boolean")
    return scored


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, text_score, metadata_score, quality_score, keep) for each row of docs."""
    s = score_quality(docs, labels, cut)
    return s.select("own.doc_id", F.coalesce(fold(F.col("own.doc_id")) == 2, F.lit(False)).alias("held_out"), "text_score", "metadata_score", "quality_score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they are, that the combined classifier does not reject."""
    return score_quality(docs, labels, cut, carry=docs.columns).where("keep").select("own.*")
