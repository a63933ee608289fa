import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from thalweg.llm import quality
from thalweg.llm.linear import Ftrl, Sparse, sigmoid
from thalweg.llm.quality import keep_good, quality_scores
from thalweg.llm.toxicity import bounded_rows, labelled_sample, score_toxicity


def corpus(bad):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1600):
        words = rng.choices(vocab, k=rng.randint(30, 120))
        y = int(rng.random() < 0.3)
        if y:
            words = bad(words, rng)
        docs.append((i, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), len(words) * 6))
        labels.append((i, 1 - y, y))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def insult(words, rng):
    for _ in range(4):
        words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Scum,", "moron."]))
    return words


def test_toxicity(spark):
    docs, labels = corpus(insult)
    d = spark.createDataFrame([*docs, (-1, None, None, None, None), (-2, "", None, None, None)], SCHEMA)
    y = spark.createDataFrame([*labels, (99999, 1, 1), (-1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_toxicity(d, y).collect()}
    assert len(got) == 1602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(i) for i, r in got.items())
    test = [(got[i].predicted, t) for i, _, t in labels if held(i)]
    assert sum(p == t for p, t in test) >= 0.97 * len(test)
    assert got[-1].predicted == 0 and got[-1].score == got[-2].score
    flipped = spark.createDataFrame([(i, q, 1 - t if held(i) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in score_toxicity(d, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert score_toxicity(d.limit(0), y).collect() == []
    assert {r.predicted for r in score_toxicity(d.limit(5), y.limit(0)).collect()} == {1}  # no labels: 0.5 for all


def test_quality(spark):
    docs, labels = corpus(lambda words, rng: [w.upper() + "!!" for w in words])
    d = spark.createDataFrame([(*r, i) for i, r in enumerate([*docs, (-1, None, None, None, None), (-2, "", None, None, None)])], SCHEMA + ", keep long")
    y = spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(d, y).collect()}
    assert len(got) == 1602
    test = [(got[i].keep, q == 1) for i, q, _ in labels if held(i) or i >= 700]
    assert sum(p == t for p, t in test) >= 0.98 * len(test)
    kept = keep_good(d, y)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.keep)
    assert all(r.keep for r in quality_scores(d.limit(9), y.limit(0)).collect())
    assert quality_scores(d.limit(0), y).collect() == []


def slow_ftrl(rows, y, bits, epochs, alpha, l1, l2, beta=1.0, seed=1):
    """One coordinate at a time, from the published update rule."""
    z, n, bias = defaultdict(float), defaultdict(float), 1 << bits

    def weight(i):
        cut = 0.0 if i == bias else l1
        if abs(z[i]) <= cut:
            return 0.0
        return -(z[i] - math.copysign(cut, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = [*map(int, rows[k]), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[k]
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return weight, [i for i in list(z) if i != bias and weight(i) != 0]


def test_ftrl_matches_a_slow_one():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 64, 6)).astype(np.int32) for _ in range(150)]
    y = np.array([float(3 in r or rng.random() < 0.2) for r in rows])
    weight, at = slow_ftrl(rows, y, 6, 3, 0.7, 0.5, 0.1)
    slots, w, bias = Ftrl(6, alpha=0.7, l1=0.5, l2=0.1).fit(rows, y, 3).compact()
    assert sorted(at) == slots.tolist() and 3 in at
    assert np.allclose(w, [weight(int(i)) for i in slots], atol=1e-5) and math.isclose(bias, weight(64), abs_tol=1e-9)


def test_pseudo_labels_come_from_all_rows(spark):
    """Sums of the exchange against one loop over all rows, for one and for many partitions."""
    docs, labels = corpus(lambda words, rng: [w.upper() + "!!" for w in words])
    known = [(*(np.unique(v) for v in quality.views(*d[1:])), q) for d, (_, q, _) in zip(docs[:300], labels, strict=False)]
    models = [Ftrl(b, alpha=0.5).fit([r[v] for r in known], np.array([r[2] for r in known], float), 2) for v, b in enumerate(quality.BITS)]
    compact = [m.compact() for m in models]
    tables = [Sparse(b, *w) for b, w in zip(quality.BITS, compact, strict=True)]
    sums = {(v, y): Counter() for v in (0, 1) for y in (0, 1)}
    for d in docs:
        found = quality.views(*d[1:])
        p = [float(sigmoid(t.margin(f))) for t, f in zip(tables, found, strict=True)]
        for v in (0, 1):
            if max(p[v], 1 - p[v]) >= 0.9:
                y = int(p[v] > 0.5)
                for i in {*map(int, found[1 - v]), 1 << quality.BITS[1 - v]}:
                    sums[1 - v, y][i] += p[1 - v] - y
                sums[1 - v, y]["rows"] += 1
    assert all(c["rows"] > 100 for c in sums.values())
    df = spark.createDataFrame([d[1:] for d in docs], "text string, lang string, source string, n_chars long")
    weight = np.array([50.0, 1e9])
    got = [quality.sure_gradients(x, compact, weight, 0.9) for x in (df.coalesce(1), df.repartition(9))]
    for v in (0, 1):
        assert (got[0][v] == got[1][v]).all()
        want = np.zeros_like(got[0][v])
        for y in (0, 1):
            for i, g in sums[v, y].items():
                if i != "rows":
                    want[i] += g * min(1, weight[y] / sums[v, y]["rows"])
        assert np.allclose(got[0][v], want, atol=2e-3)


def test_samples_are_bounded(spark):
    """Repeated doc_ids give one learnt row each, and features stop at a number of bytes."""
    docs = spark.createDataFrame([(i % 7, f"text {i}", i) for i in range(70)], "doc_id long, text string, y long")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(9)] + [(1, 5, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    got = labelled_sample(docs, labels, "toxic", ["text"], 8000).collect()
    assert {(r.doc_id, r.y, r.text) for r in got} == {(i, 5 if i == 1 else i % 2, min(f"text {k}" for k in range(i, 70, 7))) for i in range(7) if not held(i)} and len(got) <= 7
    rows = spark.createDataFrame([(i, i % 2, b"x" * 10) for i in range(50)], "doc_id long, y int, x binary")
    assert len(bounded_rows(rows, ["x"], 205)) == 20 and len(bounded_rows(rows, ["x"])) == 50 and bounded_rows(rows.limit(0), ["x"]) == []
    assert bounded_rows(rows.repartition(5), ["x"], 205) == bounded_rows(rows, ["x"], 205)


def test_odd_rows(spark):
    """Very long texts, repeated rows and null ids score, alike where they are alike."""
    docs, labels = corpus(insult)
    odd = [(5, "word1 " * 200_000, "en", "a", 7), (None, "You Scum, idiot", None, None, None), (None, "You Scum, idiot", None, None, None)]
    d = spark.createDataFrame([*docs[:400], *odd, docs[3]], SCHEMA)
    y = spark.createDataFrame([*labels[:400], (None, 1, 1)], "doc_id long, quality int, toxic int")
    tox, good = score_toxicity(d, y).collect(), quality_scores(d, y).collect()
    assert len(tox) == len(good) == 404
    for rows, column in ((tox, "score"), (good, "quality_score")):
        null = [r[column] for r in rows if r.doc_id is None]
        assert len(null) == 2 and null[0] == null[1] and len({r[column] for r in rows if r.doc_id == docs[3][0]}) == 1
