import math
import tracemalloc

import numpy as np
import pytest

from tests.llm.brute import groups
from thalweg.llm.cover_tree import Tree, build_tree, dual, link


def brute(rows, cosine=0.9):
    ok = {}
    for i, e in rows:
        if e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = np.array(e, np.float64)
            ok[i] = v / np.linalg.norm(v)
    ids = list(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]
    comp = groups([i for i, _ in rows], links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], comp[i], comp[i] == i) for i, _ in rows)


@pytest.mark.parametrize("dim,block", [(3, 4096), (3, 60), (16, 60), (64, 100)])
def test_matches_brute_force(spark, dim, block):
    rng = np.random.default_rng(dim + block)
    x = rng.normal(size=(260, dim))
    tight = rng.normal(size=dim) * 3 + rng.normal(size=(120, dim)) * 0.25
    chain = [np.cos(t) * np.eye(dim)[0] + np.sin(t) * np.eye(dim)[1] for t in np.linspace(0, 3, 40)]
    every = [*x, *tight, *chain, *([tight[0]] * 30), tight[1] * 4]
    rows = [(i, [float(np.float32(v)) for v in e]) for i, e in enumerate(every)]
    rows += [(900, None), (901, [0.0] * dim), (902, [float("nan")] + [1.0] * (dim - 1)), (903, []), (904, [None] + [1.0] * (dim - 1)), (905, [1.0] * (dim + 1)), (906, [2.0] * (dim + 1)), (907, [float("inf")] * dim)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in link(df, block=block).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert link(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_repeated_and_null_ids(spark):
    """A repeated vec_id has a row and links for each vector, and one component; clashing columns are ignored."""
    a, b, c, d = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.05]
    rows = [(5, a), (5, c), (3, b), (9, d), (9, d), (None, a), (7, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, n_links int, rep string")
    got = sorted((tuple(r) for r in link(df).collect()), key=str)
    want = [(5, 1, 3, False), (5, 2, 3, False), (3, 1, 3, True), (9, 2, 3, False), (9, 2, 3, False), (None, 0, None, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)


def test_long_vectors_and_many_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 1500))
    every = [*x, *([x[3]] * 400), x[4] + 0.1 * rng.normal(size=1500)]
    rows = [(1000 - i, [float(np.float32(v)) for v in e]) for i, e in enumerate(every)]
    got = sorted(tuple(r) for r in link(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16).collect())
    assert got == brute(rows)


def near_copies(rng, n, dim=64):
    """n vectors of cosine about 0.985 with each other, as check_h has them: too far apart to be taken whole."""
    centre = rng.normal(size=dim)
    return centre / np.linalg.norm(centre) + rng.normal(size=(n, dim)) * 0.0155


@pytest.mark.parametrize("blocks", [1, 2])
def test_memory_follows_points_not_links(blocks):
    """Millions of links within a group are counted without being held: they took about 200 bytes each."""
    rng = np.random.default_rng(blocks)
    n = 2500
    x = np.concatenate([near_copies(rng, blocks * n), rng.normal(size=(600, 64))])
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = np.array_split(x, blocks)
    weights = [rng.integers(1, 4, len(p)) for p in parts]
    trees = [Tree(p, build_tree(p), w) for p, w in zip(parts, weights, strict=True)]
    tracemalloc.start()
    got_a, got_b, _ = dual(trees[0], trees[-1], 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    c = parts[0] @ parts[-1].T >= 0.9
    if blocks == 1:
        np.fill_diagonal(c, False)
    assert c.sum() > 5_000_000
    assert (got_a == c @ weights[-1]).all() and (got_b == c.T @ weights[0]).all()
    assert peak < 150 << 20


@pytest.mark.parametrize("kind", ["float", "double"])
def test_group_over_blocks(spark, kind):
    """A group of near copies spread over blocks, some at the threshold itself; doubles keep their digits."""
    rng = np.random.default_rng(11)
    edge = [np.array([1.0, 0.0] + [0.0] * 62), np.array([0.9, math.sqrt(1 - 0.81 - 1e-9)] + [0.0] * 62), np.array([0.9, math.sqrt(1 - 0.81 + 1e-9)] + [0.0] * 62)]
    every = [*near_copies(rng, 300), *rng.normal(size=(60, 64)), *edge]
    rows = [(1000 - i, [float(np.float32(v)) if kind == "float" else float(v) for v in e]) for i, e in enumerate(every)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for block in (4096, 100):
        assert sorted(tuple(r) for r in link(df, block=block).collect()) == brute(rows)
