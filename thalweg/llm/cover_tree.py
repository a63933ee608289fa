"""All pairs of vectors with cosine at or above a threshold, by cover trees and dual traversal.

On unit vectors cosine c is distance sqrt(2 - 2c), so the pairs wanted are those within a radius.

1. Equal vectors become one point with a weight. Points go to the nearest of a few pivots (farthest
   first over a bounded sample), and each cell is cut into blocks. A point is sent once for each block, so blocks
   are as large as keeps all cores busy, from BLOCK points up to BLOCK_BYTES of vectors.
2. Each block gets a cover tree: nested levels with halving radii, each point within its level's
   radius of its centre, centres of a level further apart than that within their parent.
3. Pairs of blocks are traversed together, level by level. A pair of nodes is dropped when the centres
   are further apart than the radius plus both covering radii, taken whole when they are nearer than
   the radius less both, and opened otherwise; pairs of single points are decided in double precision.
   Cells whose bounds exclude every pair are never sent to meet. Nothing is approximate: bounds carry
   a margin for rounding and only the final decision uses the threshold itself.
4. A task returns sums per point and a spanning forest of the links it saw, never the pairs. Nor does it
   hold them: pairs of nodes are opened some at a time (HELD), depth first, and links within the forest are
   counted and let go, so its memory follows its two blocks and not the pairs between them.

Vectors without direction (null, empty, zero, or with null or non-finite components) link with
nothing. Vectors of different dimensions never link. Rows that repeat a vec_id count as vectors of
their own, each with its links, and share a component; rows with a null vec_id link with nothing. Empty
tables give an empty result. Extra columns are ignored.

In high dimensions, where most points are nearly orthogonal, bounds exclude little above single
points and the work stays quadratic in distinct vectors, though as dense matrix products; the README
has figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, looked_up, sent

BLOCK, BLOCK_BYTES, SAMPLE, PIVOTS, LEVELS, SKIP, MARGIN = 4096, 32 << 20, 2048, 32, 7, 0.6, 2e-5
HELD, CENTRES, LINKS = 8 << 20, 4096, 1 << 18  # bytes of vectors compared at once, columns of a product, links not yet in the forest
POINT = "rep long, w long, vec binary, block long, at int, path binary"


def unit(rows: list, dtype: type = np.float64) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.array([np.frombuffer(r, np.float64) if isinstance(r, bytes) else r for r in rows], np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def loaded(batches: Iterator[pd.DataFrame], by: str, real: type) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of a group as arrays in the order of by, and its vectors as numbers of type real."""
    names: dict[str, list[np.ndarray]] = {}
    vecs = []
    for f in batches:
        if len(f):
            for c in f.columns.drop(["vec", "path"], errors="ignore"):
                names.setdefault(c, []).append(f[c].to_numpy())
            if "path" in f:
                names.setdefault("path", []).append(np.frombuffer(b"".join(f["path"]), np.int32).reshape(len(f), -1))
            vecs.append(np.frombuffer(b"".join(f["vec"]), real).reshape(len(f), -1))
    found = {c: np.concatenate(v) for c, v in names.items()}
    order = np.argsort(found[by], kind="stable")
    return {c: v[order] for c, v in found.items()}, np.concatenate(vecs)[order]


def unit_parts(raw: np.ndarray) -> np.ndarray:
    """unit(raw), without more than a part of it twice."""
    x = np.empty(raw.shape, np.float64)
    for a in range(0, len(x), CENTRES):
        x[a : a + CENTRES] = unit(raw[a : a + CENTRES])
    return x


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of n rows."""
    chosen = [0]
    far = 2 - 2 * sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * sample @ sample[chosen[-1]])
    return sample[chosen]


def net(x: np.ndarray, members: np.ndarray, radius: float) -> np.ndarray:
    """For each member the member that is its centre: within radius, centres pairwise further apart."""
    owner = np.full(len(members), -1)
    centres: list[int] = []
    near = 1 - radius * radius / 2  # cosine at that distance
    step = 512
    for a in range(0, len(members), step):
        part = x[members[a : a + step]]
        known, top = np.array(centres, np.int64), np.full(len(part), near, np.float32)
        for b in range(0, len(known), CENTRES):
            c = part @ x[members[known[b : b + CENTRES]]].T
            best = c.argmax(axis=1)
            value = c[np.arange(len(part)), best]
            ok = value >= top
            owner[a : a + step][ok] = known[b + best[ok]]
            top = np.maximum(top, value)
        free = a + np.flatnonzero(owner[a : a + step] < 0)
        while len(free):
            # of what is left, those nearer to no earlier one become centres at once
            c = x[members[free]] @ x[members[free]].T >= near
            first = ~np.tril(c, -1).any(axis=1)
            heads = np.flatnonzero(first)
            centres += free[heads].tolist()
            hit = c[:, heads]
            got = hit.any(axis=1)
            owner[free[got]] = free[heads][hit[got].argmax(axis=1)]
            free = free[~got]
    return members[owner]


def build_tree(x: np.ndarray) -> np.ndarray:
    """paths[i, level]: the centre of point i at each level; radii 2, 1, 1/2, ..."""
    x = x.astype(np.float32)
    paths = np.zeros((len(x), LEVELS), np.int32)
    for level in range(1, LEVELS):
        order = np.argsort(paths[:, level - 1], kind="stable")
        cuts = np.flatnonzero(np.diff(paths[order, level - 1])) + 1
        for members in np.split(order, cuts):
            # the parent's centre stays a centre: nested levels
            head = paths[members[0], level - 1]
            members = np.concatenate([[head], members[members != head]])
            paths[members, level] = net(x, members, 2.0 ** (1 - level)) if len(members) > 1 else members
    return paths


class Tree:
    def __init__(self, x: np.ndarray, paths: np.ndarray, weight: np.ndarray):
        self.x, self.x32, self.weight = x, x.astype(np.float32), weight
        self.levels = []
        n = len(x)
        below = np.arange(n)
        for level in [*range(paths.shape[1]), None]:
            owner = below if level is None else paths[:, level]
            centres, node = np.unique(owner, return_inverse=True)
            d = np.concatenate([np.zeros(0), *(np.sqrt(((x[s : s + CENTRES] - x[centres[node[s : s + CENTRES]]]) ** 2).sum(axis=1)) for s in range(0, n, CENTRES))])
            radius = np.zeros(len(centres))
            np.maximum.at(radius, node, d)
            total = np.zeros(len(centres), np.int64)
            np.add.at(total, node, weight)
            order = np.argsort(node, kind="stable")
            start = np.searchsorted(node[order], np.arange(len(centres) + 1))
            self.levels.append({"centres": centres, "node": node, "radius": radius, "total": total, "order": order, "start": start})
        # a level that hardly gathers the next one excludes nothing that the next doesn't
        kept = [self.levels[-1]]
        for level in self.levels[-2:0:-1]:
            if len(level["centres"]) <= SKIP * len(kept[0]["centres"]):
                kept.insert(0, level)
        self.levels = [self.levels[0], *kept]
        for upper, lower in zip(self.levels, self.levels[1:], strict=False):
            parent = upper["node"][lower["centres"]]
            order = np.argsort(parent, kind="stable")
            upper["children"], upper["child_start"] = order, np.searchsorted(parent[order], np.arange(len(upper["centres"]) + 1))


def opened(level_a: dict, level_b: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a[k] with a child of b[k]."""
    na, nb = np.diff(level_a["child_start"])[a], np.diff(level_b["child_start"])[b]
    each = na * nb
    k = np.repeat(np.arange(len(a)), each)
    i = np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
    return level_a["children"][level_a["child_start"][a[k]] + i // nb[k]], level_b["children"][level_b["child_start"][b[k]] + i % nb[k]]


def step_down(levels: list[dict], k: int) -> dict:
    """Level k; where the next is the same root again, its only child is itself."""
    level = levels[k]
    if k + 1 < len(levels) and levels[k + 1] is level:
        return level | {"children": np.zeros(1, np.int64), "child_start": np.array([0, 1])}
    return level


class Forest:
    """Which of n points links connect. Links between points that are known to be connected aren't kept."""

    def __init__(self, n: int):
        self.label, self.new, self.held = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if apart.any():
            self.new.append(np.stack([a[apart], b[apart]]))
            self.held += self.new[-1].shape[1]
            if self.held > LINKS:
                self.settle()

    def settle(self) -> np.ndarray:
        """The smallest point reachable from each."""
        if self.new:
            self.label = roots(len(self.label), np.concatenate([*self.new, np.stack([np.arange(len(self.label)), self.label])], axis=1))
            self.new, self.held = [], 0
        return self.label


def dual(ta: Tree, tb: Tree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links per point of either tree, and the smallest point reachable by links from each (of both trees, as ids na + ib)."""
    reach = np.sqrt(2 - 2 * cosine)
    same = ta is tb
    na, dim = ta.x.shape
    got_a, got_b = np.zeros(na, np.int64), np.zeros(len(tb.x), np.int64)
    # the shallower tree waits at its root until both have as many levels left
    depth = max(len(ta.levels), len(tb.levels))
    levels_a, levels_b = ([t.levels[0]] * (depth - len(t.levels)) + t.levels for t in (ta, tb))
    last = depth - 1
    shift = 0 if same else na
    forest = Forest(na if same else na + len(tb.x))
    some = min(1 << 18, max(16, HELD // (8 * dim)))
    rounding = (dim + 8) * 2.0**-23  # more than a product in single precision can be off

    def linked(ca: np.ndarray, cb: np.ndarray) -> None:
        if same:
            ca, cb = ca[ca != cb], cb[ca != cb]
        np.add.at(got_a, ca, tb.weight[cb])
        np.add.at(got_b, cb, ta.weight[ca])
        forest.add(ca, cb + shift)

    def decide(ca: np.ndarray, cb: np.ndarray) -> None:
        keep = np.einsum("ij,ij->i", ta.x[ca], tb.x[cb]) >= cosine
        linked(ca[keep], cb[keep])

    def below(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pairs of nodes of the next level that may hold links beneath the pairs a[k], b[k], some at a time."""
        la, lb = step_down(levels_a, level), step_down(levels_b, level)
        ca, cb = la["centres"][a], lb["centres"][b]
        c = np.einsum("ij,ij->i", ta.x32[ca], tb.x32[cb]).astype(np.float64)
        d2 = 2 - 2 * c
        radii = la["radius"][a] + lb["radius"][b]
        maybe = np.sqrt(np.maximum(0, d2 - MARGIN)) - radii <= reach
        whole = (np.sqrt(np.maximum(0, d2) + MARGIN) + radii <= reach - 1e-6) & maybe
        for i, j in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
            ma, mb = la["order"][la["start"][i] : la["start"][i + 1]], lb["order"][lb["start"][j] : lb["start"][j + 1]]
            got_a[ma] += lb["total"][j]
            got_b[mb] += la["total"][i]
            if same and i == j:
                got_a[ma] -= ta.weight[ma]
                got_b[mb] -= ta.weight[mb]
            forest.add(ma, np.full(len(ma), mb[0] + shift))
            forest.add(np.full(len(mb), ma[0]), mb + shift)
        a, b = a[maybe & ~whole], b[maybe & ~whole]
        if not len(a):
            return
        # many children at once are compared by one matrix product, few by single products
        ka, kb = np.diff(la["child_start"])[a], np.diff(lb["child_start"])[b]
        dense = ka * kb > 4096
        na_, nb_ = levels_a[level + 1], levels_b[level + 1]
        for i, j in zip(a[dense].tolist(), b[dense].tolist(), strict=True):
            xa = la["children"][la["child_start"][i] : la["child_start"][i + 1]]
            xb = lb["children"][lb["child_start"][j] : lb["child_start"][j + 1]]
            single = nb_["radius"][xb] == 0
            for own in (xb[single], xb[~single]):
                for t in range(0, len(own), 2048):
                    cols = own[t : t + 2048]
                    vb, rb = tb.x32[nb_["centres"][cols]].T, nb_["radius"][cols]
                    widest = rb.max()
                    for s in range(0, len(xa), 128):
                        part = xa[s : s + 128]
                        c = ta.x32[na_["centres"][part]] @ vb
                        # first by the largest radius there is, then by each pair's own
                        bound = np.minimum(2.0, reach + na_["radius"][part] + widest)
                        p, q = np.nonzero(c >= (1 - (bound * bound + MARGIN) / 2)[:, None].astype(np.float32) - np.float32(1e-6))
                        if not len(p):
                            continue
                        c, p, q = c[p, q], part[p], cols[q]
                        if level + 1 == last:
                            sure = c >= cosine + rounding
                            linked(na_["centres"][p[sure]], nb_["centres"][q[sure]])
                            p, q = p[~sure], q[~sure]
                        else:
                            each = np.minimum(2.0, reach + na_["radius"][p] + nb_["radius"][q])
                            ok = c >= 1 - (each * each + MARGIN) / 2
                            p, q = p[ok], q[ok]
                        for r in range(0, len(p), some):
                            yield level + 1, p[r : r + some], q[r : r + some]
        few = np.flatnonzero(~dense)
        for p in np.split(few, np.flatnonzero(np.diff(np.cumsum((ka * kb)[few]) // some)) + 1):
            na2, nb2 = opened(la, lb, a[p], b[p])
            for r in range(0, len(na2), some):
                yield level + 1, na2[r : r + some], nb2[r : r + some]

    # each level waits in its own generator, so what is held follows the depth and not the pairs
    work: list[Iterator[tuple[int, np.ndarray, np.ndarray]]] = [iter([(0, np.zeros(1, np.int64), np.zeros(1, np.int64))])]
    while work:
        if (found := next(work[-1], None)) is None:
            work.pop()
        elif found[0] == last:
            decide(levels_a[last]["centres"][found[1]], levels_b[last]["centres"][found[2]])
        else:
            work.append(below(*found))
    return got_a, got_b, forest.settle()


def roots(n: int, edges: np.ndarray) -> np.ndarray:
    """The smallest point reachable from each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[edges[0]], label[edges[1]])
        new = label.copy()
        np.minimum.at(new, label[edges[0]], low)
        np.minimum.at(new, label[edges[1]], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def link(vectors: DataFrame, cosine: float = 0.9, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    # what came as float is sent as float, without loss; everything is computed in double
    real = np.float32 if isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType) else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    points = rows.where(sound).groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("w")).withColumn("dim", F.size("e"))
    # numbers that are written once are the same for every reader
    points = cut(points.withColumn("rep", F.monotonically_increasing_id()), "points")
    n_points = points.count()

    sample = points.orderBy(F.xxhash64("e"), "e").limit(SAMPLE).select("dim", "e").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.e)
    if block is None:
        # pairs of blocks are tasks: some twice as many as cores
        side = 2 * max(1, spark.sparkContext.defaultParallelism) ** 0.5
        block = max(BLOCK, min(int(n_points / side) + 1, BLOCK_BYTES // (8 * max(by_dim, default=1))))
    cells = {d: pivots(unit(v), max(1, min(PIVOTS, n_points // block))) for d, v in by_dim.items()}

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                x = unit(g["e"].tolist())
                if (p := cells.get(dim)) is not None:
                    c = x @ p.T
                    cell, far = c.argmax(axis=1), np.sqrt(np.maximum(0, 2 - 2 * c.max(axis=1)))
                else:
                    cell, far = np.zeros(len(x), int), np.full(len(x), 2.0)
                yield pd.DataFrame({"rep": g["rep"], "w": g["w"], "dim": dim, "vec": [np.asarray(v, real).tobytes() for v in g["e"]], "cell": cell, "far": far})

    placed = cut(points.select("rep", "w", "dim", "e").mapInPandas(assign, "rep long, w long, dim int, vec binary, cell int, far double"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("n") / block)), "cells")
    block_id = F.xxhash64("dim", "cell", F.pmod(F.xxhash64("rep"), "blocks"))
    blocked = placed.join(sizes.drop("far", "n"), ["dim", "cell"]).withColumn("block", block_id).select("rep", "w", "vec", "block")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, raw = loaded(batches, "rep", real)
        paths = build_tree(unit_parts(raw))
        for a in range(0, len(raw), CENTRES):
            part = slice(a, a + CENTRES)
            at = np.arange(a, a + len(raw[part]), dtype=np.int32)
            yield pd.DataFrame({"rep": f["rep"][part], "w": f["w"][part], "vec": [v.tobytes() for v in raw[part]], "block": f["block"][part], "at": at, "path": [v.tobytes() for v in paths[part]]})

    trees = cut(blocked.groupBy("block").applyInPandas(grow, POINT), "trees")

    # which cells may hold pairs: one row per pair of pivots, however many vectors there are
    bounds = {(r.dim, r.cell): r.far for r in sizes.collect()}
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    meet = []
    for (dim, i), fi in bounds.items():
        for (dim2, j), fj in bounds.items():
            if dim == dim2 and i <= j and (dim not in cells or np.linalg.norm(cells[dim][i] - cells[dim][j]) - fi - fj <= reach):
                meet.append((dim, i, j))
    pairs = spark.createDataFrame(meet or [(0, -1, -1)], "dim int, c1 int, c2 int")
    blocks = sizes.select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")).withColumn("block", F.xxhash64("dim", "cell", "k"))
    one, two = (blocks.select("dim", F.col("cell").alias(f"c{s}"), F.col("block").alias(f"b{s}")) for s in (1, 2))
    met = pairs.join(one, ["dim", "c1"]).join(two, ["dim", "c2"]).where((F.col("c1") < F.col("c2")) | (F.col("b1") <= F.col("b2")))
    sides = F.when(F.col("b1") == F.col("b2"), F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b2").alias("block"), F.lit(1).alias("side"))))
    met = cut(met.select("b1", "b2", F.inline(sides)), "meetings")

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, raw = loaded((g.assign(at=g["at"] + g["side"].astype("int64") * 2**32) for g in batches), "at", real)
        second = int(f["side"].sum())
        n = len(raw) - second
        trees_ = [Tree(unit_parts(raw[s]), f["path"][s], f["w"][s]) for s in (slice(0, n), slice(n, None))[: 1 + bool(second)]]
        ids = f["rep"]
        del f, raw
        ta, tb = trees_[0], trees_[-1]
        got_a, got_b, root = dual(ta, tb, cosine)
        got = got_a if ta is tb else np.concatenate([got_a, got_b])
        keep = got > 0
        yield pd.DataFrame({"rep": ids[keep], "links": got[keep], "root": ids[root[keep]]})

    seen = cut(trees.join(met, "block").groupBy("b1", "b2").applyInPandas(traverse, "rep long, links long, root long"), "seen")
    links = seen.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = seen.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    again = cut(rows.where(sound).groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "again")
    if again.limit(1).count():
        held = cut(rows.where(sound).join(sent(again), "vec_id", "left_semi").distinct().join(points.select("e", "rep"), "e").select("vec_id", "rep"), "held")
        edges = edges.union(held.join(cut(held.groupBy("vec_id").agg(F.min("rep").alias("first")), "firsts"), "vec_id").select("rep", "first"))
    groups = components(edges)
    per_point = points.select("e", "rep", "w", "least").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    per_point = cut(per_point.select("e", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "least", F.coalesce("component_id", "rep").alias("group")), "per_point")
    named = per_point.groupBy("group").agg(F.min("least").alias("component_id"))
    per_point = cut(looked_up(per_point, "group", named, "component_id").select("e", "n_links", "component_id"), "per_point")
    good = rows.where(sound).join(per_point, "e").select("vec_id", "n_links", "component_id")
    out = good.union(rows.where(~sound).select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


LINK_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON r.id = p.a WHERE r.root < p.b),
groups AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN groups ON id = vec_id LEFT JOIN degree ON a = vec_id
"""
