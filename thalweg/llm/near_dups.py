"""Near-duplicate documents by bottom-k sketches of one hash function.

1. One pass over the texts gives each document its shingle count, a digest of the whole set and the K
   smallest values of one 64-bit hash over its shingles.
2. Equal sets are grouped by digest; only the smallest doc_id of each goes on.
3. Retained values that only one document has need no list. Of the others each document keeps the
   rarest: two sketches that share at least SHARED values must meet in the K - SHARED + 1 rarest ones,
   so very common shingles get a list only from documents made of little else. Sets that fit into the
   sketch use the exact count of values that similarity demands in place of SHARED.
   A pair with similarity 0.8 shares fewer than SHARED of K values with probability below 1e-7.
4. A list first links its members to its smallest doc_id, then, where members are still in different
   components, to members that a hash picks; this joins large groups of near copies with a few pairs
   per member. Lists that still hold several components then give the pairs between the members
   outside their largest component and the others; lists of more than CROWD members are cut into
   blocks of BLOCK that meet in tasks of their own, which return links only. Each pair must pass a comparison of BITS bits (the
   lowest bit of the smallest hash in each of BITS ranges; a similarity of 0.8 leaves a tenth of them
   different, FAR_BITS is six standard deviations more) and the estimate from the union's sketch, and
   is then confirmed on the full shingle sets of the two texts.
5. Components of the confirmed links give the groups.

No list is collected anywhere: lists are rows, and pairs come from equi-joins on the value.

Null, empty and blank texts have an empty set and link with nothing. Documents with fewer words than
the width have one shingle, the whole sequence. Rows with a null doc_id link with nothing. Rows with
the same doc_id are one node and each gets its row; where their texts differ, the one whose set has the
smallest digest is compared and stands for the node. Empty tables give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, free, sent, small_arrow_batches
from .shingles import shingle_hashes, shingle_set, word_hashes

K, SHARED, TURNS, FAMILIES, CROWD, BLOCK = 48, 22, 2, 4, 128, 2048
SKETCH = "doc_id long, tid long, n_shingles long, digest binary, sketch array<long>, bits array<long>"
BITS, FAR_BITS = 256, 54


def low_bits(h: np.ndarray) -> list[int]:
    """BITS bits: the lowest bit of the smallest of the sorted values h in each range of the hash."""
    ranges, first = np.unique((h >> np.int64(56)) & np.int64(BITS - 1), return_index=True)
    out = np.zeros(BITS, np.uint8)
    out[ranges] = h[first] & 1
    return np.packbits(out).view(np.int64).tolist()


def alike(a: Column, b: Column) -> Column:
    """Whether two documents' bits differ as little as similarity 0.8 allows."""
    apart = [F.bit_count(F.element_at(a, k).bitwiseXOR(F.element_at(b, k))) for k in range(1, BITS // 64 + 1)]
    return sum(apart[1:], apart[0]) <= FAR_BITS


def sketches(docs: DataFrame, width: int) -> DataFrame:
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, values, offsets, bits = [], [], [], [0], []
            for text in batch.column(2):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                h = shingle_hashes(word_hashes(data), width)
                counts.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                values.append(h[:K])
                bits.append(low_bits(h))
                offsets.append(offsets[-1] + len(values[-1]))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            names = ["doc_id", "tid", "n_shingles", "digest", "sketch", "bits"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(bits, pa.list_(pa.int64()))], names)

    return docs.select("doc_id", "tid", "text").mapInArrow(run, SKETCH)


def lists(reps: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, bits, entries of v and df): each document's rarest shared values, if it has any."""
    postings = reps.select("doc_id", "n_shingles", F.explode("sketch").alias("v"))
    # sums are written before they are joined: then both sides are plain shuffles and a hot value can be split
    shared = cut(postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    free(reps.sparkSession)
    n, fits = F.col("n_shingles"), F.col("n_shingles") <= F.lit(K * percent // 100)
    retained = F.least(n, F.lit(K))
    needed = F.when(fits, F.ceil(n * percent / 100)).otherwise(F.lit(SHARED))
    mine = postings.join(shared, "v").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("entries"))
    mine = mine.join(reps.select("doc_id", "n_shingles", "bits"), "doc_id")
    # values that only this document has come first in the order of rarity
    take = F.greatest(F.lit(0), F.size("entries") + 1 - needed).cast("int")
    return mine.select("doc_id", "n_shingles", "bits", F.slice("entries", 1, take).alias("entries")).where((F.size("entries") > 0) & (retained > 0))


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose doc_id is in ids."""
    return df.join(sent(ids), "doc_id", "left_semi")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the union-sketch estimate and then the Jaccard of the full sets."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = only(docs.select("doc_id", "text"), ids).dropDuplicates(["doc_id"])
    both = cut(only(reps.select("doc_id", "n_shingles", "sketch"), ids).join(texts, "doc_id"), "texts")
    x = both.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("text").alias("ta"))
    y = both.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col("text").alias("tb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    met = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    least = F.when(F.greatest("na", "nb") <= K * percent // 100, F.size(union) * percent / 100).otherwise(F.lit(float(SHARED)))
    likely = pairs.join(x, "a").join(y, "b").where(met >= least).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last = [], (None, None)
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # one pair of texts at a time
                if (first := x.as_py()) != last[0]:
                    last = first, shingle_set(first, width)
                p, q = last[1], shingle_set(y.as_py(), width)
                met = len(p & q)
                keep.append(100 * met >= percent * (len(p) + len(q) - met) and met > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return likely.mapInArrow(run, "a long, b long")


class Meeting:
    """The members of one list, or of two blocks of it, that may still link: filters over all their pairs at once."""

    def __init__(self, f: pd.DataFrame, percent: int):
        f = f.sort_values(["side", "doc_id"], ignore_index=True)
        self.f, self.cut, self.percent = f, int((f["side"] == 0).sum()), percent
        self.n = f["n_shingles"].to_numpy()
        self.c = f["c"].to_numpy()
        self.bits = np.stack(f["bits"].to_numpy()).astype(np.int64)
        self.first = self.earlier(f)

    def earlier(self, f: pd.DataFrame) -> np.ndarray:
        """Bit rows of the lists before this one that each member is in too: a pair counts in its first list only."""
        at = np.repeat(np.arange(len(f)), [len(x) for x in f["also"]])
        values = np.concatenate(list(f["also"]))
        keep = values < f["v"].iloc[0]
        ids, inverse, times = np.unique(values[keep], return_inverse=True, return_counts=True)
        shared = times[inverse] > 1
        _, column = np.unique(inverse[shared], return_inverse=True)
        table = np.zeros((len(f), max(64, -(-(int(column.max(initial=-1)) + 1) // 64) * 64)), np.uint8)
        table[at[keep][shared], column] = 1
        return np.packbits(table, axis=1).view(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may link: different components, sizes and bits allow it, and no earlier list has both."""
        two = self.cut < len(self.f)
        rows, cols = np.arange(self.cut), np.arange(self.cut, len(self.f)) if two else np.arange(self.cut)
        found = []
        for s in range(0, len(rows), 64):
            r = rows[s : s + 64]
            ok = self.c[r][:, None] != self.c[cols][None]
            low, high = np.minimum(self.n[r][:, None], self.n[cols][None]), np.maximum(self.n[r][:, None], self.n[cols][None])
            ok &= low * 100 >= high * self.percent
            if not two:
                ok &= r[:, None] < cols[None]
            i, j = np.nonzero(ok)
            i, j = r[i], cols[j]
            near = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1) <= FAR_BITS
            i, j = i[near], j[near]
            fresh = ~(self.first[i] & self.first[j]).any(axis=1)
            found.append((i[fresh], j[fresh]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose sets of shingle hashes are similar enough, by one product of incidence rows."""
        i, j = self.pairs()
        sets = [shingle_hashes(word_hashes(t.encode("utf-8", "surrogatepass").lower()), width) for t in self.f["text"]]
        sizes = np.array([len(x) for x in sets])
        values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        member = np.repeat(np.arange(len(sets)), sizes)
        shared = times[inverse] > 1
        _, column = np.unique(inverse[shared], return_inverse=True)
        member = member[shared]
        columns = int(column.max(initial=-1)) + 1
        if len(i) * 20e-6 < len(sets) ** 2 * columns * 1e-10:  # seconds for one pair, and for one entry of the product
            met = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)])
        else:
            met = np.zeros(len(i))
            for s in range(0, columns, 1024):
                part = (column >= s) & (column < s + 1024)
                rows = np.zeros((len(sets), 1024), np.float32)
                rows[member[part], column[part] - s] = 1
                met += (rows @ rows.T)[i, j]
        ok = 100 * met >= self.percent * (sizes[i] + sizes[j] - met)
        return i[ok], j[ok]


def crowded_pairs(large: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within long lists. Members outside the largest component meet everyone, in blocks of
    about BLOCK members; a task returns the members that pass the filters, and a second one, with their
    texts, the links: never the pairs that were looked at. Members of the largest component don't meet."""
    main = F.col("c") == F.col("major")
    outer, inner = F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int"), F.ceil(F.col("n_main") / BLOCK).cast("int")
    mine = F.when(main, outer + F.pmod(F.xxhash64("doc_id"), inner)).otherwise(F.pmod(F.xxhash64("doc_id"), outer)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(main, outer).otherwise(outer + inner) - 1))
    met = large.select("v", "doc_id", "n_shingles", "c", main.alias("main"), "bits", "also", mine.alias("part"), other.alias("other"))
    met = met.select("*", F.least("part", "other").alias("p1"), F.greatest("part", "other").alias("p2"), (F.col("part") > F.col("other")).cast("int").alias("side")).drop("part", "other")
    keys = ["v", "p1", "p2"]

    def look(f: pd.DataFrame) -> pd.DataFrame:
        if f["main"].all():
            return pd.DataFrame({k: [] for k in [*keys, "side", "doc_id"]})
        m = Meeting(f, percent)
        i, j = m.pairs()
        return m.f.loc[np.unique(np.concatenate([i, j])), [*keys, "side", "doc_id"]]

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        m = Meeting(f, percent)
        if m.cut == 0 or (f["p1"].iloc[0] != f["p2"].iloc[0] and m.cut == len(f)):
            return pd.DataFrame({"a": [], "b": []})
        i, j = m.links(width)
        ids = m.f["doc_id"].to_numpy()
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    likely = cut(met.groupBy(*keys).applyInPandas(look, "v long, p1 int, p2 int, side int, doc_id long"), "likely")
    texts = only(docs.select("doc_id", "text"), cut(likely.select("doc_id").distinct(), "ids")).dropDuplicates(["doc_id"])
    again = met.join(likely, [*keys, "side", "doc_id"]).join(texts, "doc_id")
    return again.groupBy(*keys).applyInPandas(decide, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tid", F.xxhash64("text"))
    base = cut(sketches(docs, width), "sketches")
    nodes = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = nodes.groupBy("doc_id").agg(F.min_by("tid", F.struct("digest", "tid")).alias("chosen"), F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo < hi")
    several = cut(several.select("doc_id", "chosen"), "several")
    if several.limit(1).count():
        nodes, docs = (x.join(sent(several), "doc_id", "left").where("chosen IS NULL OR tid = chosen").select(x.columns) for x in (nodes, docs))
    copies = nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
    # written before it is joined, so that one digest of very many documents can be split
    copies = nodes.select("doc_id", "digest").join(cut(copies, "digests"), "digest")
    same = cut(copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "copies")
    reps = nodes.join(same, nodes["doc_id"] == same["a"], "left_anti").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "sketch", "bits")
    listed = cut(lists(reps, percent), "lists")
    free(docs.sparkSession)

    def placed(grouped: DataFrame | None) -> DataFrame:
        """A row for each member of each list, c its component so far; lists of two are settled by the first turn."""
        if grouped is None:
            rows = listed.withColumn("c", F.col("doc_id"))
        else:
            named = grouped.select(F.col("node").alias("doc_id"), F.col("component_id").alias("c"))
            rows = listed.join(named, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
            rows = rows.withColumn("entries", F.filter("entries", lambda e: e["df"] > 2))
        return rows.select("doc_id", "n_shingles", "bits", "c", F.col("entries.v").alias("also"), F.explode("entries.v").alias("v"))

    links, grouped = same, None
    for turn in range(TURNS):
        members = placed(grouped)
        # the first turn's heads are the smallest doc_ids; later ones differ from list to list
        first = F.xxhash64("doc_id", F.pmod("v", F.lit(FAMILIES)), F.lit(turn)) if turn else F.col("doc_id")
        heads = members.groupBy("v").agg(F.min_by(F.struct("doc_id", "n_shingles", "bits", "c"), first).alias("head"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        heads = heads.where("lo < hi").select("v", F.col("head.doc_id").alias("h"), F.col("head.n_shingles").alias("nh"), F.col("head.bits").alias("bh"), F.col("head.c").alias("ch"))
        heads = cut(heads, "heads")
        may = (F.col("c") != F.col("ch")) & sizes_allow(F.col("nh"), F.col("n_shingles"), percent) & alike(F.col("bh"), F.col("bits"))
        stars = members.drop("also").join(heads, "v").where(may)
        pairs = cut(stars.select(F.least("h", "doc_id").alias("a"), F.greatest("h", "doc_id").alias("b")).distinct(), "pairs")
        links = links.union(cut(confirm(pairs, reps, docs, width, percent), "links"))
        free(docs.sparkSession)
        grouped = cut(components(links), "grouped")

    # what is left: members outside a list's largest component against all others of the list
    members = placed(grouped)
    sizes = members.groupBy("v", "c").agg(F.count("*").alias("n"))
    major = sizes.groupBy("v").agg(F.max_by("c", F.struct("n", "c")).alias("major"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_ = cut(members.join(cut(major, "major"), "v"), "open")
    free(docs.sparkSession)
    small, large = open_.where(F.col("n") <= CROWD), open_.where(F.col("n") > CROWD)
    x = small.where("c <> major").select("v", F.col("doc_id").alias("x"), F.col("n_shingles").alias("nx"), F.col("c").alias("cx"), F.col("bits").alias("bx"))
    y = small.select("v", F.col("doc_id").alias("y"), F.col("n_shingles").alias("ny"), F.col("c").alias("cy"), (F.col("c") == F.col("major")).alias("main"), F.col("bits").alias("by"))
    rest = x.join(y, (x["v"] == y["v"]) & (F.col("cx") != F.col("cy")) & (F.col("main") | (F.col("x") < F.col("y"))) & sizes_allow(F.col("nx"), F.col("ny"), percent) & alike(F.col("bx"), F.col("by")))
    rest = cut(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(crowded_pairs(large, docs, width, percent)).distinct(), "pairs")
    more = cut(confirm(rest, reps, docs, width, percent), "links")
    free(docs.sparkSession)
    groups = components(links.union(more))
    out = base.select("doc_id", "n_shingles").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_dups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, that with the smallest doc_id; all columns as they are. Rows without doc_id stay."""
    groups = cut(near_groups(docs, width, percent), "groups")
    twice = cut(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("kept").alias("kept")).where("n > 1").select("doc_id", "kept"), "twice")
    gone = cut(groups.where("NOT kept").select("doc_id").union(twice.select("doc_id")).distinct(), "gone")
    once = docs.join(sent(gone), "doc_id", "left_anti").select(docs.columns)
    firsts = docs.join(sent(twice.where("kept").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return once.union(firsts)


# rows that repeat a doc_id with other texts aside, which SQL doesn't choose among
NEAR_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE len(w) WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM words),
rows AS (SELECT doc_id, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM rows a JOIN rows b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT met.a, met.b FROM met JOIN sets p ON p.doc_id = met.a JOIN sets q ON q.doc_id = met.b WHERE 100 * met.n >= 80 * (len(p.s) + len(q.s) - met.n)),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS id, doc_id AS root FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.id = e.a WHERE r.root < e.b),
groups AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN groups ON id = doc_id
"""
